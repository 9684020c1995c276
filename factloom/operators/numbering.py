"""Running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sums_before(rows: DataFrame, order: Sequence[str], amounts: Mapping[str, Column], write: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with, for each name of ``amounts``, the sum of its column over all rows before, in ``order`` within ``by``.

    Rows are sorted by range into parts and written (``write``), so that a part is
    the same in every later job; a part's sum of the parts before it comes from
    the parts' totals, a row's from the rows of its part. Without ``by`` the totals,
    one row per part, pass through the driver. ``order`` should tell rows apart;
    keep texts out of ``rows`` and join them back.
    """
    ranged = write(rows.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()))
    names = list(amounts)
    totals = ranged.groupBy(*by, "part_").agg(*(F.sum(amounts[n]).alias(n) for n in names))
    if by:
        w = W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
        bases = totals.select(*by, "part_", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"base_{n}") for n in names))
    else:
        base, found = dict.fromkeys(names, 0), []
        for r in sorted(totals.collect(), key=lambda r: r.part_):
            found.append((r.part_, *(base[n] for n in names)))
            base = {n: base[n] + (r[n] or 0) for n in names}
        kinds = ", ".join(f"base_{n} {totals.schema[n].dataType.simpleString()}" for n in names)
        bases = F.broadcast(rows.sparkSession.createDataFrame(found, f"part_ int, {kinds}"))
    keys = [*by, "part_"]
    bases = bases.select(*(F.col(k).alias(f"own_{k}") for k in keys), *(f"base_{n}" for n in names))
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(amounts[n]).over(w), F.lit(0)).alias(f"local_{n}") for n in names))
    joined = local.join(bases, reduce(and_, (F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys)))
    return joined.select(*rows.columns, *((F.col(f"base_{n}") + F.col(f"local_{n}")).alias(n) for n in names))
