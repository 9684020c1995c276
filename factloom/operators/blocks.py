"""Structured blocks of a text: Markdown tables, HTML tables, record series."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import lines_of

# Shapes of rows, headers and fields; limits.
ROW, SEPARATOR = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"
HEADER = re.compile(r"^\s*([A-Za-z][A-Za-z0-9 _()/-]{0,38}?)\s*#?\s*(\d+)\s*$", re.A)
FIELD = re.compile(r"^\s*([A-Za-z][A-Za-z0-9 /()_-]{0,30}?):\s+(\S.*?)\s*$", re.A)
LEAST_RECORDS, LEAST_CONFIDENCE = 3, 0.6


class Block(NamedTuple):
    kind: int  # 0 Markdown table, 1 HTML table, 2 record series
    title: str
    markdown: str
    confidence: float
    start: int


def table(rows: list[list[str]]) -> str:
    """The first row is the header and sets the width; others are padded or cut."""
    width = len(rows[0])
    lines = [rows[0], ["---"] * width, *([*r, *[""] * width][:width] for r in rows[1:])]
    return "\n".join("|" + "|".join(f" {c} " for c in line) + "|" for line in lines)


def markdown_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table_no, first_line, rows) outside fences: a pipe row, a separator row with a dash, pipe rows behind.

    Rows that neighbour one another form a run; a run's first separator behind a
    row makes that row the header.
    """
    w = W.partitionBy(id_col).orderBy("line_no")
    lines = lines_of(docs, id_col, text_col).withColumn("row", F.col("line").rlike(ROW) & ~F.col("fenced"))
    lines = lines.withColumn("run", F.sum((~F.col("row")).cast("int")).over(w)).where("row")
    lines = lines.withColumn("separates", F.col("line").rlike(SEPARATOR) & F.contains("line", F.lit("-")))
    run = W.partitionBy(id_col, "run").orderBy("line_no")
    lines = lines.withColumn("heads", F.lead("separates", 1, False).over(run))
    first = F.min(F.when(F.col("heads"), F.col("line_no"))).over(W.partitionBy(id_col, "run"))
    body = lines.withColumn("first_line", first).where("line_no >= first_line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.trim(s["line"])), "\n")
    tables = body.groupBy(id_col, "first_line").agg(F.count("*").alias("rows"), text.alias("markdown"))
    return tables.withColumn("table_no", F.row_number().over(W.partitionBy(id_col).orderBy("first_line")))


class _Tables(HTMLParser):
    """Rows of each table of a page, in the order in which tables begin; a nested table is a table too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[int] = []
        self.cells: list[list[str] | None] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append(len(self.tables))
            self.tables.append([])
            self.cells.append(None)
        elif self.open and tag == "tr":
            self._close()
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            if not self.tables[self.open[-1]]:
                self.tables[self.open[-1]].append([])
            self.cells[-1] = []

    def _close(self) -> None:
        if self.open and self.cells[-1] is not None:
            text = " ".join(" ".join(self.cells[-1]).split()).replace("|", r"\|")
            self.tables[self.open[-1]][-1].append(text)
            self.cells[-1] = None

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()
                self.cells.pop()

    def handle_data(self, data: str) -> None:
        for cell in self.cells:
            if cell is not None:
                cell.append(data)


def html_tables(text: str) -> list[Block]:
    """Tables get the places, in bytes, of successive "<table"; one that isn't found so has the place -1."""
    if "<table" not in text:
        return []
    parser, out, at, seen, passed = _Tables(), [], 0, 0, 0
    parser.feed(text)
    parser.close()
    for rows in parser.tables:
        rows = [r for r in rows if r]
        if rows:
            start = text.find("<table", at)
            if start >= 0:
                passed += len(text[seen:start].encode())
                at, seen = start + 6, start
            out.append(Block(1, f"Table {len(out) + 1}", table(rows), 1.0, passed if start >= 0 else -1))
    return out


def record_series(text: str) -> list[Block]:
    """Runs of "Stem #N" headers of one stem with "Key: value" lines; columns are the most frequent set of keys."""
    lines, offset, records, run = text.split("\n"), 0, [], []
    for line in lines:
        if m := HEADER.match(line):
            records.append((m[1].strip(), m[2], {}, offset))
        elif records and (m := FIELD.match(line)):
            records[-1][2].setdefault(m[1].strip(), m[2].strip())
        offset += len(line.encode()) + 1
    out: list[Block] = []
    for record in [*records, None]:
        if run and (record is None or record[0].casefold() != run[0][0].casefold()):
            full = [r for r in run if r[2]]
            if len(full) >= LEAST_RECORDS:
                sets = Counter(frozenset(r[2]) for r in full)
                modal, count = sets.most_common(1)[0]
                if count / len(full) >= LEAST_CONFIDENCE:
                    keys = list(next(r[2] for r in full if frozenset(r[2]) == modal))
                    rows = [["#", *keys], *([r[1], *(r[2].get(k, "") for k in keys)] for r in full)]
                    out.append(Block(2, run[0][0], table([[c.replace("|", r"\|") for c in row] for row in rows]), int(count / len(full) * 100 + 0.5) / 100, run[0][3]))
            run = []
        if record:
            run.append(record)
    return out


def markdown_blocks(text: str) -> list[Block]:
    """T01 on one text."""
    lines, offsets, fenced, out, k = text.split("\n"), [0], False, [], 0
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    is_row = lambda i: i < len(lines) and re.match(ROW, lines[i])
    while k < len(lines):
        if re.match(r"^\s*(```|~~~)", lines[k]):
            fenced = not fenced
        elif not fenced and is_row(k) and k + 1 < len(lines) and re.match(SEPARATOR, lines[k + 1]) and "-" in lines[k + 1]:
            end = k + 2
            while is_row(end):
                end += 1
            out.append(Block(0, f"Table {len(out) + 1}", "\n".join(x.strip() for x in lines[k:end]), 1.0, offsets[k]))
            k = end - 1
        k += 1
    return out


def extract(text: str) -> list[Block]:
    """All blocks by place, confidence and kind; of one place the first, of one text the first.

    A place is only taken by a block that stays. A table without a place (-1)
    never stays, as -1 counts as taken.
    """
    blocks = sorted(markdown_blocks(text) + html_tables(text) + record_series(text), key=lambda b: (b.start, -b.confidence, b.kind))
    out, seen, taken = [], set(), -1
    for b in blocks:
        if b.start != taken and b.markdown not in seen:
            seen.add(b.markdown)
            out.append(b)
            taken = b.start
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("start", T.IntegerType())])))
def extract_udf(text: pd.Series) -> pd.Series:
    return text.fillna("").map(lambda t: [b._asdict() for b in extract(t)])
