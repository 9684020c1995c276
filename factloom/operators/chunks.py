"""Chunking: texts into ordered, losslessly joined pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentences import split_sentences
from ..functions.text import cosine
from .completion import embed
from .numbering import sums_before

HEADING = r"^#{1,6}[\t ]+[^\t\n\f\r ]"
FENCE = r"^[\t ]*(```|~~~)"
CHARS_PER_TOKEN = 4


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files are too few and too small for that, for what is slow by row; a large table stays as it is."""
    spark = rows.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not 0 < len(files) < cores:
        return rows
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return rows.repartition(cores) if size < cores * split else rows


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, fenced): whether a line is inside a code fence or one of its marks."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    marks = F.sum(F.col("line").rlike(FENCE).cast("int")).over(W.partitionBy(id_col).orderBy("line_no"))
    return rows.withColumn("fence", F.col("line").rlike(FENCE)).withColumn("fenced", F.col("fence") | (marks % 2 == 1)).drop("fence")


def heading_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, heading, text): a chunk begins at each heading outside a fence; blank lines at its ends go."""
    lines = lines_of(docs, id_col, text_col)
    heads = (F.col("line").rlike(HEADING) & ~F.col("fenced")).cast("int")
    numbered = lines.withColumn("chunk_no", F.sum(heads).over(W.partitionBy(id_col).orderBy("line_no")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"^(?:[\t\f\r ]*\n)+", ""), r"[\t\n\f\r ]+$", "")
    rows = numbered.groupBy(id_col, "chunk_no").agg(trimmed.alias("text"), F.min_by("line", "line_no").alias("heading"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return rows.where("text <> ''")


def heading_skeleton(docs: DataFrame, most: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first heading lines of each document; the limit is the skeleton's size."""
    heads = lines_of(docs, id_col, text_col).where(F.col("line").rlike(HEADING) & ~F.col("fenced"))
    return heads.withColumn("n", F.row_number().over(W.partitionBy(id_col).orderBy("line_no"))).where(F.col("n") <= most).drop("n", "fenced")


def bounded_fragments(text: Column, size: int) -> Column:
    """An array of pieces of ``size`` characters, the last one shorter; they join to the text."""
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(cuts, lambda k: F.substring(text, k * size + 1, F.lit(size))))


def _dense(text: str, size: int) -> list[str]:
    """Lines, cut where longer than ``size``, joined greedily up to it."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    return pack([line[k : k + size] for line in lines for k in range(0, len(line), size)], size)


def heading_pieces(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece_no, level, heading, text, characters): sections of at most ``size`` characters, as large as they can be.

    Headings outside code fences make a tree: the parent of one is the nearest
    before it of a lower level, and its section ends where the next of its level
    or a lower one begins. A section that fits is a piece. Of one that doesn't,
    what stands before its first child is a piece, and its children are judged
    by themselves; so are the children of a title, the only heading without a
    parent. As a section is never larger than its parent's, a heading begins a
    piece just if it has no parent or its parent doesn't fit: one look, no
    recursion. A piece that is still too large is packed densely, by lines, or
    characters within a line that is too long. Pieces join to the text.

    Ids are unique. Null and empty texts have no piece. Texts are shuffled once, by id.
    """
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?md)(?=^#{1,6}[\t ]+[^\t\n\f\r ])")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("pos", "part")).where("part <> ''")
    asc = W.partitionBy("id").orderBy("pos")
    before, desc, whole = asc.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("id")
    marked = rows.repartition("id").select("*", F.length("part").alias("chars"), F.length(F.regexp_extract("part", r"^(#{1,6})[\t ]+[^\t\n\f\r ]", 1)).alias("marks"), F.regexp_count("part", F.lit(r"(?md)^[\t ]*(?:```|~~~)")).alias("fences"))
    inside = F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2 == 1
    marked = marked.select("id", "pos", "part", "chars", F.when((F.col("marks") > 0) & ~inside, F.col("marks")).alias("level"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"), F.sum("chars").over(whole).alias("total"))
    level, levels = F.col("level"), range(1, 7)
    pick = lambda of: F.coalesce(*(F.when(level == k, of(k)) for k in levels))
    ended = marked.withColumn("stop", F.coalesce(pick(lambda k: F.min(F.when(level <= k, F.col("start"))).over(desc)), F.col("total")))
    own = F.struct("start", (F.col("stop") - F.col("start")).alias("chars"))
    tree = ended.withColumn("parent", pick(lambda k: F.max(F.when(level < k, own)).over(before)))
    top = level.isNotNull() & F.col("parent").isNull()
    tree = tree.withColumn("title", F.when(F.count_if(top).over(whole) == 1, F.min(F.when(top, F.col("start"))).over(whole)))
    begins = F.coalesce(top | (F.col("parent.chars") > size) | (F.col("parent.start") == F.col("title")), F.lit(False)) | (F.row_number().over(asc) == 1)
    numbered = tree.withColumn("section", F.sum(begins.cast("int")).over(asc))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), "")
    sections = numbered.groupBy("id", "section").agg(F.min_by("level", "pos").alias("level"), text.alias("text"))

    @F.pandas_udf("array<string>")
    def dense(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else _dense(t, size))

    fits = F.length("text") <= size
    found = sections.select("id", "section", "level", F.posexplode(F.when(fits, F.array("text")).otherwise(dense(F.when(~fits, F.col("text"))))).alias("n", "text"))
    heading = F.when(F.col("n") == 0, F.when(F.col("level").isNotNull(), F.substring_index("text", "\n", 1)))
    number = F.row_number().over(W.partitionBy("id").orderBy("section", "n"))
    return found.select(F.col("id").alias(id_col), number.alias("piece_no"), "level", heading.alias("heading"), "text", F.length("text").alias("characters"))


def pack_sources(docs: DataFrame, size: int, write: Callable[[DataFrame], DataFrame], most_tokens: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of all sources as one run: (source, id, number, chunk_id, text, characters, tokens, sha256).

    Heading pieces of a source join greedily; one that would exceed ``size``
    characters or ``most_tokens`` begins the next chunk, and no chunk holds two
    sources. Sources stand in the order of their ids, and chunks are numbered over
    all of them: numbers within a source come from its own pieces, those before it
    from sums over ranges of sources (``sums_before``). A source without text has
    a place, but no chunk. Chunks join to the text (``covers``).
    """
    limit = min(size, CHARS_PER_TOKEN * most_tokens) if most_tokens else size  # tokens are estimated by characters

    @F.pandas_udf("array<int>")
    def chunk_numbers(lengths: pd.Series) -> pd.Series:
        def one(sizes: list[int]) -> list[int]:
            out, number, filled = [], 0, 0
            for n in sizes:
                if not number or filled + n > limit:
                    number, filled = number + 1, 0
                filled += n
                out.append(number)
            return out

        return lengths.map(one)

    pieces = write(heading_pieces(docs, limit, id_col, text_col))
    lengths = F.array_sort(F.collect_list(F.struct("piece_no", "characters")))
    placed = pieces.groupBy(id_col).agg(lengths.alias("pieces")).withColumn("numbers", chunk_numbers(F.col("pieces.characters")))
    counts = docs.select(id_col).join(placed.select(id_col, F.array_max("numbers").alias("chunks")), id_col, "left").na.fill(0, ["chunks"])
    first = sums_before(counts, [id_col], {"sources_before": F.lit(1), "chunks_before": F.col("chunks")}, write)
    chunk_of = placed.select(id_col, F.explode(F.arrays_zip(F.col("pieces.piece_no").alias("piece_no"), F.col("numbers").alias("chunk_no"))).alias("z")).select(id_col, "z.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda s: s["text"]), "")
    chunks = pieces.join(chunk_of, [id_col, "piece_no"]).groupBy(id_col, "chunk_no").agg(text.alias("text"))
    number = F.col("chunks_before") + F.col("chunk_no")
    return chunks.join(first, id_col).select(
        (F.col("sources_before") + 1).alias("source"), id_col, "chunk_no", number.alias("number"), F.format_string("chunk-%03d", number).alias("chunk_id"), "text",
        F.length("text").alias("characters"), F.ceil(F.length("text") / CHARS_PER_TOKEN).alias("tokens"), F.sha2("text", 256).alias("sha256"),
    )


def pack(fragments: Iterable[str], size: int, most_tokens: int = 0, count: Callable[[str], int] | None = None) -> list[str]:
    """Fragments join greedily; one that would exceed characters or tokens begins the next chunk."""
    out: list[str] = []
    for fragment in fragments:
        if out:
            joined = out[-1] + fragment
            if len(joined) <= size and not (most_tokens and count and count(joined) > most_tokens):
                out[-1] = joined
                continue
        if fragment:
            out.append(fragment)
    return out


def pack_documents(docs: DataFrame, size: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, chunk_id, text, characters, sha256), packed from lines, or windows where a line is too long.

    The fold is inside one text, so it runs as a vectorized function of the text:
    no shuffle. Chunks join to the text, which ``covers`` checks.
    """
    @F.pandas_udf("array<string>")
    def packed(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: _dense(t, size))

    rows = docs.select(id_col, F.posexplode(packed(F.col(text_col))).alias("pos", "text"))
    return rows.select(id_col, (F.col("pos") + 1).alias("chunk_no"), F.format_string("chunk-%03d", F.col("pos") + 1).alias("chunk_id"), "text", F.length("text").alias("characters"), F.sha2("text", 256).alias("sha256"))


def line_spans(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunks`` (id, chunk_no, text) with start_line and end_line in their source, from 1; 0 and 0 if it doesn't hold them.

    Each chunk of a source is looked for from just behind the start of the last
    one found, so that chunks may overlap, and equal ones don't share a place.
    """
    @F.pandas_udf("array<struct<start_line: int, end_line: int>>")
    def spans(text: pd.Series, parts: pd.Series) -> pd.Series:
        def one(source: str, pieces: list[str]) -> list[tuple[int, int]]:
            out, cursor, at, line = [], 0, 0, 1  # ``line`` is that of the character at ``at``
            for piece in pieces:
                found = source.find(piece, cursor) if piece else -1
                if found < 0:
                    out.append((0, 0))
                    continue
                line, at, cursor = line + source.count("\n", at, found), found, found + 1
                out.append((line, line + piece.count("\n", 0, len(piece) - 1)))
            return out

        return pd.Series([one(t or "", list(p)) for t, p in zip(text, parts, strict=True)])

    ordered = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    rows = ordered.join(docs.select(id_col, F.col(text_col).alias("source_text")), id_col).withColumn("s", spans("source_text", F.col("c.text")))
    zipped = rows.select(id_col, F.explode(F.arrays_zip("c", "s")).alias("z"))
    return zipped.select(id_col, F.col("z.c.chunk_no").alias("chunk_no"), F.col("z.c.text").alias("text"), F.col("z.s.start_line").alias("start_line"), F.col("z.s.end_line").alias("end_line"))


def covers(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose chunks don't join to their text; empty if all do."""
    joined = chunks.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]), "").alias("joined"))
    return docs.join(joined, id_col, "left").where(F.coalesce("joined", F.lit("")) != F.coalesce(text_col, F.lit(""))).select(id_col)


def sentence_chunks(text: str, size: int) -> list[str]:
    """Sentences join by a space up to the size; a longer sentence is cut."""
    pieces = [s[k : k + size] for s in split_sentences(text) for k in range(0, len(s), size)]
    out: list[str] = []
    for s in pieces:
        if out and len(out[-1]) + 1 + len(s) <= size:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def limit_tokens(chunks: list[str], most: int, count: Callable[[str], int]) -> list[str]:
    """Chunks over the token limit are halved at white space where there is any, until none is."""
    out = []
    for c in chunks:
        if count(c) <= most or len(c) < 2:
            out.append(c)
            continue
        mid = c.rfind(" ", 1, len(c) // 2 + 1)
        mid = mid if mid > 0 else len(c) // 2
        out += limit_tokens([c[:mid], c[mid:]], most, count)
    return out


def with_overlap(chunks: DataFrame, overlap: int, by: str = "doc_id") -> DataFrame:
    """Each chunk begins with the last ``overlap`` characters of the one before."""
    before = F.lag("text").over(W.partitionBy(by).orderBy("chunk_no"))
    return chunks.withColumn("text", F.concat(F.coalesce(F.right(before, F.lit(overlap)), F.lit("")), F.col("text")))


def semantic_breaks(rows: DataFrame, by: str, order: str, similarity: Column, width: int = 1, threshold: float = 0.3) -> DataFrame:
    """``rows`` with smoothed similarity to the row before, break flag and group number.

    ``similarity`` compares a row with its predecessor (use ``F.lag``); null
    begins a group.
    """
    w = W.partitionBy(by).orderBy(order)
    smooth = F.avg("similarity").over(w.rowsBetween(-width, width))
    out = rows.withColumn("similarity", similarity).withColumn("smooth", smooth)
    return out.withColumn("breaks", (F.col("similarity").isNull() | (F.col("smooth") < threshold)).cast("int")).withColumn("part", F.sum("breaks").over(w))


def constrained(chars: list[int], near: list[float], breaks: list[int], least: int, most: int, gap: int = 1) -> list[int]:
    """The segment of each paragraph, from 0, where ``breaks`` begin segments and ``near`` is each one's similarity to the one before.

    A segment of under ``least`` characters, ``gap`` between paragraphs counted,
    joins the neighbour to which its border is more similar (the one before, if
    they are as similar), from the first on, until none is left or all are one. Then
    a segment of over ``most`` is cut at its least similar border, the first of
    several, until it fits or is one paragraph: the upper limit has the last word.
    """
    before = [0]
    for n in chars:
        before.append(before[-1] + n + gap)
    size = lambda a, b: before[b] - before[a] - gap
    starts = [k for k in range(len(chars)) if k == 0 or breaks[k]] + [len(chars)]
    k = 0
    while k < len(starts) - 1:
        if size(starts[k], starts[k + 1]) >= least or len(starts) == 2:
            k += 1
            continue
        left = near[starts[k]] if k else -2.0
        right = near[starts[k + 1]] if k + 2 < len(starts) else -2.0
        if left >= right:
            del starts[k]
            k -= 1
        else:
            del starts[k + 1]
    out, open_ = [0] * len(chars), [(a, b) for a, b in zip(starts, starts[1:], strict=False)]
    cuts = set()
    while open_:
        a, b = open_.pop()
        cuts.add(a)
        if size(a, b) > most and b - a > 1:
            at = min(range(a + 1, b), key=lambda i: (near[i], i))
            open_ += [(a, at), (at, b)]
    number = -1
    for i in range(len(chars)):
        number += i in cuts
        out[i] = number
    return out


def semantic_chunks(
    docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], least: int = 200, most: int = 4000, width: int = 1, threshold: float = 0.3, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, chunk_no, text, characters, paragraphs): paragraphs that belong together, ``least`` to ``most`` characters where they can be.

    Paragraphs are embedded; a chunk ends where the smoothed similarity of
    neighbours is under ``threshold`` (``semantic_breaks``), and its size is then put
    right (``constrained``). An embedder that fails is an error: no other
    strategy stands in for it. Chunks join by ``separator`` to the text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), re.escape(separator))).alias("pos", "text"))
    vectors = embed(rows, embedder)
    lag = F.lag("embedding").over(W.partitionBy("id").orderBy("pos"))
    found = semantic_breaks(vectors, "id", "pos", F.when(lag.isNotNull(), cosine(F.col("embedding"), lag)), width, threshold)

    @F.pandas_udf("array<int>")
    def segments(chars: pd.Series, near: pd.Series, breaks: pd.Series) -> pd.Series:
        return pd.Series([constrained(list(c), [-1.0 if x is None else float(x) for x in n], list(b), least, most, len(separator)) for c, n, b in zip(chars, near, breaks, strict=True)])

    ordered = F.array_sort(F.collect_list(F.struct("pos", "text", F.length("text").alias("chars"), F.coalesce("smooth", F.lit(-1.0)).alias("near"), "breaks")))
    whole = found.groupBy("id").agg(ordered.alias("p")).withColumn("segment", segments("p.chars", "p.near", "p.breaks"))
    each = whole.select("id", F.explode(F.arrays_zip(F.col("p.pos").alias("pos"), F.col("p.text").alias("text"), "segment")).alias("z")).select("id", "z.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), separator)
    chunks = each.groupBy("id", "segment").agg(text.alias("text"), F.count("*").alias("paragraphs"))
    return chunks.select(F.col("id").alias(id_col), (F.col("segment") + 1).alias("chunk_no"), "text", F.length("text").alias("characters"), "paragraphs")


def count_windows(rows: DataFrame, by: list[str], order: list[str], size: int = 80) -> DataFrame:
    """Batches of ``size`` rows, numbered over the whole group."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("n", n).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("int"))


def manifest(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Per document and over all: chunks, characters, estimated tokens."""
    tokens = F.ceil(F.length("text") / CHARS_PER_TOKEN)
    return chunks.groupingSets([[by], []], by).agg(F.count("*").alias("total_chunks"), F.sum("characters").alias("characters"), F.sum(tokens).alias("total_tokens"))
