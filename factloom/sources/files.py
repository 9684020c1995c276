"""Readers and writers of documents, chunk sets, fixtures, ledgers and reports."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_input
from ..operators.numbering import sums_before
from ..plans.tables import writer

# Caps on inputs.
MOST_BYTES, MOST_MANIFEST_BYTES = 100 << 20, 8 << 20
CHUNK_NAME = r"^[A-Za-z0-9_.-]+\.md$"


def read_documents(spark: SparkSession, paths: list[str], glob: str = "*.md") -> DataFrame:
    """(doc_id, path, text) of files; over 100 MiB is an error, each path counts once.

    Order: as the paths are named, then by name. Reading goes by Spark's own file
    systems, so any store that Spark reads will do.
    """
    parts = None
    for k, path in enumerate(paths):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        df = (reader if re.search(r"\.\w+$", path) else reader.option("pathGlobFilter", glob)).load(path).withColumn("spec", F.lit(k))
        parts = df if parts is None else parts.unionByName(df)
    if parts is None:
        raise ValueError("no paths")
    big = F.when(F.col("length") > MOST_BYTES, F.raise_error(F.concat(F.lit("over 100 MiB: "), "path")).cast("binary")).otherwise(F.col("content"))
    once = parts.groupBy("path").agg(F.min("spec").alias("spec"), F.first("length").alias("length"), F.first("content").alias("content"))
    text = normalize_input(F.decode(big, "UTF-8"))
    numbers = sums_before(once.select("spec", "path"), ["spec", "path"], {"doc_id": F.lit(1).cast("long")}, writer(spark))  # names alone are sorted
    return once.select("path", text.alias("text")).join(numbers.select("path", "doc_id"), "path").select("doc_id", "path", "text")


def concat_sources(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """One text of several sources under "# Source NN" headings; a single source has none."""
    numbered = docs.select("text", F.row_number().over(W.orderBy(order)).alias("n"), F.count("*").over(W.partitionBy()).alias("all"))
    part = F.when(F.col("all") == 1, F.col("text")).otherwise(F.concat(F.lit("# Source "), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("\n\n"), "text"))
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda s: s["t"]), "\n\n").alias("text"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_no, file, tokens, start_line, end_line, text) in the manifest's order; a bad manifest is an error."""
    schema = "source string, mode string, tokenizer string, token_counts_available boolean, chunks array<struct<file: string, tokens: int, start_line: int, end_line: int>>, total_tokens int, total_chunks int"
    one = spark.read.schema(schema).json(f"{folder}/manifest.json", multiLine=True)
    head = one.select("total_chunks", F.size("chunks").alias("n"), F.size(F.array_distinct("chunks.file")).alias("distinct"), F.exists("chunks", lambda c: ~c["file"].rlike(CHUNK_NAME)).alias("odd")).first()
    if head is None or head.n < 1 or head.n != head.total_chunks or head.n != head.distinct or head.odd:
        raise ValueError(f"bad manifest in {folder}: {head}")
    rows = one.select(F.posexplode("chunks").alias("chunk_no", "c")).select("chunk_no", "c.*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"))
    return rows.join(files, "file", "left").select("chunk_no", "file", "tokens", "start_line", "end_line", F.coalesce("text", F.raise_error(F.concat(F.lit("no file "), "file")).cast("string")).alias("text"))


def read_chunk_set(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, text) of chunk-*.md."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "chunk-*.md").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("chunk_id"), F.decode("content", "UTF-8").alias("text"))


#: Schemas of fixtures and the name of the id that must be there and be unique.
FIXTURES = {
    "golden": ("chunk string, facts array<struct<id: string, anchors: array<string>, any: array<array<string>>>>", "facts.id"),
    "labels": ("task string, allowed_labels array<string>, cost_per_mtok map<string,double>, items array<struct<id: string, text: string, gold_label: string>>", "items.id"),
    "code": ("cost_per_mtok map<string,double>, problems array<struct<id: string, prompt: string, signature: string, func_name: string, cases: array<struct<call: string, want: string>>, harness: string>>", "problems.id"),
    "trace": ("cost_per_mtok map<string,double>, tasks array<struct<id: string, category: string, program: string, gold: string>>", "tasks.id"),
    "comedy": ("style string, topics array<struct<id: string, brief: string>>", "topics.id"),
    "checks": ("tensions array<struct<id: string, both: array<array<string>>>>, hygiene struct<preamble: array<string>, artifacts: array<string>>, wordBand struct<min: int, max: int>, fabrications array<string>", "tensions.id"),
}


def read_fixture(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A fixture's file; blank or repeated ids are an error."""
    schema, ids = FIXTURES[kind]
    df = spark.read.schema(schema).json(path, multiLine=True)
    bad = df.where((F.size(F.array_distinct(ids)) != F.size(ids)) | F.exists(ids, lambda i: i.isNull() | (F.trim(i) == ""))).count()
    if bad:
        raise ValueError(f"{path}: ids are blank or repeated")
    return df


def select_tasks(tasks: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Tasks by id; an unknown id or an empty choice is an error."""
    named = [*(only or []), *(skip or [])]
    known = {r.id for r in tasks.where(F.col("id").isin(named)).select("id").collect()} if named else set()
    if unknown := set(named) - known:
        raise ValueError(f"unknown tasks {sorted(unknown)}")
    out = tasks.where(F.col("id").isin(only)) if only else tasks
    out = out.where(~F.col("id").isin(skip)) if skip else out
    if not out.take(1):
        raise ValueError("no tasks are left")
    return out


def overlay(defaults: dict, *layers: dict) -> dict:
    """Settings over defaults, nested ones too; an unknown name is an error."""
    out = dict(defaults)
    for layer in layers:
        for k, v in layer.items():
            if k not in out:
                raise KeyError(k)
            out[k] = overlay(out[k], v) if isinstance(out[k], dict) and isinstance(v, dict) else v
    return out


def upsert_config(text: str, values: dict[str, tuple[str, str]]) -> str:
    """S25 S26: "key: value  # note" lines are set, other lines stay; new keys go to the end."""
    lines, left = text.split("\n"), dict(values)
    for k, line in enumerate(lines):
        if (m := re.match(r"([A-Za-z_][\w-]*)\s*:", line)) and m[1] in left:
            value, note = left.pop(m[1])
            lines[k] = f"{m[1]}: {value}  # {note}"
    tail = [f"{k}: {v}  # {note}" for k, (v, note) in left.items()]
    while tail and lines and not lines[-1]:
        lines.pop()
    return "\n".join([*lines, *tail, *[""] * bool(tail)])


def leaderboard(cells: DataFrame, model_column: int, score_column: int) -> DataFrame:
    """(model, score) of pipe-table lines (line), by columns from 0; the fetch itself is outside the engine."""
    from ..functions.text import first_number, pipe_cells

    rows = cells.select(pipe_cells(F.col("line")).alias("c")).where(f"size(c) > {max(model_column, score_column)}")
    return rows.select(F.col("c")[model_column].alias("model"), first_number(F.col("c")[score_column]).alias("score")).where("score is not null")


def credits_of(payload: DataFrame) -> DataFrame:
    """(pos, credit) of a JSON payload under credits, data or items, and the count that is told or else counted."""
    schema = "struct<credits: array<map<string,string>>, data: array<map<string,string>>, items: array<map<string,string>>, available_count: int>"
    p = payload.select(F.from_json("value", schema).alias("p")).select(F.coalesce("p.credits", "p.data", "p.items").alias("c"), "p.available_count")
    return p.select(F.coalesce("available_count", F.size("c")).alias("available"), F.posexplode("c").alias("pos", "credit"))


def write_chunks(chunks: DataFrame, folder: str, mode: str, source: str) -> None:
    """A generation of chunks and its manifest's rows; a folder that is there is an error, and Spark's commit publishes all or nothing."""
    chunks.write.mode("errorifexists").parquet(f"{folder}/chunks")
    rows = chunks.select(F.format_string("%03d.md", "chunk_no").alias("file"), F.ceil(F.length("text") / 4).cast("int").alias("tokens"))
    rows.withColumns({"source": F.lit(source), "mode": F.lit(mode)}).write.mode("errorifexists").json(f"{folder}/manifest")


def append_events(events: DataFrame, folder: str) -> None:
    """An append-only JSONL ledger."""
    events.write.mode("append").json(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    """One row of JSON."""
    summary.coalesce(1).write.mode("overwrite").json(folder)


def publish(articles: DataFrame, folder: str, gate: str = "gate") -> tuple[int, int]:
    """Passing articles and the others, written apart; (published, held back)."""
    passed, held = articles.where(F.col(gate).isNull()), articles.where(F.col(gate).isNotNull())
    passed.write.mode("overwrite").parquet(f"{folder}/published")
    held.write.mode("overwrite").parquet(f"{folder}/held")
    read = articles.sparkSession.read.parquet
    return read(f"{folder}/published").count(), read(f"{folder}/held").count()


def under(folder: str, path: str) -> str:
    """The real path if it is inside the folder; else an error."""
    import os

    base, full = os.path.realpath(folder), os.path.realpath(os.path.join(folder, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} leaves {folder}")
    return full


def render_table(df: DataFrame, title: str, kind: str = "markdown", most: int = 1000) -> str:
    """A ranked result as a Markdown or HTML report; reports are for people, so a longer result is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    shown = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v)) for v in r] for r in rows]
    if kind == "html":
        cell = lambda tag, v: f"<{tag}>{html.escape(v)}</{tag}>"
        body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in shown)
        return f"<h1>{html.escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>{body}</table>"
    line = lambda r: "| " + " | ".join(v.replace("|", r"\|").replace("\n", " ") for v in r) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, shown)])


def endpoint_of(model: str, profiles: dict[str, str], default: str) -> str:
    """The provider whose prefix the model's name has, the longest one."""
    return max(((p, name) for p, name in profiles.items() if model.startswith(p)), default=("", default))[1]


def prompts_refresh(user: dict[str, str], last_default: dict[str, str], default: dict[str, str]) -> dict[str, str]:
    """A user's template is renewed only if it is still the last default."""
    return {k: (v if k not in user or user[k] == last_default.get(k) else user[k]) for k, v in default.items()}


# Modules and calls that untrusted code may not use.
BANNED_IMPORTS = frozenset("os sys subprocess socket shutil ctypes multiprocessing threading signal pathlib importlib urllib http requests".split())
BANNED_CALLS = frozenset("eval exec compile open __import__ input breakpoint".split())


def unsafe_reason(code: str) -> str | None:
    """Why Python code may not run; code that doesn't parse counts as safe, as it can't run either. Nothing is executed."""
    import ast

    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return None
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        for name in names:
            if name.split(".")[0] in BANNED_IMPORTS:
                return f"import {name}"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in BANNED_CALLS:
            return f"call {node.func.id}"
    return None
