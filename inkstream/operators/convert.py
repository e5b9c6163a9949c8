"""Documents of every format to MDX: stages of column expressions and converters by format."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import persian, rx
from inkstream.operators import blocks


@dataclass(frozen=True)
class TextStage:
    """One step of a pipeline: ``expr`` rewrites texts that ``predicate`` lets through; lower priorities run first."""

    name: str
    priority: int
    expr: Callable[[Column], Column]
    predicate: Callable[[Column], Column] = lambda t: F.lit(True)


#: The stages of the engine, in no order.
STAGES = (
    TextStage("math", 20, blocks.to_mdx_math, lambda t: t.contains("\\") | t.contains("$")),
    TextStage("links", 30, blocks.to_mdx_links, lambda t: t.contains("\\") | t.contains("<a")),
    TextStage("letters", 90, lambda t: persian.outside_protected(t, persian.fix_letters), lambda t: rx.has(t, persian.PERSIAN)),
)


def run_stages(df: DataFrame, text: str, stages: tuple[TextStage, ...] = STAGES, trace: str | None = None) -> DataFrame:
    """``df`` with ``text`` rewritten by ``stages`` in order of priority; ``trace`` names a column of lengths by stage."""
    steps = []
    for stage in sorted(stages, key=lambda s: s.priority):
        before = F.col(text)
        df = df.withColumn(text, F.when(stage.predicate(before), stage.expr(before)).otherwise(before))
        if trace:
            df = df.withColumn(f"__{stage.name}", F.length(text))
            steps.append(F.struct(F.lit(stage.name).alias("stage"), F.col(f"__{stage.name}").alias("n_chars")))
    if trace:
        df = df.withColumn(trace, F.array(*steps)).drop(*(f"__{s.name}" for s in stages))
    return df


def markdown_to_mdx(text: Column) -> Column:
    """Images and callouts as components."""
    out = F.regexp_replace(text, blocks.MARKDOWN_IMAGE, '<Image src="$2" alt="$1" />')
    return F.regexp_replace(out, r"(?m)^>[ \t]*\[!([A-Z]+)\][ \t]*(.*)$", '<Callout type="$1">$2</Callout>')


def frontmatter(text: Column) -> Column:
    """Flat keys of the block at the start of a Markdown text, as a map."""
    block = F.regexp_extract(text, r"^---\n((?s).*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    keys = F.array_distinct(F.transform(lines, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))
    value = lambda k: F.regexp_replace(F.element_at(F.filter(lines, lambda x: x.startswith(F.concat(k, F.lit(":")))), -1), r"^[^:]*:[ ]*", "")
    return F.map_from_arrays(keys, F.transform(keys, value))


def to_mdx(df: DataFrame, key: str, text: str, fmt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, format, mdx, n_chars, status, *keep): every document converted by its format.

    LaTeX and HTML need a reader and go through one Arrow pass; the other
    formats are column expressions. A document that can't be converted keeps
    its text and has the status failed; null texts are empty. Columns in
    ``keep`` travel along, so nothing has to be joined to the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkstream.operators import html, latex

        readers = {"latex": latex.to_mdx, "html": html.to_mdx}
        for batch in batches:
            out, status = [], []
            for value, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                value = value.as_py() or ""
                try:
                    out.append(readers[kind](value))
                    status.append("success")
                except Exception:  # an error is a row
                    out.append(value)
                    status.append("failed")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string()), pa.array(status, pa.string())], names=[*batch.schema.names[1:], "mdx", "status"])

    kept = [F.col(c).alias(f"__keep_{c}") for c in keep]
    rows = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), F.coalesce(F.col(fmt), F.lit("plain")).alias("format"), F.col(key).alias("__key"), *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", mdx string, status string"
    read = rows.where(F.col("format").isin("latex", "html")).mapInArrow(run, schema)
    same = [f.name for f in rows.schema.fields[1:]]
    plain = rows.where(~F.col("format").isin("latex", "html")).select(*same, F.when(F.col("format") == "markdown", markdown_to_mdx(F.col("__text"))).otherwise(F.col("__text")).alias("mdx"), F.lit("success").alias("status"))
    out = run_stages(read.unionByName(plain), "mdx")
    return out.select(F.col("__key").alias(key), "format", "mdx", F.length("mdx").cast("bigint").alias("n_chars"), "status", *(F.col(f"__keep_{c}").alias(c) for c in keep))


def bidi_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_runs, n_rtl, n_ltr): runs of one direction; neutral characters belong to the run before."""
    marked = F.regexp_replace(F.regexp_replace(F.col(text), f"{persian.PERSIAN}+", "R"), "[A-Za-z\u00c0-\u024f]+", "L")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "[^RL]", ""), "R+", "R"), "L+", "L")
    return df.select(key, F.length(runs).cast("bigint").alias("n_runs"), rx.count(runs, "R").alias("n_rtl"), rx.count(runs, "L").alias("n_ltr"))
