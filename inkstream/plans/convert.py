"""Queries on conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import convert, latex, latex_tables
from inkstream.sources.tables import spread, table


def latex_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of LaTeX documents."""
    d = table(spark, sf_dir, "documents").where("source_format = 'latex'").select("doc_id", "text")
    return latex.nodes(spread(d), "doc_id", "text").drop("args", "opts")


def latex_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of LaTeX documents by kind and name."""
    return latex_nodes(spark, sf_dir).groupBy("kind", "name").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def documents_to_mdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as MDX."""
    return convert.to_mdx(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source_format")), "doc_id", "text", "source_format")


def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the frontmatter of Markdown documents."""
    d = table(spark, sf_dir, "documents").where("source_format = 'markdown'").select("doc_id", F.explode(convert.frontmatter(F.col("text"))).alias("name", "value"))
    return d


def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every chapter after each stage."""
    c = table(spark, sf_dir, "chapters").where("mdx_content is not null").select("chapter_id", F.col("mdx_content").alias("t"))
    return convert.run_stages(c, "t", trace="steps").select("chapter_id", F.inline("steps"))


def bidi_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one direction in text nodes."""
    n = table(spark, sf_dir, "nodes").where("kind = 'text' and content is not null").select("node_uid", "content").distinct()
    return convert.bidi_runs(n, "node_uid", "content")


def table_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX tables of nodes as models, rendered."""
    n = table(spark, sf_dir, "nodes").where("name in ('table', 'tabular', 'longtable') and body is not null").select("node_uid", "body").distinct()
    return latex_tables.tables(n, "node_uid", "body").drop("cells", "source")


def html_table_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables of documents and chapters as models, rendered."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    c = table(spark, sf_dir, "chapters").select((-F.col("chapter_id")).alias("row_id"), F.col("mdx_content").alias("text"))
    return latex_tables.tables(spread(d.unionByName(c).where("text like '%<table%'")), "row_id", "text").where("source = 'html'").drop("source", "kind", "caption", "label")


def preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, packages, title, author and number of macros of LaTeX documents."""
    d = table(spark, sf_dir, "documents").where("source_format = 'latex'").select("doc_id", "text")
    return latex.preambles(spread(d), "doc_id", "text")


QUERIES = {f.__name__: f for f in (latex_nodes, latex_node_counts, documents_to_mdx, frontmatter_fields, stage_trace, bidi_runs, table_models, html_table_models, preambles)}
SQL = {
    "table_models": r"""WITH b AS (SELECT DISTINCT node_uid, body FROM nodes WHERE name IN ('table', 'tabular', 'longtable') AND body IS NOT NULL),
t AS (SELECT node_uid, list_filter(list_transform(string_split(regexp_extract(body, '(?s)\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}', 1), '\\'), lambda l: trim(replace(l, chr(10), ' '))), lambda l: l <> '') AS l FROM b WHERE contains(body, '\begin{tabular}')),
r AS (SELECT node_uid, list_transform(l, lambda x: list_transform(string_split(x, '&'), lambda c: trim(c))) AS r FROM t)
SELECT node_uid, CAST(0 AS INT) AS table_no, 'tabular' AS kind, CAST(NULL AS VARCHAR) AS caption, CAST(NULL AS VARCHAR) AS label, CAST(list_max(list_transform(r, lambda x: len(x))) AS INT) AS n_columns, CAST(len(r) AS INT) AS n_rows, true AS is_simple,
 '| ' || array_to_string(r[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(r[1], lambda x: '---'), ' | ') || ' |' || array_to_string(list_transform(r[2:], lambda x: chr(10) || '| ' || array_to_string(x, ' | ') || ' |'), '') AS mdx FROM r""",
    "preambles": r"""SELECT doc_id, regexp_extract(text, '\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}', 1) AS document_class, list_transform(string_split(array_to_string(regexp_extract_all(text, '\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}', 1), ','), ','), lambda p: trim(p)).list_filter(lambda p: p <> '') AS packages,
 regexp_extract(text, '\\title\{([^{}]*)\}', 1) AS title, regexp_extract(text, '\\author\{([^{}]*)\}', 1) AS author, CAST(len(regexp_extract_all(regexp_replace(text, '(?s)\\begin\{(?:verbatim|lstlisting|minted)\}.*?\\end\{(?:verbatim|lstlisting|minted)\}', '', 'g'), '\\newcommand')) AS INT) AS n_macros FROM documents WHERE source_format = 'latex'""",
    "frontmatter_fields": r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_extract(text, '^---\n((?s).*?)\n---', 1), chr(10))) AS l FROM documents WHERE source_format = 'markdown')
SELECT doc_id, split_part(l, ':', 1) AS name, regexp_replace(l, '^[^:]*:[ ]*', '') AS value FROM l WHERE regexp_matches(l, '^[A-Za-z_][A-Za-z0-9_]*:')""",
    "bidi_runs": """WITH m AS (SELECT node_uid, regexp_replace(regexp_replace(content, '[؀-ۿݐ-ݿﭐ-﷿ﹰ-\ufeff]+', 'R', 'g'), '[A-Za-zÀ-ɏ]+', 'L', 'g') AS m FROM (SELECT DISTINCT node_uid, content FROM nodes WHERE kind = 'text' AND content IS NOT NULL)),
r AS (SELECT node_uid, regexp_replace(regexp_replace(regexp_replace(m, '[^RL]', '', 'g'), 'R+', 'R', 'g'), 'L+', 'L', 'g') AS r FROM m)
SELECT node_uid, length(r) AS n_runs, len(regexp_extract_all(r, 'R')) AS n_rtl, len(regexp_extract_all(r, 'L')) AS n_ltr FROM r""",
}
