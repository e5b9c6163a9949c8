"""Queries on cleaning rules, macros, anchors and cross references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import latex_text as L
from inkstream.functions import rx, slugs
from inkstream.operators import blocks as B
from inkstream.sources.tables import spread, table


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("node_uid", "doc_id", F.coalesce("body", "content").alias("t")).where(F.col("t").contains("\\")).distinct()


def removed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of nodes that cleaning removes."""
    n = _bodies(spark, sf_dir)
    # one pass: each text gives its commands before and after
    counted = lambda c, b, a: F.transform(c, lambda x: F.struct(x.alias("command"), F.lit(b).alias("b"), F.lit(a).alias("a")))
    both = n.select(F.inline(F.concat(counted(L.commands(F.col("t")), 1, 0), counted(L.commands(L.clean(F.col("t"))), 0, 1))))
    return both.groupBy("command").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after")).where("n_before > n_after")


def cleaned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every node before and after cleaning."""
    return _bodies(spark, sf_dir).select("node_uid", F.length("t").cast("bigint").alias("n_before"), F.length(L.clean(F.col("t"))).cast("bigint").alias("n_after"), L.saved(F.length("t"), F.length(L.clean(F.col("t")))).alias("saved"))


def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles of LaTeX documents as plain text and as slugs."""
    d = spread(table(spark, sf_dir, "documents")).where("source_format = 'latex'").select("doc_id", F.regexp_extract("text", r"\\title\{((?:[^{}]|\{[^{}]*\})*)\}", 1).alias("t")).where("t <> ''")
    return d.select("doc_id", L.title(F.col("t")).alias("title"), slugs.metadata_slug(F.col("t")).alias("slug"))


def macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros that nodes define, and how often their document uses each; none is expanded."""
    n = _bodies(spark, sf_dir)
    defined = n.select("doc_id", F.explode(rx.every(F.col("t"), L.MACRO, 1)).alias("macro")).groupBy("doc_id", "macro").agg(F.count("*").alias("n_defined"))
    used = n.select("doc_id", F.explode(L.commands(F.col("t"))).alias("macro")).groupBy("doc_id", "macro").agg(F.count("*").alias("n_used"))
    return defined.join(used, ["doc_id", "macro"], "left").select("doc_id", "macro", "n_defined", F.coalesce("n_used", F.lit(0)).alias("n_used"))


def direction_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes with direction commands as HTML."""
    return _bodies(spark, sf_dir).where(F.col("t").rlike(r"\\(lr|textLR|LRE|rl|textRL|RLE)\{")).select("node_uid", L.direction_spans(F.col("t")).alias("mdx"))


def numbered_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with LaTeX footnotes after conversion."""
    return _bodies(spark, sf_dir).where(F.col("t").contains("\\footnote{")).select("node_uid", L.footnotes(F.col("t")).alias("mdx"))


def right_to_left_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as right-to-left pages."""
    c = table(spark, sf_dir, "chapters").where("mdx_content is not null").select("chapter_id", F.col("mdx_content").alias("t"), L.rtl(F.col("mdx_content")).alias("p"))
    return c.select("chapter_id", F.col("p").startswith("---\ndir: rtl\nlang: fa\n").alias("has_head"), rx.count(F.col("p"), '<div dir="ltr">').alias("n_wrapped"), F.length("p").cast("bigint").alias("n_chars"))


def broken_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of chapters to anchors that no heading or label of their document has."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", "doc_id", F.col("mdx_content").alias("text"), "labels")
    heads = B.headings(c, "chapter_id", "text").join(c.select("chapter_id", "doc_id"), "chapter_id").select("doc_id", slugs.ascii_slug(F.col("title"), F.lit("")).alias("anchor"))
    anchors = heads.unionByName(c.select("doc_id", F.explode("labels").alias("anchor", "target")).select("doc_id", "anchor")).where("anchor <> ''").distinct()
    refs = B.blocks(c, "chapter_id", "text", B.REF, "command", "anchor").join(c.select("chapter_id", "doc_id"), "chapter_id").select("doc_id", "chapter_id", "anchor").distinct()
    return refs.join(anchors, ["doc_id", "anchor"], "left_anti").select("chapter_id", "anchor")


def cross_chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one chapter that another chapter of the same document has too; the last chapter's counts."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", "doc_id", "chapter_order", F.explode("labels").alias("label", "target"))
    owner = c.groupBy("doc_id", "label").agg(F.max_by("chapter_id", F.struct("chapter_order", "chapter_id")).alias("owner"), F.countDistinct("chapter_id").alias("n_chapters"))
    return owner.groupBy(F.col("n_chapters") > 1).agg(F.count("*").alias("n_labels"), F.max("owner").alias("last_owner")).select(F.col("(n_chapters > 1)").alias("shared"), "n_labels", "last_owner")


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names of the images of every document's figures, numbered in order."""
    n = table(spark, sf_dir, "nodes").where("name = 'figure' and body is not null").select("node_uid", "doc_id", F.regexp_extract("body", B.GRAPHIC, 2).alias("src")).distinct().where("src <> ''")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("node_uid"))
    return n.select("node_uid", "src", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("-fig-"), number.cast("string"), F.regexp_extract("src", r"(\.[A-Za-z]+)$", 1)).alias("target"))


QUERIES = {f.__name__: f for f in (removed_commands, cleaned_nodes, plain_titles, macros, direction_spans, numbered_footnotes, right_to_left_pages, broken_anchors, cross_chapter_labels, image_names)}

_BODIES = "(SELECT DISTINCT node_uid, doc_id, coalesce(body, content) AS t FROM nodes WHERE contains(coalesce(body, content), chr(92)))"
_TITLE = r"regexp_extract(text, '\\title\{((?:[^{}]|\{[^{}]*\})*)\}', 1)"
SQL = {
    "macros": f"""WITH d AS (SELECT doc_id, macro, count(*) AS n_defined FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{L.MACRO}', 1)) AS macro FROM {_BODIES}) GROUP BY 1, 2),
u AS (SELECT doc_id, macro, count(*) AS n_used FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\\\([a-zA-Z]+)', 1)) AS macro FROM {_BODIES}) GROUP BY 1, 2)
SELECT d.doc_id, d.macro, n_defined, coalesce(n_used, 0) AS n_used FROM d LEFT JOIN u ON d.doc_id IS NOT DISTINCT FROM u.doc_id AND d.macro = u.macro""",
    "direction_spans": f"""SELECT node_uid, regexp_replace(regexp_replace(t, '\\\\(?:lr|textLR|LRE)\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', '<span dir="ltr">\\1</span>', 'g'), '\\\\(?:rl|textRL|RLE)\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', '<span dir="rtl">\\1</span>', 'g') AS mdx
FROM {_BODIES} WHERE regexp_matches(t, '\\\\(lr|textLR|LRE|rl|textRL|RLE)\\{{')""",
    "cross_chapter_labels": """WITH c AS (SELECT chapter_id, doc_id, chapter_order, unnest(map_keys(labels)) AS label FROM chapters),
o AS (SELECT doc_id, label, arg_max(chapter_id, CAST(chapter_order AS BIGINT) * 1000000000 + chapter_id) AS owner, count(DISTINCT chapter_id) AS n FROM c GROUP BY 1, 2) SELECT n > 1 AS shared, count(*) AS n_labels, max(owner) AS last_owner FROM o GROUP BY 1""",
    "image_names": r"""WITH n AS (SELECT DISTINCT node_uid, doc_id, regexp_extract(body, '\\includegraphics(?:\[([^\]]*)\])?\{([^}]+)\}', 2) AS src FROM nodes WHERE name = 'figure' AND body IS NOT NULL)
SELECT node_uid, src, 'doc-' || doc_id || '-fig-' || row_number() OVER (PARTITION BY doc_id ORDER BY node_uid) || regexp_extract(src, '(\.[A-Za-z]+)$', 1) AS target FROM n WHERE src <> ''""",
}
