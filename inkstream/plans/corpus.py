"""Queries on projects, chapters, runs and deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import detect
from inkstream.operators import corpus as C
from inkstream.sources.tables import spread, table


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of documents and environment bodies by kind and target."""
    texts = spread(table(spark, sf_dir, "documents")).select("doc_id", "text").unionByName(table(spark, sf_dir, "nodes").where("body is not null").select("doc_id", F.col("body").alias("text")).distinct())
    return C.dependencies(texts, "doc_id", "text").groupBy("kind", "target").agg(F.count("*").alias("n_edges"), F.countDistinct("doc_id").alias("n_docs"))


def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document reaches over the tree of its nodes."""
    n = table(spark, sf_dir, "nodes").where("parent_id is not null").select(F.concat_ws(":", "doc_id", "parent_id").alias("src"), F.concat_ws(":", "doc_id", "node_id").alias("dst"))
    return C.reachable(n).groupBy("depth").agg(F.count("*").alias("n_pairs"))


def project_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of every project."""
    d = spread(table(spark, sf_dir, "documents")).select("project_id", "doc_id", "path", F.coalesce("source_format", F.lit("")).alias("source_format"), detect.is_book(F.col("text")).alias("is_book"))
    return C.project_structure(d.where("project_id is not null"))


def structure_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by declared structure and main format, with and without documents."""
    d = spread(table(spark, sf_dir, "documents")).groupBy("project_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "projects").join(d, "project_id", "left").groupBy("structure_type", "main_format").agg(F.count("*").alias("n_projects"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.count_if(F.col("n").isNull()).alias("n_empty"))


def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of LaTeX documents."""
    return C.split_chapters(spread(table(spark, sf_dir, "documents")).where("source_format = 'latex'").select("doc_id", "text"), "doc_id", "text")


def series_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of every document as the ordered entries of a series."""
    c = table(spark, sf_dir, "chapters").select("doc_id", F.struct(F.col("chapter_order").alias("o"), F.coalesce("slug", F.lit("")).alias("s"), F.coalesce("title", F.lit("")).alias("t")).alias("c"))
    c = c.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return c.select("doc_id", F.size("cs").cast("bigint").alias("n_chapters"), F.array_join(F.transform("cs", lambda x: F.concat(x["o"].cast("string"), F.lit(":"), x["s"])), ",").alias("entries"))


def unreferenced_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image targets of environment bodies that no chapter names, by path or by stem."""
    body = table(spark, sf_dir, "nodes").where("name = 'figure' and body is not null").select(F.regexp_extract("body", C.DEPENDENCIES["image"], 1).alias("target")).where("target <> ''").distinct()
    named = C.dependencies(table(spark, sf_dir, "nodes").where("kind = 'text'").select("node_uid", "content"), "node_uid", "content").where("kind = 'image'").select("target").distinct()
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    body = body.join(named, "target", "left_anti").withColumn("stem", stem(F.col("target")))
    return body.join(named.select(stem(F.col("target")).alias("stem")).distinct(), "stem", "left_anti").select("target")


def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by format, with warnings and success rate; a run with a warning is partial."""
    r = table(spark, sf_dir, "proc_contexts").select("ctx_id", "source_format", F.coalesce(F.size("warnings"), F.lit(0)).alias("w"), "tables_processed", "links_processed", (F.col("zwnj_count_after") >= F.col("zwnj_count_before")).alias("kept")).distinct()
    ok = F.count_if((F.col("w") <= 0) & F.col("kept"))
    return r.groupBy("source_format").agg(
        F.count("*").alias("n_runs"), ok.alias("n_ok"), F.sum(F.greatest("w", F.lit(0)).cast("bigint")).alias("n_warnings"),
        F.sum(F.col("tables_processed").cast("bigint")).alias("n_tables"), F.sum(F.col("links_processed").cast("bigint")).alias("n_links"), F.round(ok * 100 / F.count("*"), 4).alias("success_rate"),
    )


def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs rolled up by format and declared encoding."""
    r = table(spark, sf_dir, "proc_contexts").select("ctx_id", F.coalesce("source_format", F.lit("none")).alias("f"), F.lower(F.coalesce("encoding", F.lit("none"))).alias("e")).distinct()
    r = r.rollup("f", "e").agg(F.count("*").alias("n_runs"))
    return r.select(F.coalesce("f", F.lit("ALL")).alias("source_format"), F.coalesce("e", F.lit("ALL")).alias("encoding"), "n_runs")


def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose warnings or path say that something is undefined, missing or lost."""
    r = table(spark, sf_dir, "proc_contexts").select("ctx_id", "source_path", "warnings").distinct()
    hit = lambda c: F.lower(c).rlike("undefined|missing|lost")
    return r.where(F.coalesce(F.exists("warnings", hit), F.lit(False)) | F.coalesce(hit(F.col("source_path")), F.lit(False))).select("ctx_id", F.coalesce(F.size("warnings"), F.lit(0)).cast("bigint").alias("n_warnings"))


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten runs that started last (a top-k report)."""
    r = table(spark, sf_dir, "proc_contexts").select("ctx_id", "doc_id", "started_at").distinct()
    return r.where("started_at is not null").orderBy(F.desc("started_at"), F.desc("ctx_id")).limit(10).select("ctx_id", "doc_id")


def latest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every metadata record."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "doc_id", "ingested_at")
    return C.latest(m, "meta_id", "ingested_at").select("meta_id", "doc_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested"))


def deploy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of metadata records in each framework."""
    m = table(spark, sf_dir, "doc_metadata").where("slug is not null and slug <> ''").select("meta_id", "slug").distinct()
    return m.select("meta_id", *(C.deploy_path(f, F.col("slug")).alias(f) for f in ("next", "astro", "gatsby", "docusaurus")))


def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of documents copied into one folder."""
    d = table(spark, sf_dir, "documents").where("path is not null").select("doc_id", F.regexp_replace("path", "[0-9]+", "").alias("short"))
    return C.collision_names(d, "short", "doc_id").select("doc_id", "target")


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata records as JSON, read back."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", F.to_json(F.struct("title", "lang", "series", "tags")).alias("j")).distinct()
    return m.select("meta_id", F.get_json_object("j", "$.title").alias("title"), F.get_json_object("j", "$.series.series_name").alias("series_name"), F.get_json_object("j", "$.tags[0]").alias("first_tag"))


def authors_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by domain of their address and whether a Latin name is given."""
    a = table(spark, sf_dir, "author_infos")
    return a.groupBy(F.coalesce(F.regexp_extract("email", "@(.+)$", 1), F.lit("")).alias("domain"), F.col("name_en").isNotNull().alias("has_latin")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and keywords of every document as one sorted set."""
    m = table(spark, sf_dir, "doc_metadata").select("doc_id", F.concat(F.coalesce("tags", F.array()), F.coalesce("keywords", F.array())).alias("w"))
    m = m.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w"))
    return m.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", "|").alias("words"))


def tag_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each document type by frequency, ranked."""
    t = table(spark, sf_dir, "doc_metadata").select("meta_id", "doc_type", F.explode("tags").alias("tag")).distinct().groupBy("doc_type", "tag").agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.rank().over(W.partitionBy("doc_type").orderBy(F.desc("n"))).cast("bigint"))


def node_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every parent node, numbered in order."""
    n = table(spark, sf_dir, "nodes").where("parent_id is not null").select("node_uid", "doc_id", "node_id", "parent_id", "ordinal", "kind").distinct()
    return n.select("node_uid", "parent_id", F.row_number().over(W.partitionBy("doc_id", "parent_id").orderBy("ordinal", "node_id", "node_uid")).cast("bigint").alias("number"), F.lag("kind").over(W.partitionBy("doc_id", "parent_id").orderBy("ordinal", "node_id", "node_uid")).alias("previous"))


def node_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every document by kind: nodes of each document by kind, as columns."""
    n = table(spark, sf_dir, "nodes").select("node_uid", "doc_id", "kind").distinct()
    kinds = ["text", "environment", "command", "math", "comment"]
    return n.groupBy("doc_id").pivot("kind", kinds).agg(F.count(F.lit(1))).fillna(0)


_FUNCTIONS = (dependency_edges, include_closure, project_structure, structure_mismatch, chapter_split, series_files, unreferenced_images, conversion_report, report_rollup, report_search, latest_runs, latest_metadata, deploy_paths, asset_names, metadata_json, authors_by_domain, tag_sets, tag_ranks, node_tree, node_pivot)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_EDGES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, trim(unnest(regexp_extract_all(text, '{p}', 1))) AS target FROM (SELECT doc_id, text FROM documents UNION ALL SELECT DISTINCT doc_id, body FROM nodes WHERE body IS NOT NULL)" for k, p in C.DEPENDENCIES.items())
_BOOK = r"""(coalesce(regexp_matches(substr(text, 1, 5000), '\\documentclass[^{]*\{book\}') OR len(regexp_extract_all(substr(text, 1, 5000), '\\chapter\b')) >= 2
 OR (regexp_matches(substr(text, 1, 5000), '\\(input|include)\{') AND len(regexp_extract_all(substr(text, 1, 5000), '\\chapter\b')) >= 1), false))"""
_IMG = C.DEPENDENCIES["image"]
_STEM = "regexp_extract({c}, '([^/]+?)(?:\\.[A-Za-z]+)?$', 1)"
SQL = {
    "dependency_edges": f"SELECT kind, target, count(*) AS n_edges, count(DISTINCT doc_id) AS n_docs FROM ({_EDGES}) GROUP BY 1, 2",
    "include_closure": """WITH RECURSIVE e AS (SELECT DISTINCT doc_id || ':' || parent_id AS src, doc_id || ':' || node_id AS dst FROM nodes WHERE parent_id IS NOT NULL),
r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src)
SELECT CAST(depth AS INT) AS depth, count(*) AS n_pairs FROM (SELECT src, dst, min(depth) AS depth FROM r GROUP BY 1, 2) GROUP BY 1""",
    "project_structure": f"""WITH f AS (SELECT project_id, doc_id, path, coalesce(source_format, '') AS source_format, {_BOOK} AS is_book FROM documents WHERE project_id IS NOT NULL),
b AS (SELECT project_id, source_format, count(*) AS n, min(doc_id) AS first FROM f GROUP BY 1, 2),
p AS (SELECT project_id, CAST(sum(n) AS BIGINT) AS n_files, count(*) AS n_formats, arg_max(source_format, n * 1000000000 - first) AS main_format FROM b GROUP BY 1),
m AS (SELECT project_id, bool_or(is_book) AS has_book, arg_min(path, (NOT is_book)::BIGINT * 1000000000000 + doc_id) AS main_entry FROM f GROUP BY 1)
SELECT project_id, n_files, n_formats, main_format, CASE WHEN n_files <= 1 THEN 'single_doc' WHEN has_book AND main_format = 'latex' THEN 'multi_chapter_book' WHEN n_formats = 1 THEN 'independent_articles' ELSE 'related_collection' END AS structure, main_entry FROM p JOIN m USING (project_id)""",
    "structure_mismatch": "SELECT structure_type, main_format, count(*) AS n_projects, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_docs, count(*) FILTER (n IS NULL) AS n_empty FROM projects LEFT JOIN (SELECT project_id, count(*) AS n FROM documents GROUP BY 1) USING (project_id) GROUP BY 1, 2",
    "chapter_split": r"""WITH p AS (SELECT doc_id, string_split_regex(text, '\\chapter\*?\{') AS s FROM documents WHERE source_format = 'latex'),
x AS (SELECT doc_id, i - 1 AS chapter_no, len(s) AS n, s[i] AS t FROM p, unnest(range(1, len(s) + 1)) AS u(i) WHERE len(s) = 1 OR i > 1),
y AS (SELECT doc_id, chapter_no, CASE WHEN n > 1 THEN regexp_extract(t, '^([^}]*)\}', 1) ELSE '' END AS title, length(regexp_replace(CASE WHEN n > 1 THEN regexp_replace(t, '^[^}]*\}', '') ELSE t END, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS n_chars FROM x)
SELECT * FROM y WHERE n_chars > 0""",
    "series_files": "SELECT doc_id, count(*) AS n_chapters, string_agg(chapter_order || ':' || coalesce(slug, ''), ',' ORDER BY chapter_order, coalesce(slug, ''), coalesce(title, '')) AS entries FROM chapters GROUP BY 1",
    "unreferenced_images": f"""WITH b AS (SELECT DISTINCT regexp_extract(body, '{_IMG}', 1) AS target FROM nodes WHERE name = 'figure' AND body IS NOT NULL), r AS (SELECT DISTINCT trim(unnest(regexp_extract_all(content, '{_IMG}', 1))) AS target FROM nodes WHERE kind = 'text')
SELECT target FROM b WHERE target <> '' AND target NOT IN (SELECT target FROM r) AND {_STEM.format(c='target')} NOT IN (SELECT {_STEM.format(c='target')} FROM r)""",
    "conversion_report": """WITH r AS (SELECT DISTINCT ctx_id, source_format, coalesce(len(warnings), 0) AS w, tables_processed, links_processed, zwnj_count_after >= zwnj_count_before AS kept FROM proc_contexts)
SELECT source_format, count(*) AS n_runs, count(*) FILTER (w = 0 AND kept) AS n_ok, CAST(sum(w) AS BIGINT) AS n_warnings, CAST(sum(tables_processed) AS BIGINT) AS n_tables, CAST(sum(links_processed) AS BIGINT) AS n_links, round(count(*) FILTER (w = 0 AND kept) * 100 / count(*), 4) AS success_rate FROM r GROUP BY 1""",
    "report_rollup": "SELECT coalesce(f, 'ALL') AS source_format, coalesce(e, 'ALL') AS encoding, count(*) AS n_runs FROM (SELECT DISTINCT ctx_id, coalesce(source_format, 'none') AS f, lower(coalesce(encoding, 'none')) AS e FROM proc_contexts) GROUP BY ROLLUP (f, e)",
    "report_search": "SELECT DISTINCT ctx_id, coalesce(len(warnings), 0) AS n_warnings FROM (SELECT DISTINCT ctx_id, source_path, warnings FROM proc_contexts) WHERE coalesce(len(list_filter(warnings, lambda x: regexp_matches(lower(x), 'undefined|missing|lost'))) > 0, false) OR coalesce(regexp_matches(lower(source_path), 'undefined|missing|lost'), false)",
    "latest_runs": "SELECT ctx_id, doc_id FROM (SELECT DISTINCT ctx_id, doc_id, started_at FROM proc_contexts WHERE started_at IS NOT NULL) ORDER BY started_at DESC, ctx_id DESC LIMIT 10",
    "latest_metadata": "SELECT meta_id, arg_max(doc_id, ingested_at) AS doc_id, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS ingested FROM doc_metadata GROUP BY 1",
    "deploy_paths": "SELECT DISTINCT meta_id, 'content/' || slug || '/index.mdx' AS next, 'src/content/' || slug || '/index.mdx' AS astro, 'content/' || slug || '/index.mdx' AS gatsby, 'docs/' || slug || '.mdx' AS docusaurus FROM doc_metadata WHERE slug IS NOT NULL AND slug <> ''",
    "asset_names": r"""WITH d AS (SELECT doc_id, regexp_replace(path, '[0-9]+', '', 'g') AS short FROM documents WHERE path IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY doc_id) - 1 AS n FROM d)
SELECT doc_id, CASE WHEN n = 0 THEN short ELSE regexp_replace(short, '\.[A-Za-z0-9]+$', '') || '_' || n || regexp_extract(short, '(\.[A-Za-z0-9]+)$', 1) END AS target FROM n""",
    "metadata_json": "SELECT DISTINCT meta_id, title, series.series_name AS series_name, tags[1] AS first_tag FROM doc_metadata",
    "authors_by_domain": "SELECT coalesce(regexp_extract(email, '@(.+)$', 1), '') AS domain, name_en IS NOT NULL AS has_latin, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM author_infos GROUP BY 1, 2",
    "tag_sets": "WITH w AS (SELECT doc_id, list_concat(coalesce(tags, []), coalesce(keywords, [])) AS w FROM doc_metadata), s AS (SELECT doc_id, list_sort(list_distinct(flatten(list(w)))) AS w FROM w GROUP BY 1) SELECT doc_id, len(w) AS n_words, array_to_string(w, '|') AS words FROM s",
    "tag_ranks": "WITH t AS (SELECT doc_type, tag, count(*) AS n FROM (SELECT DISTINCT meta_id, doc_type, unnest(tags) AS tag FROM doc_metadata) GROUP BY 1, 2) SELECT doc_type, tag, n, rank() OVER (PARTITION BY doc_type ORDER BY n DESC) AS rank FROM t",
    "node_tree": """WITH n AS (SELECT DISTINCT node_uid, doc_id, node_id, parent_id, ordinal, kind FROM nodes WHERE parent_id IS NOT NULL)
SELECT node_uid, parent_id, row_number() OVER w AS number, lag(kind) OVER w AS previous FROM n WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY ordinal, node_id, node_uid)""",
    "node_pivot": "SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("text", "environment", "command", "math", "comment")) + " FROM (SELECT DISTINCT node_uid, doc_id, kind FROM nodes) GROUP BY 1",
}
