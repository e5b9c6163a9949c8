"""Queries on quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import persian, rx
from inkstream.operators import quality as Q
from inkstream.sources.tables import spread, table


def element_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q01: elements of every document."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", Q.counters(F.col("text")).alias("c")).select("doc_id", "c.*")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as sources and their normalised bodies as outputs."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", "mdx_content").where("mdx_content is not null")
    return c.select("chapter_id", Q.counters(F.col("mdx_content")).alias("s"), Q.counters(F.regexp_replace("mdx_content", r"(?m)^#{1,6}[ \t]+", "")).alias("o"))


def content_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chapters keep if their headings lose their marks."""
    return _pairs(spark, sf_dir).select("chapter_id", Q.preserved(F.col("s"), F.col("o")).alias("preserved"), F.round(Q.content_score(F.col("s"), F.col("o")), 4).alias("score"), F.round(Q.content_score(F.col("s"), F.col("o"), False), 4).alias("least_score"))


def chapter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's MDX against the text of its document; counts are joined, not texts."""
    source = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", Q.analysed(F.col("text"), Q.SOURCE_ELEMENTS).alias("s"))
    output = table(spark, sf_dir, "chapters").where("mdx_content is not null").select("chapter_id", "doc_id", Q.analysed(Q.without_head(F.col("mdx_content")), Q.OUTPUT_ELEMENTS).alias("o"))
    both = output.join(source, "doc_id")
    score = Q.quality_score(F.col("s"), F.col("o"))
    return both.select("chapter_id", *(F.col(f"s.{n}").alias(f"{n}_source") for n in (*Q.SOURCE_ELEMENTS, "words")), *(F.col(f"o.{n}").alias(f"{n}_output") for n in (*Q.SOURCE_ELEMENTS, "words")), F.round(Q.content_points(F.col("s"), F.col("o")), 4).alias("content_score"), score.alias("score"), Q.grade(score).alias("grade"))


def conversion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document converted and scored, in one pass over the texts."""
    from inkstream.operators import convert

    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source_format"))
    mdx = convert.to_mdx(d, "doc_id", "text", "source_format", keep=("text",))
    both = mdx.select("doc_id", "status", Q.analysed(F.col("text"), Q.SOURCE_ELEMENTS).alias("s"), Q.analysed(Q.without_head(F.col("mdx")), Q.OUTPUT_ELEMENTS).alias("o"), (~F.col("mdx").contains("\ufffd")).alias("encoding"), (F.coalesce(rx.count(F.col("mdx"), "```"), F.lit(0)) % 2 == 0).alias("fences"))
    flags = {"frontmatter": F.col("fences"), "encoding": F.col("encoding"), "compiles": F.col("status") == "success"}
    return both.select("doc_id", "status", F.round(Q.content_points(F.col("s"), F.col("o")), 4).alias("content_score"), Q.quality_score(F.col("s"), F.col("o"), F.col("fences")).alias("score"), Q.weighted(flags).alias("points"))


def preflight_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q06: issues of documents by level and code."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "source_format", F.inline(Q.issues(F.col("text"), F.col("source_format"))))
    return d.groupBy("source_format", "level", "code").agg(F.count("*").alias("n_docs"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of every document."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", Q.readiness(Q.issues(F.col("text"), F.col("source_format"))).alias("readiness"))
    return d.select("doc_id", "readiness", (F.col("readiness") >= 70).alias("can_proceed"), Q.grade(F.col("readiness")).alias("grade"))


def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, Q12: tests of every chapter."""
    return table(spark, sf_dir, "chapters").select("chapter_id", *Q.structure(F.col("mdx_content")))


def quality_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata records by grade of their score."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "quality_score", "doc_type").distinct().where("quality_score is not null")
    return m.groupBy("doc_type", Q.grade(F.col("quality_score")).alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("avg_score"))


def metadata_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of metadata records by field."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "title", "slug", "doc_date", "lang", "text_dir", "series", "description", "tags").distinct()
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    v = F.array(
        F.when(blank(F.col("title")), "title"),
        F.when(~F.coalesce(F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "slug"),
        F.when(~F.coalesce(F.col("doc_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "doc_date"),
        F.when(~F.coalesce(F.lower("lang").isin("fa", "en", "fa-en", "de", "fr", "ar"), F.lit(False)), "lang"),
        F.when(~F.coalesce(F.col("text_dir").isin("rtl", "ltr"), F.lit(False)), "text_dir"),
        F.when(F.col("series.series_order") > F.col("series.total"), "series"),
        F.when(blank(F.col("description")), "description"),
        F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, "tags"),
    )
    return m.select("meta_id", F.explode(F.filter(v, lambda x: x.isNotNull())).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def direction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared direction of metadata against the direction of the title."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "title", "text_dir").where("title is not null and title <> ''").distinct()
    return m.groupBy(F.coalesce("text_dir", F.lit("")).alias("declared"), persian.direction(F.col("title")).alias("of_title")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (element_counters, content_preservation, chapter_quality, conversion_quality, preflight_issues, readiness, structural_checks, quality_by_grade, metadata_issues, direction_report)}


def _c(t: str, name: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({t}, '{p}'))" for p in Q.COUNTERS[name]) + ")"


_HS = "(length({t}) - length(replace({t}, chr(8204), '')))"
_GRADE = "CASE WHEN {x} >= 90 THEN 'excellent' WHEN {x} >= 75 THEN 'good' WHEN {x} >= 50 THEN 'fair' ELSE 'poor' END"
_N = "len(regexp_extract_all({t}, '{p}'))"
_ISSUES = r"""(SELECT doc_id, source_format, unnest(list_filter([
CASE WHEN trim(t) = '' THEN 'error:empty' END, CASE WHEN length(t) > 10000000 THEN 'warning:large' END, CASE WHEN contains(t, chr(65533)) THEN 'error:encoding' END,
CASE WHEN source_format = 'latex' AND len(regexp_extract_all(t, '\{')) <> len(regexp_extract_all(t, '\}')) THEN 'error:braces' END,
CASE WHEN source_format = 'latex' AND len(regexp_extract_all(t, '\\begin\{')) <> len(regexp_extract_all(t, '\\end\{')) THEN 'error:environments' END,
CASE WHEN source_format = 'latex' AND NOT regexp_matches(t, '\\documentclass') THEN 'info:no-class' END,
CASE WHEN source_format = 'html' AND NOT regexp_matches(t, '(?i)<html') THEN 'info:no-html' END,
CASE WHEN source_format = 'markdown' AND NOT starts_with(t, '---') THEN 'warning:no-frontmatter' END,
CASE WHEN regexp_matches(t, '[يك]') THEN 'info:arabic-letters' END], lambda x: x IS NOT NULL)) AS i FROM (SELECT doc_id, source_format, coalesce(text, '') AS t FROM documents))"""
_SHARES = "[" + ", ".join(f"CASE WHEN s_{n} > 0 THEN o_{n} / s_{n} END" for n in Q.COUNTERS) + "]"
_FA, _EN = "len(regexp_extract_all(title, '[؀-ۿݐ-ݿﭐ-﷿ﹰ-\ufeff]'))", "len(regexp_extract_all(title, '[a-zA-Z]'))"
_SOURCE = {"headings": r"\\(?:chapter|section|subsection|subsubsection|paragraph)", "formulas": r"\$\$|\\\[|\\begin\{(?:equation|align|gather|multline)\}", "images": r"\\includegraphics", "tables": r"\\begin\{(?:tabular|longtable|table)\}", "code": r"\\begin\{(?:lstlisting|minted|verbatim)\}|```", "words": r"[^ \t\n\r\f\v]+"}
_OUTPUT = {"headings": r"(?m)^#{1,6}[ \t\n\r\f\v]+", "formulas": r"\$\$|\$[^$]+\$", "images": r"<Figure|!\[", "tables": r"<table|(?m:^\|)", "code": "```", "words": r"[^ \t\n\r\f\v]+"}
_MATCHES = lambda t, ps, side: ", ".join(f"len(regexp_extract_all({t}, '{p}')) AS {n}_{side}" for n, p in ps.items())
_KEPT = "list_filter([" + ", ".join(f"CASE WHEN {n}_source > 0 THEN {n}_output / {n}_source END" for n in ("headings", "formulas", "images", "tables", "code")) + "], lambda x: x IS NOT NULL)"
SQL = {
    "chapter_quality": f"""WITH s AS (SELECT doc_id, {_MATCHES("coalesce(text, '')", _SOURCE, "source")} FROM documents),
b AS (SELECT chapter_id, doc_id, CASE WHEN starts_with(mdx_content, '---') AND instr(substr(mdx_content, 4), '---') > 0 THEN substr(mdx_content, instr(substr(mdx_content, 4), '---') + 6) ELSE mdx_content END AS t FROM chapters WHERE mdx_content IS NOT NULL),
o AS (SELECT chapter_id, doc_id, {_MATCHES("t", _OUTPUT, "output")} FROM b),
j AS (SELECT o.*, s.* EXCLUDE (doc_id), words_output / nullif(words_source, 0) AS w FROM o JOIN s USING (doc_id)),
k AS (SELECT *, {_KEPT} AS kept, CASE WHEN w BETWEEN 0.9 AND 1.1 THEN 1.0::DOUBLE WHEN w < 0.9 THEN w / 0.9 WHEN w > 1.1 THEN 1.0 - (w - 1.1) / 0.1 END AS by_words FROM j),
p AS (SELECT *, list_filter(list_concat(list_transform(kept, lambda x: least(x, 1.0)), [by_words]), lambda x: x IS NOT NULL) AS all_kept, CAST(round_even(25 + coalesce(list_min(kept), 1.0) * 25 + 50, 0) AS BIGINT) AS score FROM k)
SELECT chapter_id, {', '.join(f"{n}_{side}" for side in ("source", "output") for n in ("headings", "formulas", "images", "tables", "code", "words"))}, round(CASE WHEN len(all_kept) = 0 THEN 25.0 ELSE list_sum(all_kept) / len(all_kept) * 25 END, 4) AS content_score, score,
 CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM p""",
    "element_counters": f"SELECT doc_id, {', '.join(f'{_c('t', n)} AS {n}' for n in Q.COUNTERS)}, {_HS.format(t='t')} AS half_spaces FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "content_preservation": f"""WITH p AS (SELECT chapter_id, mdx_content AS s, regexp_replace(mdx_content, '(?m)^#{{1,6}}[ \\t]+', '', 'g') AS o FROM chapters WHERE mdx_content IS NOT NULL),
c AS (SELECT chapter_id, {', '.join(f'{_c('s', n)} AS s_{n}, {_c('o', n)} AS o_{n}' for n in Q.COUNTERS)} FROM p), l AS (SELECT *, list_filter({_SHARES}, lambda x: x IS NOT NULL) AS sh FROM c)
SELECT chapter_id, (s_headings = 0 OR o_headings / s_headings >= 0.9) AND (s_formulas = 0 OR o_formulas / s_formulas >= 0.9) AS preserved,
 round(CASE WHEN len(sh) = 0 THEN 25.0 ELSE list_sum(list_transform(sh, lambda x: least(x, 1.0))) / len(sh) * 25 END, 4) AS score, round(coalesce(list_min(sh), 1.0) * 25, 4) AS least_score FROM l""",
    "preflight_issues": f"SELECT source_format, split_part(i, ':', 1) AS level, split_part(i, ':', 2) AS code, count(*) AS n_docs FROM {_ISSUES} GROUP BY 1, 2, 3",
    "readiness": f"""WITH p AS (SELECT doc_id, sum(CASE split_part(i, ':', 1) WHEN 'error' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) AS x FROM {_ISSUES} GROUP BY 1),
r AS (SELECT d.doc_id, CAST(greatest(100 - coalesce(x, 0), 0) AS BIGINT) AS readiness FROM documents d LEFT JOIN p USING (doc_id))
SELECT doc_id, readiness, readiness >= 70 AS can_proceed, {_GRADE.format(x='readiness')} AS grade FROM r""",
    "structural_checks": r"""WITH c AS (SELECT chapter_id, coalesce(mdx_content, '') AS t FROM chapters)
SELECT chapter_id, regexp_extract(t, '^---\n((?s).*?)\n---', 1) <> '' AS frontmatter, NOT regexp_matches(t, '<[a-z][^>]*[ ]class=') AS no_class,
 len(regexp_extract_all(t, '<[A-Z][A-Za-z]*(?:[ ][^>]*)?>')) - len(regexp_extract_all(t, '<[A-Z][A-Za-z]*(?:[ ][^>]*)?/>')) = len(regexp_extract_all(t, '</[A-Z][A-Za-z]*>')) AS closed,
 NOT regexp_matches(t, '<[A-Z]') OR regexp_matches(t, '(?m)^import[ ]') AS imports, NOT contains(t, chr(65533)) AS encoding, len(regexp_extract_all(t, '\{')) = len(regexp_extract_all(t, '\}')) AS braces,
 len(regexp_extract_all(t, '```')) % 2 = 0 AS fences, NOT regexp_matches(t, '"[^"\n]*[؀-ۿ][^"\n]*"') AS quotes FROM c""",
    "quality_by_grade": f"SELECT doc_type, {_GRADE.format(x='quality_score')} AS grade, count(*) AS n, round(avg(quality_score), 6) AS avg_score FROM (SELECT DISTINCT meta_id, quality_score, doc_type FROM doc_metadata WHERE quality_score IS NOT NULL) GROUP BY 1, 2",
    "metadata_issues": """WITH m AS (SELECT DISTINCT meta_id, title, slug, doc_date, lang, text_dir, series, description, tags FROM doc_metadata),
v AS (SELECT unnest([CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' END, CASE WHEN NOT coalesce(regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$'), false) THEN 'slug' END,
 CASE WHEN NOT coalesce(regexp_matches(doc_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), false) THEN 'doc_date' END, CASE WHEN NOT coalesce(lower(lang) IN ('fa', 'en', 'fa-en', 'de', 'fr', 'ar'), false) THEN 'lang' END,
 CASE WHEN NOT coalesce(text_dir IN ('rtl', 'ltr'), false) THEN 'text_dir' END, CASE WHEN series.series_order > series.total THEN 'series' END, CASE WHEN trim(coalesce(description, '')) = '' THEN 'description' END,
 CASE WHEN coalesce(len(tags), 0) = 0 THEN 'tags' END]) AS field FROM m) SELECT field, count(*) AS n FROM v WHERE field IS NOT NULL GROUP BY 1""",
    "direction_report": f"""WITH m AS (SELECT DISTINCT meta_id, title, text_dir FROM doc_metadata WHERE title IS NOT NULL AND title <> ''), c AS (SELECT *, {_FA} AS fa, {_EN} AS en FROM m)
SELECT coalesce(text_dir, '') AS declared, CASE WHEN trim(title) = '' THEN 'rtl' WHEN fa + en = 0 THEN 'ltr' WHEN fa / (fa + en) BETWEEN 0.1 AND 0.9 THEN CASE WHEN fa / (fa + en) >= 0.5 THEN 'rtl' ELSE 'mixed' END WHEN fa > en THEN 'rtl' ELSE 'ltr' END AS of_title, count(*) AS n FROM c GROUP BY 1, 2""",
}
