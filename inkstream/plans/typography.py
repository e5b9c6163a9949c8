"""Queries on typography, slugs and other scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import persian, rx, slugs
from inkstream.sources.tables import spread, table


def zwnj_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-spaces by field, and whether normalising keeps them."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "title", "description", "tags", "keywords").distinct()
    in_list = lambda c: F.coalesce(F.aggregate(F.transform(c, persian.zwnj_count), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"))
    report = persian.zwnj_report(F.col("title"), persian.normalise(F.col("title")))
    return m.select("meta_id", F.coalesce(persian.zwnj_count(F.col("title")), F.lit(0)).alias("in_title"), F.coalesce(persian.zwnj_count(F.col("description")), F.lit(0)).alias("in_description"), in_list("tags").alias("in_tags"), in_list("keywords").alias("in_keywords"), report["preserved"].alias("preserved"))


def zwnj_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of half-spaces in titles that are lost when the text is trimmed to 30 characters."""
    t = table(spark, sf_dir, "doc_metadata").select("meta_id", "title").where("title is not null and title <> ''").distinct()
    lost = F.array_except(persian.zwnj_positions(F.col("title")), persian.zwnj_positions(F.substring("title", 1, 30)))
    return t.select("meta_id", F.size(persian.zwnj_positions(F.col("title"))).cast("bigint").alias("n_all"), F.size(lost).cast("bigint").alias("n_lost"), F.coalesce(F.array_max(lost), F.lit(-1)).cast("bigint").alias("last_lost"))


def letters_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persian letters, Persian and Latin digits of every title."""
    t = table(spark, sf_dir, "bib_entries").select("bib_id", F.col("title").alias("t"), F.col("year").alias("y")).where("title is not null")
    return t.select("bib_id", persian.fix_letters(F.col("t")).alias("letters"), persian.persian_digits(F.col("y")).alias("persian_year"), persian.latin_digits(F.col("y")).alias("latin_year"))


def quotes_and_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotation marks and spacing of every entry's title and pages."""
    t = table(spark, sf_dir, "bib_entries").select("bib_id", "title", "pages")
    spaced = F.regexp_replace(F.col("title"), "[ \t\n\r\f]+([:؛؟!])", "$1")
    return t.select("bib_id", persian.guillemets(F.col("pages")).alias("quoted"), spaced.alias("spaced"))


def half_spaces_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """half-spaces put back into Persian text nodes that lost them."""
    n = table(spark, sf_dir, "nodes").where("kind = 'text' and content is not null").select("node_uid", "content").distinct()
    lost = F.replace(F.col("content"), F.lit(persian.ZWNJ), F.lit(" "))
    return n.select("node_uid", persian.zwnj_count(F.col("content")).alias("n_before"), persian.zwnj_count(persian.insert_zwnj(lost)).alias("n_after"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised chapters, with code and formulas as they were."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", F.col("mdx_content").alias("t")).where("mdx_content is not null")
    n = persian.normalise(F.col("t"))
    return c.select("chapter_id", F.length(n).cast("bigint").alias("n_chars"), rx.count(n, "[۰-۹]").alias("n_digits"), rx.count(n, "«").alias("n_quotes"), (F.array_join(rx.every(n, "(?s)```.*?```"), "") == F.array_join(rx.every(F.col("t"), "(?s)```.*?```"), "")).alias("code_kept"))


def slugs_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of chapters, unique within their document."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", "doc_id", "chapter_order", "title")
    c = c.withColumn("slug", slugs.persian_slug(F.coalesce("title", F.lit("")), F.concat(F.lit("chapter-"), F.col("chapter_order").cast("string"))))
    c = slugs.unique_slugs(c.withColumn("scoped", F.concat_ws("/", F.col("doc_id").cast("string"), "slug")), "scoped", ["chapter_order", "chapter_id"])
    return c.select("chapter_id", "slug", F.concat(F.lpad(F.col("chapter_order").cast("string"), 2, "0"), F.lit("-"), F.col("slug")).alias("chapter_slug"), F.col("unique_slug").alias("unique_path"), slugs.valid_slug(F.col("slug")).alias("valid"))


def ascii_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slugs of metadata titles."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "doc_id", "title").distinct()
    return m.select("meta_id", slugs.ascii_slug(F.coalesce("title", F.lit("")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("slug"))


def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cut texts, sizes, dates, short hashes and grades."""
    m = table(spark, sf_dir, "doc_metadata").select("meta_id", "description", "doc_date", "source_file", "quality_score").distinct()
    grade = F.when(F.col("quality_score") >= 90, "excellent").when(F.col("quality_score") >= 75, "good").when(F.col("quality_score") >= 50, "fair").otherwise("poor")
    return m.select(
        "meta_id",
        slugs.truncate(F.col("description"), 40).alias("short"),
        slugs.human_size(F.length("description") * F.col("meta_id")).alias("size"),
        slugs.iso_date(F.coalesce("doc_date", F.lit("")), "1970-01-01").alias("iso_date"),
        slugs.short_hash(F.coalesce("source_file", F.lit(""))).alias("hash8"),
        grade.alias("grade"),
    )


def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels of chapters by kind, with their ids."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", F.explode("labels").alias("label", "target"))
    return c.select("chapter_id", "label", slugs.label_id(F.col("label")).alias("label_id"), slugs.label_kind(F.col("label")).alias("label_kind"))


def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: number and length of protected spans of every document."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", rx.every(F.col("text"), persian.PROTECTED).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_spans"), F.length(F.array_join("s", "")).cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (zwnj_counts, zwnj_positions, letters_and_digits, quotes_and_spacing, half_spaces_inserted, normalised_text, slugs_of_titles, ascii_slugs, short_forms, label_kinds, protected_spans)}

_Z = "chr(8204)"
_ZC = "(length({t}) - length(replace({t}, chr(8204), '')))"


def _translate(t: str, pair: tuple[str, str]) -> str:
    return f"translate({t}, '{pair[0]}', '{pair[1]}')"


#: The rules of slugs written out in SQL, letter by letter, independent of the library's tables.
_TR = "translate(translate(translate(lower(trim(coalesce(title, ''))), 'يك', 'یک'), 'اآبپتثجحدذرزسصضطظعفکگلمنوهی', 'aabptsjhdzrzssztzafkglmnvhy'), '۰۱۲۳۴۵۶۷۸۹', '0123456789')"
for _k, _v in (("چ", "ch"), ("خ", "kh"), ("ژ", "zh"), ("ش", "sh"), ("غ", "gh"), ("ق", "gh")):
    _TR = f"replace({_TR}, '{_k}', '{_v}')"
_PSLUG = "regexp_replace(substr(regexp_replace(regexp_replace(" + _TR + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '')"
_SLUG = "substr(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"
_SUM = "coalesce(list_sum(list_transform({c}, lambda x: coalesce(" + _ZC.format(t="x") + ", 0))), 0)"
SQL = {
    "zwnj_counts": f"""SELECT meta_id, coalesce({_ZC.format(t="title")}, 0) AS in_title, coalesce({_ZC.format(t="description")}, 0) AS in_description,
CAST({_SUM.format(c="tags")} AS BIGINT) AS in_tags, CAST({_SUM.format(c="keywords")} AS BIGINT) AS in_keywords, CASE WHEN title IS NULL THEN NULL ELSE true END AS preserved
FROM (SELECT DISTINCT meta_id, title, description, tags, keywords FROM doc_metadata)""",
    "zwnj_positions": """WITH t AS (SELECT DISTINCT meta_id, title FROM doc_metadata WHERE title IS NOT NULL AND title <> ''),
p AS (SELECT meta_id, list_filter(range(0, length(title)), lambda i: substr(title, CAST(i + 1 AS BIGINT), 1) = chr(8204)) AS a FROM t)
SELECT meta_id, len(a) AS n_all, len(list_filter(a, lambda i: i >= 30)) AS n_lost, coalesce(list_max(list_filter(a, lambda i: i >= 30)), -1) AS last_lost FROM p""",
    "letters_and_digits": f"SELECT bib_id, {_translate('title', persian.ARABIC_LETTERS)} AS letters, {_translate('year', persian.TO_PERSIAN_DIGITS)} AS persian_year, {_translate('year', persian.TO_LATIN_DIGITS)} AS latin_year FROM bib_entries WHERE title IS NOT NULL",
    "quotes_and_spacing": """SELECT bib_id, regexp_replace(regexp_replace(pages, '"([^"]*)"', '«\\1»', 'g'), '''([^'']*)''', '«\\1»', 'g') AS quoted, regexp_replace(title, '[ \\t\\n\\r\\f]+([:؛؟!])', '\\1', 'g') AS spaced FROM bib_entries""",
    "slugs_of_titles": f"""WITH s AS (SELECT chapter_id, doc_id, chapter_order, {_PSLUG} AS s FROM chapters),
t AS (SELECT *, CASE WHEN s = '' THEN 'chapter-' || chapter_order ELSE s END AS slug FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY chapter_order, chapter_id) - 1 AS n FROM t)
SELECT chapter_id, slug, substr(lpad(CAST(chapter_order AS VARCHAR), 2, '0'), 1, 2) || '-' || slug AS chapter_slug, CASE WHEN doc_id IS NULL THEN slug ELSE doc_id || '/' || slug END || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS unique_path,
 regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') AS valid FROM u""",
    "ascii_slugs": f"SELECT DISTINCT meta_id, CASE WHEN {_SLUG.format(t='''coalesce(title, '')''')} = '' THEN 'doc-' || doc_id ELSE {_SLUG.format(t='''coalesce(title, '')''')} END AS slug FROM (SELECT DISTINCT meta_id, doc_id, title FROM doc_metadata)",
    "short_forms": r"""WITH m AS (SELECT DISTINCT meta_id, description, doc_date, source_file, quality_score FROM doc_metadata),
c AS (SELECT *, substr(description, 1, 40) AS cut, length(description) * meta_id AS n FROM m),
l AS (SELECT *, coalesce(list_max(list_filter(range(0, 40), lambda i: substr(cut, CAST(i + 1 AS BIGINT), 1) IN (' ', chr(8204)))), 0) AS last FROM c)
SELECT meta_id, CASE WHEN length(description) <= 40 THEN description WHEN last > 20 THEN substr(cut, 1, last) || '...' ELSE cut || '...' END AS short,
 CASE WHEN n < 1024 THEN printf('%.1f', n::DOUBLE) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576) || ' MB' ELSE printf('%.1f', n / 1073741824) || ' GB' END AS size,
 CASE WHEN regexp_extract(coalesce(doc_date, ''), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) <> '' THEN regexp_extract(doc_date, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)
 WHEN regexp_matches(coalesce(doc_date, ''), '^[ \t\n\r\f]*[0-9]{4}[ \t\n\r\f]*$') THEN trim(doc_date) || '-01-01' ELSE '1970-01-01' END AS iso_date,
 substr(md5(coalesce(source_file, '')), 1, 8) AS hash8, CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good' WHEN quality_score >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM l""",
    "label_kinds": f"""WITH l AS (SELECT chapter_id, unnest(map_entries(labels)) AS e FROM chapters)
SELECT chapter_id, e.key AS label, translate(e.key, ':_', '--') AS label_id, CASE split_part(e.key, ':', 1) WHEN 'eq' THEN 'معادله' WHEN 'fig' THEN 'شکل' WHEN 'tab' THEN 'جدول' WHEN 'sec' THEN 'بخش' WHEN 'ch' THEN 'فصل' WHEN 'thm' THEN 'قضیه' WHEN 'def' THEN 'تعریف' WHEN 'lem' THEN 'لم' WHEN 'alg' THEN 'الگوریتم' WHEN 'lst' THEN 'برنامه' ELSE '' END AS label_kind FROM l""",
    "protected_spans": f"SELECT doc_id, len(regexp_extract_all(text, '{persian.PROTECTED}')) AS n_spans, CAST(length(array_to_string(regexp_extract_all(text, '{persian.PROTECTED}'), '')) AS BIGINT) AS n_chars FROM documents",
}
