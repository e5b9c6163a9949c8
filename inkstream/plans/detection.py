"""Queries on language, format and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import detect, persian
from inkstream.sources.tables import spread, table


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source, declared and detected language."""
    d = spread(table(spark, sf_dir, "documents")).select("lang", "source_format", F.length("text").alias("n"), persian.language(F.col("text")).alias("l"))
    return d.groupBy(F.coalesce("lang", F.lit("")).alias("declared"), "source_format", F.col("l.detected").alias("detected")).agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.round(F.avg("l.persian_ratio"), 6).alias("avg_persian")
    )


def converter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and direction of every document."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", persian.converter_language(F.col("text")).alias("conv_lang"))
    return d.withColumn("text_dir", F.when(F.col("conv_lang") == "en", "ltr").otherwise("rtl"))


def block_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: paragraphs by direction."""
    d = spread(table(spark, sf_dir, "documents")).select(F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "block"))
    return d.groupBy(persian.direction(F.col("block")).alias("direction")).agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"))


def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by path and by content, against the declared one."""
    d = spread(table(spark, sf_dir, "documents")).select(F.coalesce("source_format", F.lit("")).alias("declared"), detect.format_of(F.col("path")).alias("by_path"), detect.content_format(F.col("text")).alias("by_content"))
    return d.groupBy("declared", "by_path", "by_content").agg(F.count("*").alias("n_docs"))


def content_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", detect.content_scores(F.col("text")).alias("s")).select("doc_id", "s.*")


def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature flags of every document."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", *detect.features(F.col("text")))


def book_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books and Markdown by content."""
    d = spread(table(spark, sf_dir, "documents")).select("source_format", detect.is_book(F.col("text")).alias("is_book"), detect.markdown_sniff(F.col("text")).alias("is_markdown"))
    return d.groupBy("source_format", "is_book", "is_markdown").agg(F.count("*").alias("n_docs"))


def encoding_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that declare no encoding, a legacy one, or UTF-8 without a mark."""
    e = F.lower(F.trim(F.coalesce("encoding", F.lit(""))))
    warning = F.when(e == "", "missing").when(e == "utf-8-sig", "none").when(e.startswith("utf"), "no-bom").otherwise("legacy")
    return table(spark, sf_dir, "proc_contexts").groupBy("source_format", warning.alias("warning")).agg(F.count("*").alias("n_runs"), F.countDistinct("doc_id").alias("n_docs"))


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of paths."""
    d = table(spark, sf_dir, "proc_contexts").select(F.explode(F.array("source_path", F.concat("source_path", F.lit(".tar.gz")), F.regexp_replace("source_path", r"\.[A-Za-z0-9]+$", ".PNG"), F.concat(F.lit("a/../"), "source_path"))).alias("p"))
    cols = [detect.extension(F.col("p")).alias("ext"), F.coalesce(detect.asset_kind(F.col("p")), F.lit("document")).alias("kind"), F.coalesce(detect.archive_kind(F.col("p")), F.lit("")).alias("archive"), detect.unsafe_path(F.col("p")).alias("unsafe")]
    return d.where("p is not null").groupBy(*cols).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (language_profile, converter_language, block_direction, format_detection, content_scores, feature_flags, book_test, encoding_warnings, path_kinds)}

_PROSE = "text"
for _p, _ in persian.NOT_PROSE:
    _PROSE = f"regexp_replace({_PROSE}, '{_p}', ' ', 'g')"
_FA, _EN = (f"len(regexp_extract_all({{t}}, '{p}'))" for p in (persian.PERSIAN, persian.LATIN))


def _scores(t: str) -> dict[str, str]:
    out = {}
    for name, patterns in detect.SIGNS.items():
        w = 2 if name == "latex" else 1
        parts = [f"CASE WHEN regexp_matches({t}, '{p}') THEN {w} ELSE 0 END" for p in patterns]
        if name == "latex":
            parts.append(f"CASE WHEN regexp_matches({t}, '\\\\begin\\{{document\\}}') THEN 10 ELSE 0 END")
        out[name] = "coalesce(" + " + ".join(parts) + ", 0)"
    return out


_SCORES = _scores("substr(text, 1, 8192)")
_FORMATS = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.FORMATS.items()) + " ELSE 'unknown' END"
_BEST = "greatest(" + ", ".join(_SCORES) + ")"
SQL = {
    "language_profile": f"""WITH p AS (SELECT lang, source_format, length(text) AS n, {_PROSE} AS t FROM documents),
c AS (SELECT *, {_FA.format(t="t")} AS fa, {_EN.format(t="t")} AS en FROM p),
r AS (SELECT *, CASE WHEN fa + en > 0 THEN round(fa / (fa + en), 3) ELSE 0 END AS rf, CASE WHEN fa + en > 0 THEN round(en / (fa + en), 3) ELSE 0 END AS re FROM c)
SELECT coalesce(lang, '') AS declared, source_format,
 CASE WHEN rf >= 0.15 AND re >= 0.15 THEN 'fa+en' WHEN rf > 0.5 THEN 'fa' WHEN re > 0.5 THEN 'en' ELSE 'unknown' END AS detected,
 count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars, round(avg(rf), 6) AS avg_persian FROM r GROUP BY 1, 2, 3""",
    "converter_language": f"""WITH c AS (SELECT doc_id, {_FA.format(t="text")} AS fa, {_EN.format(t="text")} AS en FROM documents),
l AS (SELECT doc_id, CASE WHEN fa = 0 AND en > 0 THEN 'en' WHEN en > 2 * fa THEN 'fa-en' ELSE 'fa' END AS conv_lang FROM c)
SELECT doc_id, conv_lang, CASE WHEN conv_lang = 'en' THEN 'ltr' ELSE 'rtl' END AS text_dir FROM l""",
    "block_direction": f"""WITH b AS (SELECT unnest(string_split(text, chr(10) || chr(10))) AS block FROM documents),
c AS (SELECT block, {_FA.format(t="block")} AS fa, {_EN.format(t="block")} AS en FROM b)
SELECT CASE WHEN trim(block) = '' THEN 'rtl' WHEN fa + en = 0 THEN 'ltr' WHEN fa / (fa + en) BETWEEN 0.1 AND 0.9 THEN CASE WHEN fa / (fa + en) >= 0.5 THEN 'rtl' ELSE 'mixed' END
 WHEN fa > en THEN 'rtl' ELSE 'ltr' END AS direction, count(*) AS n_blocks, CAST(sum(length(block)) AS BIGINT) AS n_chars FROM c GROUP BY 1""",
    "format_detection": f"""WITH s AS (SELECT source_format, path, {", ".join(f"{e} AS {n}" for n, e in _SCORES.items())} FROM documents)
SELECT coalesce(source_format, '') AS declared, {_FORMATS} AS by_path, CASE WHEN {_BEST} < 2 THEN 'unknown' {" ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in _SCORES)} END AS by_content, count(*) AS n_docs
FROM s GROUP BY 1, 2, 3""",
    "content_scores": f"SELECT doc_id, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in _SCORES.items())} FROM documents",
    "feature_flags": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{p}'), false) AS {n}" for n, p in detect.FEATURES.items()) + " FROM documents",
    "book_test": r"""WITH d AS (SELECT source_format, substr(text, 1, 5000) AS h, substr(text, 1, 2000) AS m FROM documents),
f AS (SELECT source_format, len(regexp_extract_all(h, '\\chapter\b')) AS ch, regexp_matches(h, '\\documentclass[^{]*\{book\}') AS bk, regexp_matches(h, '\\(input|include)\{') AS inp,
 CAST(regexp_matches(m, '(?m)^#{1,6} ') AS INT) + CAST(regexp_matches(m, '(?m)^[-*] ') AS INT) + CAST(regexp_matches(m, '\[[^\]]+\]\([^)]+\)') AS INT) + CAST(contains(m, '```') AS INT) + CAST(regexp_matches(m, '(?m)^---[ \t]*$') AS INT) AS md FROM d)
SELECT source_format, bk OR ch >= 2 OR (inp AND ch >= 1) AS is_book, md >= 2 AS is_markdown, count(*) AS n_docs FROM f GROUP BY 1, 2, 3""",
    "encoding_warnings": """WITH e AS (SELECT source_format, doc_id, lower(trim(coalesce(encoding, ''))) AS e FROM proc_contexts)
SELECT source_format, CASE WHEN e = '' THEN 'missing' WHEN e = 'utf-8-sig' THEN 'none' WHEN starts_with(e, 'utf') THEN 'no-bom' ELSE 'legacy' END AS warning, count(*) AS n_runs, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1, 2""",
    "path_kinds": f"""WITH p AS (SELECT unnest([source_path, source_path || '.tar.gz', regexp_replace(source_path, '\\.[A-Za-z0-9]+$', '.PNG'), 'a/../' || source_path]) AS p FROM proc_contexts),
x AS (SELECT p, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM p WHERE p IS NOT NULL)
SELECT ext, CASE {" ".join(f"WHEN list_contains(string_split('{e}', ' '), ext) THEN '{k}'" for k, e in detect.ASSETS.items())} ELSE 'document' END AS kind,
 CASE {" ".join(f"WHEN lower(p) LIKE '%.{e}' THEN '{k}'" for e, k in detect.ARCHIVES.items())} ELSE '' END AS archive,
 regexp_matches(p, '(^|[/\\\\])\\.\\.([/\\\\]|$)') OR regexp_matches(p, '^[/\\\\]|^[A-Za-z]:') AS unsafe, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""",
}
