"""Queries on bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import bibtex
from inkstream.sources.tables import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bib_entries")


def _bare(name: str) -> Column:
    """A field without braces of its own, as it is written into a BibTeX file."""
    return F.translate(F.coalesce(F.col(name), F.lit("")), "{}", "")


def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry written as BibTeX and read again."""
    e = _entries(spark, sf_dir)
    text = bibtex.exported(F.col("entry_type"), F.col("entry_id"), {n: _bare(n) for n in bibtex.FIELDS})
    return bibtex.entries(e.select("bib_id", text.alias("text")), "bib_id", "text").drop("raw_fields")


def references_apa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every entry as a reference in APA style."""
    return _entries(spark, sf_dir).select("bib_id", bibtex.apa({n: F.col(n) for n in bibtex.FIELDS}).alias("reference"))


def references_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every entry as a reference in IEEE style."""
    return _entries(spark, sf_dir).select("bib_id", bibtex.ieee({n: F.col(n) for n in bibtex.FIELDS}).alias("reference"))


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """short author and label of every entry."""
    return _entries(spark, sf_dir).select("bib_id", bibtex.author_short(F.col("author")).alias("author_short"), bibtex.cite_label(F.col("author"), F.col("year")).alias("label"))


def bibliography_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of references of every document."""
    e = _entries(spark, sf_dir).where("doc_id is not null").withColumn("language", bibtex.language(F.col("title"), F.col("author")))
    return bibtex.sections(e, "doc_id", "bib_id")


def citations_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing commands of nodes as links to the entries of their keys, with the option p. 3."""
    n = table(spark, sf_dir, "nodes").where("kind = 'command' and name = 'cite' and size(args) > 0 and args[0] is not null").select("node_uid", F.col("args")[0].alias("keys")).distinct()
    e = _entries(spark, sf_dir).groupBy("entry_id").agg(F.min(F.struct("bib_id", "author", "year")).alias("e")).select("entry_id", "e.author", "e.year")
    out = None
    for command in ("cite", "citep", "citet"):
        text = F.concat(F.lit(f"\\{command}[p. 3]{{"), "keys", F.lit("}"))
        # every command is its own document; the entries are everyone's
        c = bibtex.cited(n.select(F.lit("all").alias("corpus"), "node_uid", text.alias("text")).withColumn("k", F.struct("corpus", "node_uid")), "k", "text").select("k.corpus", F.col("k.node_uid").alias("pos"), "command", "option", "ordinal", "cite_key")
        part = bibtex.rendered_citations(c, e.withColumn("corpus", F.lit("all")), "corpus").select(F.lit(command).alias("command"), F.col("pos").alias("node_uid"), "mdx")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (bibtex_entries, references_apa, references_ieee, citation_labels, bibliography_sections, citations_rendered)}


def _apa(fields: dict[str, str]) -> str:
    f = {k: f"nullif({v}, '')" for k, v in fields.items()}
    return f"concat_ws(' ', {f['author']}, '(' || {f['year']} || ').', '*' || {f['title']} || '*.', {f['journal']} || '.', {f['publisher']} || '.', {f['url']})"


_COLUMNS = {c: c for c in ("author", "title", "year", "publisher", "journal", "volume", "pages", "url", "doi")}
_CLEAN = "regexp_replace(translate(coalesce({c}, ''), '{{}}', ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
_LANG = "CASE WHEN len(regexp_extract_all({t}, '\\p{{L}}')) > 0 AND len(regexp_extract_all({t}, '[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff]')) / len(regexp_extract_all({t}, '\\p{{L}}')) > 0.3 THEN 'fa' ELSE 'en' END"
_FIRST = "trim(split_part(coalesce(author, ''), ' and ', 1))"
_SHORT = f"coalesce(nullif(CASE WHEN contains({_FIRST}, ',') THEN trim(split_part({_FIRST}, ',', 1)) ELSE list_last(regexp_split_to_array({_FIRST}, '[ \\t\\r\\n]+')) END, ''), '?')"
SQL = {
    "bibtex_entries": "SELECT bib_id, CAST(0 AS BIGINT) AS pos, entry_id, lower(entry_type) AS entry_type, " + ", ".join(f"{_CLEAN.format(c=c)} AS {c}" for c in _COLUMNS) + f", {_LANG.format(t='(' + _CLEAN.format(c='title') + chr(32) + '||' + chr(39) + chr(32) + chr(39) + '||' + chr(32) + _CLEAN.format(c='author') + ')')} AS language FROM bib_entries",
    "references_apa": f"SELECT bib_id, {_apa(_COLUMNS)} AS reference FROM bib_entries",
    "references_ieee": """SELECT bib_id, concat_ws(' ', nullif(author, '') || ',', '"' || nullif(title, '') || '",', '*' || nullif(journal, '') || '*,', 'vol. ' || nullif(volume, '') || ',', 'pp. ' || nullif(pages, '') || ',', nullif(year, '') || '.', nullif(url, '')) AS reference FROM bib_entries""",
    "citation_labels": f"SELECT bib_id, {_SHORT} AS author_short, {_SHORT} || ', ' || coalesce(nullif(year, ''), 'n.d.') AS label FROM bib_entries",
    "bibliography_sections": f"""WITH e AS (SELECT doc_id, bib_id, '<span id="ref-' || entry_id || '"></span> ' || {_apa(_COLUMNS)} AS line, {_LANG.format(t="(coalesce(title, '') || ' ' || coalesce(author, ''))")} AS language FROM bib_entries WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY bib_id) FILTER (language = 'fa') AS fa, string_agg(line, chr(10) || chr(10) ORDER BY bib_id) FILTER (language <> 'fa') AS other FROM e GROUP BY 1)
SELECT doc_id, '## کتاب‌نامه' || chr(10) || chr(10) || concat_ws(chr(10), '### منابع فارسی' || chr(10) || chr(10) || fa || chr(10), CASE WHEN fa IS NOT NULL THEN '### منابع انگلیسی' || chr(10) || chr(10) || other || chr(10) ELSE other || chr(10) END) AS mdx FROM g""",
    "citations_rendered": f"""WITH n AS (SELECT DISTINCT node_uid, args[1] AS keys FROM nodes WHERE kind = 'command' AND name = 'cite' AND len(args) > 0 AND args[1] IS NOT NULL),
k AS (SELECT node_uid, i, trim(x[i]) AS k FROM (SELECT node_uid, string_split(keys, ',') AS x FROM n), unnest(range(1, len(x) + 1)) AS u(i) WHERE trim(x[i]) <> ''),
e AS (SELECT entry_id, arg_min({_SHORT}, bib_id) AS short, arg_min(coalesce(nullif(year, ''), 'n.d.'), bib_id) AS year FROM bib_entries GROUP BY 1),
l AS (SELECT k.*, e.entry_id IS NOT NULL AS known, short, year FROM k LEFT JOIN e ON k.k = e.entry_id)
SELECT c AS command, node_uid, CASE WHEN c = 'citep' THEN '(' ELSE '' END || string_agg(CASE WHEN c = 'citet' THEN CASE WHEN known THEN short ELSE k END || ' [(' || CASE WHEN known THEN year ELSE '' END || ')](#ref-' || k || ') p. 3'
 ELSE '[' || CASE WHEN known THEN short || ', ' || year ELSE k END || ', p. 3](#ref-' || k || ')' END, '; ' ORDER BY i) || CASE WHEN c = 'citep' THEN ')' ELSE '' END AS mdx FROM l, (VALUES ('cite'), ('citep'), ('citet')) AS v(c) GROUP BY 1, 2""",
}
