"""Queries on blocks of documents, chapters and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import rx
from inkstream.operators import blocks as B
from inkstream.operators import boxes, figures
from inkstream.sources.tables import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text")


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", F.col("mdx_content").alias("text"))


_MATH = {"environment": B.ENVIRONMENT, "dollars": B.DOLLARS, "brackets": B.BRACKETS, "parens": B.PARENS}
_IMAGES = {"markdown": B.MARKDOWN_IMAGE, "latex": B.GRAPHIC, "html": B.HTML_IMAGE}
_BOXES = {"callout": B.CALLOUT, "theorem": B.THEOREM, "html_box": B.HTML_BOX, "details": B.DETAILS, "component": B.COMPONENT}


def math_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of every document by kind."""
    return B.kinds_of(_docs(spark, sf_dir), "doc_id", "text", _MATH)


def math_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display formulas of chapters."""
    return B.single(_chapters(spark, sf_dir), "chapter_id", "text", B.DOLLARS, "tex").select("chapter_id", "pos", B.trimmed(F.col("tex")).alias("tex"))


def math_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula environments of nodes as display formulas."""
    n = table(spark, sf_dir, "nodes").where("name in ('equation', 'align') and body is not null").select("node_uid", "name", "body").distinct()
    tex = F.concat(F.lit("\\begin{"), F.col("name"), F.lit("}"), F.col("body"), F.lit("\\end{"), F.col("name"), F.lit("}"))
    return n.select("node_uid", "name", B.to_mdx_math(tex).alias("mdx"), F.regexp_extract("body", B.LABEL, 1).alias("label"))


def math_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces and environments of math nodes and environment bodies."""
    n = table(spark, sf_dir, "nodes").where("kind in ('math', 'environment')").select("node_uid", "kind", F.coalesce("content", "body", F.lit("")).alias("t")).distinct()
    return n.select("node_uid", "kind", B.braces_balanced(F.col("t")).alias("balanced"), B.environments_match(F.col("t")).alias("matched"))


def math_to_mdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of documents after conversion."""
    t = B.to_mdx_math(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", rx.count(t, r"\$\$").alias("n_marks"), rx.count(t, r"\\\[|\\\(").alias("n_left"), F.length(t).cast("bigint").alias("n_chars"))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of chapters."""
    return B.code_blocks(_chapters(spark, sf_dir), "chapter_id", "text").drop("content")


def code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of documents by source and language."""
    return B.code_blocks(_docs(spark, sf_dir), "doc_id", "text").groupBy("source", "language").agg(F.count("*").alias("n_blocks"), F.sum("n_lines").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language of every code environment."""
    n = table(spark, sf_dir, "nodes").where("name in ('lstlisting', 'minted', 'verbatim')").select("node_uid", "name", F.coalesce("body", F.lit("")).alias("b")).distinct()
    return n.select("node_uid", "name", B.code_language(F.lit(""), F.col("b")).alias("language"))


def links_of_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of chapters."""
    return B.links(_chapters(spark, sf_dir), "chapter_id", "text")


def _text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").where("kind = 'text' and content is not null").select("node_uid", "content").distinct()


def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of text nodes by source and kind."""
    return B.links(_text_nodes(spark, sf_dir), "node_uid", "content").groupBy("source", "kind").agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets"))


def references_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of chapters with the label they resolve to in their document, if any."""
    c = table(spark, sf_dir, "chapters").select("chapter_id", "doc_id", F.col("mdx_content").alias("text"), "labels")
    refs = B.blocks(c, "chapter_id", "text", B.REF, "command", "label").join(c.select("chapter_id", "doc_id"), "chapter_id")
    labels = c.select("doc_id", F.explode("labels").alias("label", "target")).groupBy("doc_id", "label").agg(F.max("target").alias("target"))
    return refs.join(labels, ["doc_id", "label"], "left").select("chapter_id", "pos", "command", "label", F.coalesce("target", F.concat(F.lit("#"), "label")).alias("target"), F.col("target").isNotNull().alias("resolved"))


def citations_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of command nodes and texts, joined to the entries of the same key."""
    n = table(spark, sf_dir, "nodes").where("kind = 'text' and content is not null").select("node_uid", F.col("content").alias("text")).distinct()
    cites = B.citations(n, "node_uid", "text")
    entries = table(spark, sf_dir, "bib_entries").groupBy("entry_id").agg(F.min("bib_id").alias("bib_id"), F.count("*").alias("n_entries"))
    return cites.join(entries, cites["cite_key"] == entries["entry_id"], "left").select("node_uid", "pos", "ordinal", "cite_key", "bib_id", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnote references of chapters, numbered, and whether each is defined."""
    refs = B.single(_chapters(spark, sf_dir), "chapter_id", "text", B.FOOTNOTE_REF, "mark")
    defs = B.blocks(_chapters(spark, sf_dir), "chapter_id", "text", B.FOOTNOTE_DEF, "mark", "note").groupBy("chapter_id", "mark").agg(F.min("note").alias("note"))
    return refs.join(defs, ["chapter_id", "mark"], "left").select("chapter_id", (F.col("pos") + 1).alias("number"), "mark", F.coalesce("note", F.lit("")).alias("note"), F.col("note").isNotNull().alias("defined"))


def latex_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX footnotes of text nodes by kind."""
    return B.blocks(_text_nodes(spark, sf_dir), "node_uid", "content", B.FOOTNOTE, "kind", "note").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("note")).alias("n_chars"), F.countDistinct("node_uid").alias("n_nodes"))


def bibliography_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by type and language of their title."""
    e = table(spark, sf_dir, "bib_entries").select("entry_type", "doc_id", rx.count(F.coalesce("title", F.lit("")), "[\u0600-\u06ff]").alias("fa"), rx.count(F.coalesce("title", F.lit("")), "[A-Za-z\u00c0-\u024f\u0600-\u06ff]").alias("al"))
    lang = F.when((F.col("al") > 0) & (F.col("fa") / F.when(F.col("al") > 0, F.col("al")) > 0.3), "fa").otherwise("en")
    return e.groupBy("entry_type", lang.alias("title_lang")).agg(F.count("*").alias("n_entries"), F.countDistinct("doc_id").alias("n_docs"))


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the JSON of each entry."""
    e = table(spark, sf_dir, "bib_entries").select("bib_id", "raw_fields")
    return e.select("bib_id", *(F.get_json_object("raw_fields", f"$.{c}").alias(f"raw_{c}") for c in ("title", "author", "year", "doi")))


def pipe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the Markdown tables of chapters."""
    return B.pipe_cells(_chapters(spark, sf_dir), "chapter_id", "text")


def tabular_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of LaTeX tables in environment bodies."""
    n = table(spark, sf_dir, "nodes").where("kind = 'environment' and body is not null").select("node_uid", "body").distinct()
    return B.tabular_cells(n, "node_uid", "body")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of HTML tables."""
    t = B.blocks(_docs(spark, sf_dir).unionByName(_chapters(spark, sf_dir).withColumnRenamed("chapter_id", "doc_id")), "doc_id", "text", B.HTML_TABLE, "attributes", "body")
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.sum(rx.count(F.col("body"), "(?i)<tr")).alias("n_rows"), F.sum(rx.count(F.col("body"), "(?i)<t[dh]")).alias("n_cells"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of chapters and text nodes by source."""
    n = table(spark, sf_dir, "nodes").where("kind in ('text', 'environment')").select(F.col("node_uid").alias("row_id"), F.coalesce("content", "body").alias("text")).distinct()
    c = _chapters(spark, sf_dir).select((-F.col("chapter_id")).alias("row_id"), "text")
    return B.many(n.unionByName(c), "row_id", "text", _IMAGES, "note", "src").withColumn("note", F.coalesce("note", F.lit("")))


def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of chapters by kind."""
    return B.kinds_of(_chapters(spark, sf_dir), "chapter_id", "text", _BOXES)


def theorems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theorem-like nodes with the component that shows them."""
    kinds = F.create_map(*(F.lit(x) for kv in B.COMPONENTS.items() for x in kv))
    n = table(spark, sf_dir, "nodes").where(F.col("name").isin(*B.COMPONENTS)).select("node_uid", "doc_id", "name").distinct()
    return n.groupBy("name", F.element_at(kinds, F.col("name")).alias("component")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def node_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theorem-like environments of nodes as components with title, label and body."""
    n = table(spark, sf_dir, "nodes").where(F.col("name").isin(*boxes.ENVIRONMENTS) & F.col("body").isNotNull()).select("node_uid", "name", "opts", "body").distinct()
    title = F.when(F.size("opts") > 0, F.concat(F.lit("["), F.col("opts")[0], F.lit("]"))).otherwise("")
    text = F.concat(F.lit("\\begin{"), F.col("name"), F.lit("}"), title, F.col("body"), F.lit("\\end{"), F.col("name"), F.lit("}"))
    return boxes.boxes(n.select("node_uid", text.alias("text")), "node_uid", "text", ("latex",)).where("pos = 0").drop("pos", "source")


def callout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callouts of chapters as components with title and body."""
    return boxes.boxes(_chapters(spark, sf_dir), "chapter_id", "text", ("callout",)).drop("source", "label")


def all_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every notation in documents, chapters and text nodes, counted by source, kind and component."""
    texts = _docs(spark, sf_dir).select("text").unionByName(_chapters(spark, sf_dir).select("text")).unionByName(_text_nodes(spark, sf_dir).select(F.col("content").alias("text")))
    found = boxes.boxes(texts.withColumn("k", F.lit(1)), "k", "text")
    return found.groupBy("source", "kind", "component").agg(F.count("*").alias("n"), F.count("title").alias("n_titled"), F.sum(F.length("body")).alias("n_chars"))


def figure_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of nodes with source, caption and label, as components."""
    n = table(spark, sf_dir, "nodes").where("name = 'figure' and body is not null").select("node_uid", "body").distinct()
    text = F.concat(F.lit("\\begin{figure}"), F.col("body"), F.lit("\\end{figure}"))
    return figures.figures(n.select("node_uid", text.alias("text")), "node_uid", "text").drop("parts", "position", "width")


def components_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of chapters against what they import."""
    used = B.single(_chapters(spark, sf_dir), "chapter_id", "text", B.COMPONENT, "component").select("chapter_id", "component").distinct()
    imported = B.single(_chapters(spark, sf_dir), "chapter_id", "text", r"(?m)^import[ ]*\{([^}]*)\}", "names").select("chapter_id", F.explode(F.split("names", ",")).alias("n")).select("chapter_id", F.trim("n").alias("component")).distinct()
    return used.join(imported.withColumn("imported", F.lit(True)), ["chapter_id", "component"], "full").select("chapter_id", "component", F.coalesce("imported", F.lit(False)).alias("imported"))


def headings_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of chapters."""
    return B.headings(_chapters(spark, sf_dir), "chapter_id", "text")


def latex_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of LaTeX documents in order."""
    d = spread(table(spark, sf_dir, "documents")).where("source_format = 'latex'").select("doc_id", "text")
    return B.blocks(d, "doc_id", "text", B.SECTION, "command", "title")


def jsx_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML of text nodes in JSX notation."""
    n = table(spark, sf_dir, "nodes").where("kind = 'text' and content like '%<%'").select("node_uid", "content").distinct()
    return n.select("node_uid", B.html_to_jsx(F.col("content")).alias("jsx"))


_FUNCTIONS = (math_stats, math_blocks, math_environments, math_validation, math_to_mdx, code_blocks, code_stats, code_nodes, links_of_chapters, link_stats, references_resolved, citations_resolved, footnotes, latex_footnotes, bibliography_stats, raw_fields, pipe_cells, tabular_cells, html_tables, images, callouts, theorems, figure_models, node_boxes, callout_boxes, all_boxes, components_used, headings_outline, latex_sections, jsx_conversion)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _pairs(key: str, text: str, source: str, pattern: str) -> str:
    """Rows (key, pos, a, b) of all matches, as a subquery."""
    p = _q(pattern)
    return f"(SELECT {key}, i - 1 AS pos, x[i] AS a, y[i] AS b FROM (SELECT {key}, regexp_extract_all({text}, '{p}', 1) AS x, regexp_extract_all({text}, '{p}', 2) AS y FROM {source}), unnest(range(1, len(x) + 1)) AS u(i))"


def _one(key: str, text: str, source: str, pattern: str) -> str:
    return f"(SELECT {key}, i - 1 AS pos, x[i] AS a FROM (SELECT {key}, regexp_extract_all({text}, '{_q(pattern)}', 1) AS x FROM {source}), unnest(range(1, len(x) + 1)) AS u(i))"


def _kinds(key: str, text: str, source: str, patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT {key}, '{k}' AS kind, len(regexp_extract_all({text}, '{_q(p)}')) AS n FROM {source}) WHERE n > 0" for k, p in patterns.items())


_TRIM = "regexp_replace({c}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
_NODES = "(SELECT DISTINCT node_uid, content FROM nodes WHERE kind = 'text' AND content IS NOT NULL)"
def _guess(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{_q(p)}') THEN '{k}'" for k, p in B.LANGUAGES.items()) + " ELSE 'text' END"


_KIND = "CASE WHEN starts_with(target, '#') THEN 'anchor' WHEN regexp_matches(target, '^https?://') THEN 'external' WHEN starts_with(target, 'mailto:') THEN 'mail' ELSE 'internal' END"


def _links(key: str, text: str, source: str) -> str:
    return f"""(SELECT {key}, source, pos, regexp_replace(label, '<[^>]*>', '', 'g') AS label, target, {_KIND} AS kind FROM (
SELECT {key}, 'markdown' AS source, pos, a AS label, b AS target FROM {_pairs(key, text, source, B.MARKDOWN_LINK)} UNION ALL
SELECT {key}, 'latex', pos, b, a FROM {_pairs(key, text, source, B.HREF)} UNION ALL SELECT {key}, 'html', pos, b, a FROM {_pairs(key, text, source, B.HTML_LINK)}))"""


#: Other names of languages, written out.
_ALIAS = "CASE {c} WHEN 'py' THEN 'python' WHEN 'python3' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'sh' THEN 'bash' WHEN 'shell' THEN 'bash' WHEN 'zsh' THEN 'bash' WHEN 'yml' THEN 'yaml' WHEN 'tex' THEN 'latex' WHEN 'md' THEN 'markdown' WHEN 'cs' THEN 'csharp' WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp' WHEN 'f#' THEN 'fsharp' WHEN 'htm' THEN 'html' WHEN 'objective-c' THEN 'objc' ELSE {c} END"


def _code(key: str, text: str, source: str) -> str:
    parts = []
    for name, pattern in (("fence", B.FENCE), ("lstlisting", B.LISTING), ("minted", B.MINTED), ("verbatim", B.VERBATIM), ("html", B.PRE)):
        declared = "regexp_extract(a, 'language[ ]*=[ ]*\\{?([^,}\\]]+)\\}?', 1)" if name == "lstlisting" else "''" if name == "verbatim" else "a"
        parts.append(f"SELECT {key}, '{name}' AS source, pos, coalesce({declared}, '') AS d, {_TRIM.format(c='b')} AS t FROM {_pairs(key, text, source, pattern)}")
    return f"(SELECT {key}, source, pos, coalesce({_ALIAS.format(c="nullif(lower(trim(d)), '')")}, {_guess('t')}) AS language, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines FROM ({' UNION ALL '.join(parts)}))"


_BOX = "'<' || component || CASE WHEN kind <> '' THEN ' type=\"' || kind || '\"' ELSE '' END || CASE WHEN title IS NOT NULL THEN ' title=\"' || title || '\"' ELSE '' END || {label}'>' || chr(10) || CASE WHEN body <> '' THEN chr(10) || body || chr(10) || chr(10) ELSE '' END || '</' || component || '>'"
SQL = {
    "figure_models": r"""WITH b AS (SELECT DISTINCT node_uid, body FROM nodes WHERE name = 'figure' AND body IS NOT NULL),
f AS (SELECT node_uid, nullif(trim(regexp_extract(body, '\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}', 1)), '') AS src, nullif(trim(regexp_extract(body, '\\caption\{([^{}]*)\}', 1)), '') AS caption, nullif(trim(regexp_extract(body, '\\label\{([^{}]*)\}', 1)), '') AS label FROM b)
SELECT node_uid, 'figure' AS kind, CAST(0 AS BIGINT) AS pos, src, caption, label, '<Figure' || CASE WHEN label IS NOT NULL THEN ' id="' || label || '"' ELSE '' END || '>' || chr(10) || '  <Image src="' || coalesce(src, '') || '" alt="' || coalesce(caption, '') || '" />' || chr(10)
 || CASE WHEN caption IS NOT NULL THEN '  <figcaption>' || caption || '</figcaption>' || chr(10) ELSE '' END || '</Figure>' AS mdx FROM f""",
    "node_boxes": rf"""WITH n AS (SELECT DISTINCT node_uid, name, nullif(trim(opts[1]), '') AS title, body AS b FROM nodes WHERE body IS NOT NULL AND name IN ('theorem', 'lemma', 'corollary', 'proposition', 'definition', 'example', 'proof', 'remark', 'note', 'warningbox', 'notebox', 'caution', 'important')),
p AS (SELECT node_uid, title, nullif(regexp_extract(b, '\\label\{{([^{{}}]*)\}}', 1), '') AS label, {_TRIM.format(c="regexp_replace(b, '" + chr(92) * 2 + "label" + chr(92) + "{[^{}]*" + chr(92) + "}', '', 'g')")} AS body,
 CASE WHEN name IN ('theorem', 'lemma', 'corollary', 'proposition') THEN 'Theorem' WHEN name = 'definition' THEN 'Definition' WHEN name = 'example' THEN 'Example' WHEN name = 'proof' THEN 'Proof' ELSE 'Admonition' END AS component,
 CASE WHEN name IN ('definition', 'example', 'proof') THEN '' WHEN name IN ('remark', 'notebox') THEN 'note' WHEN name = 'warningbox' THEN 'warning' ELSE name END AS kind FROM n)
SELECT node_uid, kind, title, body, label, component, {_BOX.format(label="CASE WHEN label IS NOT NULL THEN ' id=" + chr(34) + "' || label || '" + chr(34) + "' ELSE '' END || ")} AS mdx FROM p""",
    "callout_boxes": rf"""WITH c AS (SELECT chapter_id, regexp_extract_all(mdx_content, '(?m)^>[ \t]*\[!([A-Z]+)\][ \t]*(.*)$((?:\n>.*)*)', 1) AS w, regexp_extract_all(mdx_content, '(?m)^>[ \t]*\[!([A-Z]+)\][ \t]*(.*)$((?:\n>.*)*)', 2) AS t, regexp_extract_all(mdx_content, '(?m)^>[ \t]*\[!([A-Z]+)\][ \t]*(.*)$((?:\n>.*)*)', 3) AS b FROM chapters),
p AS (SELECT chapter_id, i - 1 AS pos, CASE w[i] WHEN 'TIP' THEN 'tip' WHEN 'TODO' THEN 'tip' WHEN 'INFO' THEN 'info' WHEN 'ABSTRACT' THEN 'info' WHEN 'WARNING' THEN 'warning' WHEN 'DANGER' THEN 'danger' WHEN 'BUG' THEN 'danger' WHEN 'CAUTION' THEN 'caution' WHEN 'IMPORTANT' THEN 'important' WHEN 'EXAMPLE' THEN 'example' ELSE 'note' END AS kind,
 nullif(trim(t[i]), '') AS title, {_TRIM.format(c="regexp_replace(b[i], '(?m)^>[ " + chr(92) + "t]*', '', 'g')")} AS body, 'Admonition' AS component FROM c, unnest(range(1, len(w) + 1)) AS u(i))
SELECT chapter_id, pos, kind, title, body, component, {_BOX.format(label="")} AS mdx FROM p""".replace("\\\\", "\\"),
    "math_stats": _kinds("doc_id", "text", "documents", _MATH),
    "math_blocks": f"SELECT chapter_id, pos, {_TRIM.format(c='a')} AS tex FROM {_one('chapter_id', 'mdx_content', 'chapters', B.DOLLARS)}",
    "math_environments": f"""SELECT DISTINCT node_uid, name, CASE name WHEN 'equation' THEN '$$' || body || '$$' ELSE '$$' || chr(92) || 'begin{{aligned}}' || body || chr(92) || 'end{{aligned}}$$' END AS mdx, regexp_extract(body, '{B.LABEL}', 1) AS label
FROM nodes WHERE name IN ('equation', 'align') AND body IS NOT NULL""",
    "code_blocks": f"SELECT * FROM {_code('chapter_id', 'mdx_content', 'chapters')}",
    "code_stats": f"SELECT source, language, count(*) AS n_blocks, CAST(sum(n_lines) AS BIGINT) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM {_code('doc_id', 'text', 'documents')} GROUP BY 1, 2",
    "code_nodes": f"SELECT node_uid, name, {_guess('b')} AS language FROM (SELECT DISTINCT node_uid, name, coalesce(body, '') AS b FROM nodes WHERE name IN ('lstlisting', 'minted', 'verbatim'))",
    "links_of_chapters": f"SELECT * FROM {_links('chapter_id', 'mdx_content', 'chapters')}",
    "link_stats": f"SELECT source, kind, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM {_links('node_uid', 'content', _NODES)} GROUP BY 1, 2",
    "references_resolved": f"""WITH r AS (SELECT p.*, c.doc_id FROM {_pairs('chapter_id', 'mdx_content', 'chapters', B.REF)} p JOIN chapters c USING (chapter_id)),
l AS (SELECT doc_id, e.key AS label, max(e.value) AS target FROM (SELECT doc_id, unnest(map_entries(labels)) AS e FROM chapters) GROUP BY 1, 2)
SELECT chapter_id, pos, a AS command, b AS label, coalesce(target, '#' || b) AS target, target IS NOT NULL AS resolved FROM r LEFT JOIN l ON r.doc_id = l.doc_id AND r.b = l.label""",
    "citations_resolved": f"""WITH c AS (SELECT node_uid, pos, i - 1 AS ordinal, trim(k[i]) AS cite_key FROM (SELECT node_uid, pos, string_split(b, ',') AS k FROM {_pairs('node_uid', 'content', _NODES, B.CITE)}), unnest(range(1, len(k) + 1)) AS u(i)),
e AS (SELECT entry_id, min(bib_id) AS bib_id, count(*) AS n_entries FROM bib_entries GROUP BY 1)
SELECT node_uid, pos, ordinal, cite_key, bib_id, coalesce(n_entries, 0) AS n_entries FROM c LEFT JOIN e ON cite_key = entry_id""",
    "footnotes": f"""WITH d AS (SELECT chapter_id, a, min(b) AS note FROM {_pairs('chapter_id', 'mdx_content', 'chapters', B.FOOTNOTE_DEF)} GROUP BY 1, 2)
SELECT r.chapter_id, pos + 1 AS number, r.a AS mark, coalesce(note, '') AS note, note IS NOT NULL AS defined FROM {_one('chapter_id', 'mdx_content', 'chapters', B.FOOTNOTE_REF)} r LEFT JOIN d ON r.chapter_id = d.chapter_id AND r.a = d.a""",
    "latex_footnotes": f"SELECT a AS kind, count(*) AS n, CAST(sum(length(b)) AS BIGINT) AS n_chars, count(DISTINCT node_uid) AS n_nodes FROM {_pairs('node_uid', 'content', _NODES, B.FOOTNOTE)} GROUP BY 1",
    "bibliography_stats": """WITH e AS (SELECT entry_type, doc_id, len(regexp_extract_all(coalesce(title, ''), '[؀-ۿ]')) AS fa, len(regexp_extract_all(coalesce(title, ''), '[A-Za-zÀ-ɏ؀-ۿ]')) AS al FROM bib_entries)
SELECT entry_type, CASE WHEN al > 0 AND fa / al > 0.3 THEN 'fa' ELSE 'en' END AS title_lang, count(*) AS n_entries, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1, 2""",
    "raw_fields": "SELECT bib_id, " + ", ".join(f"json_extract_string(raw_fields, '$.{c}') AS raw_{c}" for c in ("title", "author", "year", "doi")) + " FROM bib_entries",
    "pipe_cells": f"""WITH r AS (SELECT chapter_id, pos, string_split(regexp_replace(a, '^\\||\\|$', '', 'g'), '|') AS c FROM {_one('chapter_id', 'mdx_content', 'chapters', B.PIPE_ROW)} WHERE NOT regexp_matches(a, '^\\|[ :|-]+\\|$'))
SELECT chapter_id, pos AS r, i - 1 AS c, trim(r.c[i]) AS content FROM r, unnest(range(1, len(r.c) + 1)) AS u(i)""",
    "tabular_cells": f"""WITH t AS (SELECT node_uid, pos AS table_no, string_split(regexp_replace(b, '\\\\(hline|toprule|midrule|bottomrule)', '', 'g'), '\\\\') AS l FROM {_pairs('node_uid', 'body', "(SELECT DISTINCT node_uid, body FROM nodes WHERE kind = 'environment' AND body IS NOT NULL)", B.TABULAR)}),
r AS (SELECT node_uid, table_no, i - 1 AS r, string_split(l[i], '&') AS c FROM t, unnest(range(1, len(l) + 1)) AS u(i) WHERE {_TRIM.format(c='l[i]')} <> '')
SELECT node_uid, table_no, r, j - 1 AS c, {_TRIM.format(c='r.c[j]')} AS content FROM r, unnest(range(1, len(r.c) + 1)) AS v(j)""",
    "html_tables": f"""WITH s AS (SELECT doc_id, text FROM documents UNION ALL SELECT chapter_id, mdx_content FROM chapters)
SELECT doc_id, count(*) AS n_tables, CAST(sum(len(regexp_extract_all(b, '(?i)<tr'))) AS BIGINT) AS n_rows, CAST(sum(len(regexp_extract_all(b, '(?i)<t[dh]'))) AS BIGINT) AS n_cells FROM {_pairs('doc_id', 'text', 's', B.HTML_TABLE)} GROUP BY 1""",
    "images": "WITH s AS (SELECT DISTINCT node_uid AS row_id, coalesce(content, body) AS text FROM nodes WHERE kind IN ('text', 'environment') UNION ALL SELECT -chapter_id, mdx_content FROM chapters) " + " UNION ALL ".join(f"SELECT row_id, '{k}' AS source, pos, coalesce(a, '') AS note, b AS src FROM {_pairs('row_id', 'text', 's', p)}" for k, p in _IMAGES.items()),
    "callouts": _kinds("chapter_id", "mdx_content", "chapters", _BOXES),
    "theorems": f"SELECT name, CASE name {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in B.COMPONENTS.items())} END AS component, count(DISTINCT node_uid) AS n, count(DISTINCT doc_id) AS n_docs FROM nodes WHERE name IN ({', '.join(f'''\'{k}\'''' for k in B.COMPONENTS)}) GROUP BY 1, 2",
    "components_used": f"""WITH u AS (SELECT DISTINCT chapter_id, a AS component FROM {_one('chapter_id', 'mdx_content', 'chapters', B.COMPONENT)}),
i AS (SELECT DISTINCT chapter_id, trim(unnest(string_split(a, ','))) AS component FROM {_one('chapter_id', 'mdx_content', 'chapters', "(?m)^import[ ]*" + chr(92) + "{([^}]*)" + chr(92) + "}")})
SELECT coalesce(u.chapter_id, i.chapter_id) AS chapter_id, coalesce(u.component, i.component) AS component, i.component IS NOT NULL AS imported FROM u FULL JOIN i ON u.chapter_id = i.chapter_id AND u.component = i.component""",
    "headings_outline": f"SELECT chapter_id, pos, length(a) AS level, trim(b) AS title FROM {_pairs('chapter_id', 'mdx_content', 'chapters', B.HEADING)}",
    "latex_sections": f"SELECT doc_id, pos, a AS command, b AS title FROM {_pairs('doc_id', 'text', '''(SELECT * FROM documents WHERE source_format = 'latex')''', B.SECTION)}",
}
