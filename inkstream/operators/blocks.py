"""Blocks of documents as rows: formulas, code, links, footnotes, citations, tables, images and callouts (M, C, L, N, B, T, I, A).

Every extractor takes (key, text) and gives one row for each block with its
position. They are native expressions over whole texts: one narrow pass each.
Null and empty texts have no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import rx, slugs

#: Patterns of blocks. Group 1 and 2 are what the block's row holds.
ENVIRONMENT = r"(?s)\\begin\{(equation|align|gather|multline|eqnarray)\*?\}(.*?)\\end\{(?:equation|align|gather|multline|eqnarray)\*?\}"
DOLLARS = r"(?s)\$\$(.*?)\$\$"
BRACKETS = r"(?s)\\\[(.*?)\\\]"
PARENS = r"(?s)\\\((.*?)\\\)"
INLINE = r"\$([^$\n]+)\$"
FENCE = r"(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```"
LISTING = r"(?s)\\begin\{lstlisting\}(?:\[([^\]]*)\])?(.*?)\\end\{lstlisting\}"
MINTED = r"(?s)\\begin\{minted\}(?:\[[^\]]*\])?\{([a-zA-Z0-9_]+)\}(.*?)\\end\{minted\}"
VERBATIM = r"(?s)\\begin\{(verbatim)\}(.*?)\\end\{verbatim\}"
PRE = r"(?s)<pre[^>]*>[ \t\n]*<code(?:[ ]+class=[\"'](?:language-)?([a-zA-Z0-9_]+)[\"'])?[^>]*>(.*?)</code>[ \t\n]*</pre>"
MARKDOWN_LINK = r"(?:^|[^!])\[([^\]\n]+)\]\(([^) \n]+)\)"
HREF = r"\\href\{([^}]+)\}\{([^}]*)\}"
URL = r"\\url\{([^}]+)\}"
HTML_LINK = r"(?s)<a[ \t\n]+[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
REF = r"\\(ref|cref|eqref|autoref)\{([^}]+)\}"
LABEL = r"\\label\{([^}]+)\}"
CITE = r"\\cite[a-z]*(?:\[([^\]]*)\])?\{([^}]+)\}"
FOOTNOTE = r"\\(footnote|LTRfootnote|endnote)\{((?:[^{}]|\{[^{}]*\})*)\}"
FOOTNOTE_REF = r"\[\^([^\]\s]+)\]"
FOOTNOTE_DEF = r"(?m)^\[\^([^\]\s]+)\]:[ \t]*(.*)$"
MARKDOWN_IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
GRAPHIC = r"\\includegraphics(?:\[([^\]]*)\])?\{([^}]+)\}"
HTML_IMAGE = r"<(img|video|audio|iframe)[ \t\n]+[^>]*src=[\"']([^\"']+)[\"'][^>]*>"
PIPE_ROW = r"(?m)^(\|.+\|)[ \t]*$"
TABULAR = r"(?s)\\begin\{tabular\}\{([^}]*)\}(.*?)\\end\{tabular\}"
HTML_TABLE = r"(?is)<table([^>]*)>(.*?)</table>"
CALLOUT = r"(?m)^>[ \t]*\[!([A-Z]+)\][ \t]*(.*)$"
COMPONENT = r"<(Callout|Admonition|Theorem|Definition|Example|Proof|Image|Figure|Tabs)([ ][^>]*)?>"
THEOREM = r"(?s)\\begin\{(theorem|lemma|corollary|proposition|definition|example|proof|remark|note|warningbox|notebox|caution|important)\}(.*?)\\end\{(?:theorem|lemma|corollary|proposition|definition|example|proof|remark|note|warningbox|notebox|caution|important)\}"
HTML_BOX = r"(?is)<div[ ]+[^>]*class=[\"']([^\"']+)[\"'][^>]*>(.*?)</div>"
DETAILS = r"(?is)<details[^>]*>[ \t\n]*<summary>(.*?)</summary>(.*?)</details>"
HEADING = r"(?m)^(#{1,6})[ \t]+(.+)$"
SECTION = r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}"

#: Kind of callout by its word, and component by environment.
CALLOUT_KINDS = {"NOTE": "note", "TIP": "tip", "INFO": "info", "WARNING": "warning", "DANGER": "danger", "CAUTION": "caution", "IMPORTANT": "important", "EXAMPLE": "example", "ABSTRACT": "info", "TODO": "tip", "BUG": "danger", "QUOTE": "note"}
COMPONENTS = {"theorem": "Theorem", "lemma": "Theorem", "corollary": "Theorem", "proposition": "Theorem", "definition": "Definition", "example": "Example", "proof": "Proof", "remark": "Admonition", "note": "Admonition", "warningbox": "Admonition", "notebox": "Admonition", "caution": "Admonition", "important": "Admonition"}
#: Other names of programming languages.
LANGUAGE_ALIASES = {
    "py": "python", "python3": "python", "js": "javascript", "ts": "typescript", "rb": "ruby", "sh": "bash", "shell": "bash", "zsh": "bash", "yml": "yaml", "tex": "latex", "md": "markdown", "cs": "csharp",
    "c++": "cpp", "c#": "csharp", "f#": "fsharp", "htm": "html", "objective-c": "objc",
}
#: Signs of programming languages, the first that occurs counts.
LANGUAGES = {
    "python": r"def |import |from |class |if __name__", "javascript": r"function |const |let |var |=>|require\(", "typescript": r"interface |type |: string|: number", "html": r"<html|<div|<span|<!DOCTYPE",
    "css": r"\{[^}]*:[^}]*;|\bcolor:", "java": r"public class |System\.out|void main", "cpp": r"#include|std::|cout|cin|int main\(", "rust": r"fn |let mut |println!|impl ", "go": r"func |package |fmt\.",
    "bash": r"#!/bin/|echo |if \[", "sql": r"(?i)SELECT |FROM |WHERE ", "latex": r"\\begin\{|\\end\{|\\section",
}


def blocks(df: DataFrame, key: str, text: str, pattern: str, first: str = "a", second: str = "b") -> DataFrame:
    """(key, pos, first, second): groups 1 and 2 of every match of ``pattern``; pos counts from 0."""
    pairs = F.arrays_zip(rx.every(F.col(text), pattern, 1).alias("x"), rx.every(F.col(text), pattern, 2).alias("y"))
    out = df.select(key, F.posexplode(pairs).alias("pos", "p"))
    return out.select(key, F.col("pos").cast("bigint").alias("pos"), F.col("p.x").alias(first), F.col("p.y").alias(second))


def single(df: DataFrame, key: str, text: str, pattern: str, name: str) -> DataFrame:
    """(key, pos, name): group 1 of every match."""
    out = df.select(key, F.posexplode(rx.every(F.col(text), pattern, 1)).alias("pos", name))
    return out.select(key, F.col("pos").cast("bigint").alias("pos"), name)


def many(df: DataFrame, key: str, text: str, patterns: dict[str, str], first: str = "a", second: str = "b") -> DataFrame:
    """(key, source, pos, first, second): groups 1 and 2 of every match of every pattern, in one pass over the texts."""

    def found(source: str, pattern: str) -> Column:
        pairs = F.arrays_zip(rx.every(F.col(text), pattern, 1).alias("x"), rx.every(F.col(text), pattern, 2).alias("y"))
        return F.transform(pairs, lambda p, i: F.struct(F.lit(source).alias("source"), i.cast("bigint").alias("pos"), p["x"].alias(first), p["y"].alias(second)))

    return df.select(key, F.inline(F.concat(*(F.coalesce(found(s, p), F.array().cast(f"array<struct<source:string,pos:bigint,`{first}`:string,`{second}`:string>>")) for s, p in patterns.items()))))


def kinds_of(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, n): number of matches of each pattern, where there are any."""
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(rx.count(F.col(text), p), F.lit(0).cast("bigint")).alias("n")) for k, p in patterns.items()))
    return df.select(key, F.inline(counts)).where("n > 0")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def code_language(declared: Column, content: Column) -> Column:
    """the declared language by its usual name, or the first one whose signs occur."""
    guess = None
    for name, signs in LANGUAGES.items():
        guess = F.when(content.rlike(signs), name) if guess is None else guess.when(content.rlike(signs), name)
    aliases = F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))
    named = F.nullif(F.lower(F.trim(declared)), F.lit(""))
    return F.coalesce(F.element_at(aliases, named), named, guess, F.lit("text"))


#: Where code stands.
CODE = {"fence": FENCE, "lstlisting": LISTING, "minted": MINTED, "verbatim": VERBATIM, "html": PRE}


def code_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, pos, language, n_lines, content) of fences, listings, minted, verbatim and HTML code."""
    part = many(df, key, text, CODE, "option", "content")
    listing = F.regexp_extract("option", r"language[ ]*=[ ]*\{?([^,}\]]+)\}?", 1)
    declared = F.when(F.col("source") == "lstlisting", listing).when(F.col("source") == "verbatim", "").otherwise(F.col("option"))
    part = part.select(key, "source", "pos", F.coalesce(declared, F.lit("")).alias("declared"), trimmed(F.col("content")).alias("content"))
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1
    return part.select(key, "source", "pos", code_language(F.col("declared"), F.col("content")).alias("language"), lines.cast("bigint").alias("n_lines"), "content")


def listing_options(option: Column) -> Column:
    """language, caption, label and numbers of a listing's options."""
    one = lambda name: F.nullif(F.trim(F.regexp_extract(option, rf"\b{name}[ ]*=[ ]*(?:\{{([^}}]*)\}}|([^,\]]*))", 1)), F.lit(""))
    bare = lambda name: F.nullif(F.trim(F.regexp_extract(option, rf"\b{name}[ ]*=[ ]*(?:\{{([^}}]*)\}}|([^,\]]*))", 2)), F.lit(""))
    return F.struct(*(F.coalesce(one(n), bare(n)).alias(n) for n in ("language", "caption", "label", "numbers")))


def fence(code: Column, language: Column, title: Column, numbered: Column, label: Column) -> Column:
    """a fenced block with its title, line numbers and label."""
    head = F.concat(F.lit("```"), language, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' title="'), title, F.lit('"'))).otherwise(F.lit("")), F.when(numbered, " showLineNumbers").otherwise(""))
    mark = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("{/* label: "), label, F.lit(" */}\n"))).otherwise(F.lit(""))
    return F.concat(mark, head, F.lit("\n"), trimmed(code), F.lit("\n```"))


def link_kind(target: Column) -> Column:
    """Q03: anchor, external, mail or internal."""
    return F.when(target.startswith("#"), "anchor").when(target.rlike("^https?://"), "external").when(target.startswith("mailto:"), "mail").otherwise("internal")


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, pos, label, target, kind)."""
    out = many(df, key, text, {"markdown": MARKDOWN_LINK, "latex": HREF, "html": HTML_LINK})
    first = F.col("source") == "markdown"
    out = out.select(key, "source", "pos", F.when(first, F.col("a")).otherwise(F.col("b")).alias("label"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"))
    return out.select(key, "source", "pos", F.regexp_replace("label", "<[^>]*>", "").alias("label"), "target", link_kind(F.col("target")).alias("kind"))


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, ordinal, cite_key): one row for each cited entry."""
    c = blocks(df, key, text, CITE, "option", "cited")
    c = c.select(key, "pos", F.posexplode(F.split("cited", ",")).alias("ordinal", "cite_key"))
    return c.select(key, "pos", F.col("ordinal").cast("bigint").alias("ordinal"), F.trim("cite_key").alias("cite_key"))


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Q01: (key, pos, level, title) of Markdown headings."""
    h = blocks(df, key, text, HEADING, "marks", "title")
    return h.select(key, "pos", F.length("marks").cast("bigint").alias("level"), F.trim("title").alias("title"))


def pipe_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, r, c, content) of the cells of Markdown tables, rules left out."""
    rows = single(df, key, text, PIPE_ROW, "line").where(~F.col("line").rlike(r"^\|[ :|-]+\|$"))
    inner = F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|", -1)
    cells = rows.select(key, F.col("pos").alias("r"), F.posexplode(inner).alias("c", "content"))
    return cells.select(key, "r", F.col("c").cast("bigint").alias("c"), F.trim("content").alias("content"))


def tabular_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, r, c, content) of LaTeX tables."""
    t = blocks(df, key, text, TABULAR, "spec", "body")
    rows = t.select(key, F.col("pos").alias("table_no"), F.posexplode(F.split(F.regexp_replace("body", r"\\(hline|toprule|midrule|bottomrule)", ""), r"\\\\", -1)).alias("r", "line"))
    rows = rows.where(trimmed(F.col("line")) != "")
    cells = rows.select(key, "table_no", F.col("r").cast("bigint").alias("r"), F.posexplode(F.split("line", "&", -1)).alias("c", "content"))
    return cells.select(key, "table_no", "r", F.col("c").cast("bigint").alias("c"), trimmed(F.col("content")).alias("content"))


def braces_balanced(text: Column) -> Column:
    """whether braces nest; an escaped brace doesn't count."""
    only = F.regexp_replace(F.regexp_replace(text, r"\\[{}\\]", ""), r"[^{}]", "")
    step = lambda a, c: F.when((a < 0) | ((a == 0) & (c == "}")), -1).otherwise(a + F.when(c == "{", 1).otherwise(-1))
    return F.when(only == "", True).otherwise(F.aggregate(F.split(only, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 0)


def environments_match(text: Column) -> Column:
    """Whether the names of opened and closed environments are the same, in sorted order."""
    begins, ends = (F.array_sort(rx.every(text, rf"\\{w}\{{([^}}]+)\}}", 1)) for w in ("begin", "end"))
    return begins == ends


def to_mdx_math(text: Column) -> Column:
    """Formulas and references in the notation of the target."""
    text = F.regexp_replace(text, BRACKETS, r"\$\$$1\$\$")
    text = F.regexp_replace(text, r"(?s)\\\([ \t\n]*(.*?)[ \t\n]*\\\)", r"\$$1\$")
    text = F.regexp_replace(text, r"(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}", r"\$\$$1\$\$")
    for env, to in (("align", "aligned"), ("eqnarray", "aligned"), ("gather", "gathered"), ("multline", "gathered")):
        text = F.regexp_replace(text, rf"(?s)\\begin\{{{env}\*?\}}(.*?)\\end\{{{env}\*?\}}", rf"\$\$\\begin{{{to}}}$1\\end{{{to}}}\$\$")
    return rx.splice(text, r"\\eqref\{[^}]+\}", fix_match=_reference)


def _reference(command: Column) -> Column:
    """A link to the id of the label in a referring command; cref names the kind of what it refers to."""
    label = F.regexp_extract(command, r"\{([^}]+)\}", 1)

    def link(i: Column) -> Column:
        kind = F.when(command.startswith("\\cref"), slugs.label_kind(label)).otherwise("")
        shown = F.when(command.startswith("\\eqref"), F.concat(F.lit("("), i, F.lit(")"))).when(kind != "", F.concat(kind, F.lit(" "), i)).otherwise(i)
        return F.concat(F.lit("["), shown, F.lit("](#"), i, F.lit(")"))

    return rx.let(F.trim(slugs.label_id(label)), link)


def to_mdx_links(text: Column) -> Column:
    """Links and references in the notation of the target."""
    text = F.regexp_replace(text, HREF, "[$2]($1)")
    text = F.regexp_replace(text, URL, "[$1]($1)")
    text = rx.splice(text, r"\\(?:ref|cref|autoref)\{[^}]+\}", fix_match=_reference)
    return F.regexp_replace(text, r"(?s)<a[ \t\n]+[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", "[$2]($1)")


def escape_jsx(text: Column) -> Column:
    """braces as text."""
    return F.regexp_replace(text, r"([{}])", r"\\$1")


def html_to_jsx(text: Column) -> Column:
    """attributes, comments and void tags in JSX notation."""
    text = F.regexp_replace(text, r"(?s)<!--(.*?)-->", "{/*$1*/}")
    for html, jsx in (("class", "className"), ("for", "htmlFor"), ("colspan", "colSpan"), ("rowspan", "rowSpan"), ("tabindex", "tabIndex"), ("readonly", "readOnly"), ("maxlength", "maxLength")):
        text = F.regexp_replace(text, rf"(<[a-zA-Z][^<>]*[ ]){html}=", f"$1{jsx}=")
    return F.regexp_replace(text, r"<(br|hr|img|input|meta|link)([^<>]*?)[ ]*/?>", "<$1$2 />")
