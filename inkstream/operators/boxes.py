"""Boxes of every notation as rows with kind, title and body, and as components.

Native expressions: one pass over the texts. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import rx
from inkstream.operators.blocks import trimmed

#: Component and kind by environment; kinds by word of a callout, by directive and by class, in the order of search.
ENVIRONMENTS = {
    "theorem": ("Theorem", "theorem"), "lemma": ("Theorem", "lemma"), "corollary": ("Theorem", "corollary"), "proposition": ("Theorem", "proposition"), "definition": ("Definition", ""), "example": ("Example", ""), "proof": ("Proof", ""),
    "remark": ("Admonition", "note"), "note": ("Admonition", "note"), "warningbox": ("Admonition", "warning"), "notebox": ("Admonition", "note"), "caution": ("Admonition", "caution"), "important": ("Admonition", "important"),
}
CALLOUTS = {"NOTE": "note", "TIP": "tip", "INFO": "info", "WARNING": "warning", "DANGER": "danger", "CAUTION": "caution", "IMPORTANT": "important", "EXAMPLE": "example", "ABSTRACT": "info", "TODO": "tip", "BUG": "danger", "QUOTE": "note"}
DIRECTIVES = {"note": "note", "tip": "tip", "warning": "warning", "danger": "danger", "caution": "caution", "important": "important", "hint": "tip", "attention": "warning", "error": "danger", "seealso": "info"}
CLASSES = (("note", "note"), ("tip", "tip"), ("info", "info"), ("warning", "warning"), ("danger", "danger"), ("caution", "caution"), ("important", "important"), ("alert", "warning"), ("success", "tip"))
#: Patterns. Groups are the word, the title and the body.
PATTERNS = {
    "latex": r"(?s)\\begin\{(" + "|".join(ENVIRONMENTS) + r")\}[ \t\r\n]*(?:\[([^\]]*)\])?(.*?)\\end\{\1\}",
    "tcolorbox": r"(?s)\\begin\{(tcolorbox)\}(?:\[([^\]]*)\])?(.*?)\\end\{tcolorbox\}",
    "callout": r"(?m)^>[ \t]*\[!([A-Z]+)\][ \t]*(.*)$((?:\n>.*)*)",
    "html": r"(?is)<div[ \t\r\n]+class=\"([^\"]*)\"[^>]*()>(.*?)</div>",
    "details": r"(?is)<(details)[^>]*>[ \t\r\n]*(?:<summary[^>]*>(.*?)</summary>)?[ \t\r\n]*(.*?)[ \t\r\n]*</details>",
    "directive": r"(?mi)^\.\.[ \t]+(" + "|".join(DIRECTIVES) + r")::[ \t]*(.*)$((?:\n[ \t]*(?=\n)|\n(?:   |\t).*)*)",
}
LABEL = r"\\label\{([^{}]*)\}"


def _mapped(word: Column, table: dict[str, str], otherwise: str = "note") -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), word), F.lit(otherwise))


def boxes(df: DataFrame, key: str, text: str, sources: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """(key, source, pos, kind, title, body, label, component, mdx): the boxes of each text; title and label are null if there is none."""

    def found(source: str) -> Column:
        groups = F.arrays_zip(*(rx.every(F.col(text), PATTERNS[source], i).alias(n) for i, n in ((1, "word"), (2, "title"), (3, "body"))))
        return F.transform(groups, lambda g, i: F.struct(F.lit(source).alias("source"), i.cast("bigint").alias("pos"), g["word"].alias("word"), g["title"].alias("title"), g["body"].alias("body")))

    empty = F.array().cast("array<struct<source:string,pos:bigint,word:string,title:string,body:string>>")
    out = df.select(key, F.inline(F.concat(*(F.coalesce(found(s), empty) for s in sources))))
    is_ = lambda *s: F.col("source").isin(*s)
    option = F.col("title")
    named = F.nullif(F.trim(F.regexp_extract(option, r"title[ ]*=[ ]*\{?([^,\]}]+)", 1)), F.lit(""))
    title = F.when(is_("tcolorbox"), named).otherwise(F.nullif(F.trim(F.coalesce(option, F.lit(""))), F.lit("")))
    component = F.when(is_("latex"), _mapped(F.col("word"), {k: v[0] for k, v in ENVIRONMENTS.items()}, "Admonition")).when(is_("details"), "Details").otherwise("Admonition")
    by_class = None
    for sign, kind in CLASSES:
        test = F.lower("word").contains(sign)
        by_class = F.when(test, kind) if by_class is None else by_class.when(test, kind)
    low = F.lower(F.coalesce(option, F.lit("")))
    kind = (
        F.when(is_("latex"), _mapped(F.col("word"), {k: v[1] for k, v in ENVIRONMENTS.items()}, "")).when(is_("callout"), _mapped(F.col("word"), CALLOUTS)).when(is_("directive"), _mapped(F.lower("word"), DIRECTIVES))
        .when(is_("html"), by_class.otherwise("note")).when(is_("details"), "").otherwise(F.when(low.rlike("orange|warning|red"), "warning").when(low.contains("green"), "tip").otherwise("note"))
    )
    lines = F.when(is_("callout"), F.regexp_replace("body", r"(?m)^>[ \t]?[ \t]*", "")).when(is_("directive"), F.regexp_replace("body", r"(?m)^[ \t]+|[ \t]+$", "")).otherwise(F.col("body"))
    label = F.when(is_("latex", "tcolorbox"), F.nullif(F.regexp_extract("body", LABEL, 1), F.lit("")))
    body = trimmed(F.when(is_("latex", "tcolorbox"), F.regexp_replace("body", LABEL, "")).otherwise(lines))
    out = out.select(key, "source", "pos", kind.alias("kind"), title.alias("title"), body.alias("body"), label.alias("label"), component.alias("component"))
    return out.withColumn("mdx", rendered())


def rendered() -> Column:
    """A box as a component."""
    attribute = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f' {n}="'), c, F.lit('"'))).otherwise("")
    head = F.concat(F.lit("<"), F.col("component"), attribute("type", F.col("kind")), attribute("title", F.col("title")), attribute("id", F.col("label")), F.lit(">\n"))
    return F.concat(head, F.when(F.col("body") != "", F.concat(F.lit("\n"), F.col("body"), F.lit("\n\n"))).otherwise(""), F.lit("</"), F.col("component"), F.lit(">"))
