"""Quality of converted documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import persian, rx

#: Patterns that count elements of a text; the counts are sums over a row.
COUNTERS = {
    "headings": [r"(?m)^#{1,6}[ \t]+", r"\\(chapter|section|subsection|subsubsection)\b", r"(?i)<h[1-6]"],
    "formulas": [r"\$[^$\n]*\$", r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]"],
    "images": [r"!\[[^\]]*\]\([^)]*\)", r"<Image[ ]+src=", r"(?i)<img[ ]+[^>]*src=", r"\\includegraphics"],
    "tables": [r"(?m)^\|.+\|$", r"(?i)<table[^>]*>", r"\\begin\{tabular"],
    "code": [r"```[a-zA-Z0-9_]*", r"(?i)<pre><code|<code"],
}
#: Points of the yes-or-no tests; they sum to 100.
WEIGHTS = {"frontmatter": 20, "components": 15, "imports": 5, "encoding": 5, "compiles": 10, "formulas": 15, "direction": 10, "language": 5, "half_spaces": 10, "quotes": 5}
#: What an issue of each level takes from readiness.
LEVELS = {"error": 15, "warning": 5, "info": 1}


def counters(text: Column) -> Column:
    """Q01: headings, formulas, images, tables, code and half-spaces of ``text``."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(*(sum((rx.count(t, p) for p in patterns), F.lit(0).cast("bigint")).alias(name) for name, patterns in COUNTERS.items()), persian.zwnj_count(t).alias("half_spaces"))


def ratio(source: Column, output: Column) -> Column:
    """share that is kept; 1 if there was nothing."""
    return F.when(source == 0, 1.0).otherwise(output / F.when(source != 0, source))


def content_score(source: Column, output: Column, cap: bool = True) -> Column:
    """Q08: mean of the kept shares, each at most 1, of what the source has; 25 points at best. Q09 takes the least share, uncapped."""
    shares = F.filter(F.array(*(F.when(source[n] > 0, ratio(source[n], output[n])) for n in COUNTERS)), lambda x: x.isNotNull())
    if not cap:
        return F.coalesce(F.array_min(shares), F.lit(1.0)) * 25
    capped = F.transform(shares, lambda x: F.least(x, F.lit(1.0)))
    return F.when(F.size(shares) == 0, 25.0).otherwise(F.aggregate(capped, F.lit(0.0), lambda a, x: a + x) / F.size(shares) * 25)


#: Patterns that count elements of a source and of the MDX made of it.
SOURCE_ELEMENTS = {
    "headings": r"\\(?:chapter|section|subsection|subsubsection|paragraph)", "formulas": r"\$\$|\\\[|\\begin\{(?:equation|align|gather|multline)\}", "images": r"\\includegraphics",
    "tables": r"\\begin\{(?:tabular|longtable|table)\}", "code": r"\\begin\{(?:lstlisting|minted|verbatim)\}|```",
}
OUTPUT_ELEMENTS = {"headings": r"(?m)^#{1,6}\s+", "formulas": r"\$\$|\$[^\$]+\$", "images": r"<Figure|!\[", "tables": r"<table|(?m:^\|)", "code": "```"}


def analysed(text: Column, elements: dict[str, str]) -> Column:
    """Q07: elements and words of a source (SOURCE_ELEMENTS) or of an MDX text's body (OUTPUT_ELEMENTS)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(*(rx.count(t, p).alias(n) for n, p in elements.items()), rx.count(t, r"\S+").alias("words"))


def without_head(text: Column) -> Column:
    """An MDX text behind its frontmatter."""
    end = F.locate("---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.substring(text, end + 3, 2_000_000_000)).otherwise(text)


def _shares(source: Column, output: Column) -> Column:
    return F.filter(F.array(*(F.when(source[n] > 0, output[n] / F.when(source[n] > 0, source[n])) for n in SOURCE_ELEMENTS)), lambda x: x.isNotNull())


def content_points(source: Column, output: Column) -> Column:
    """Q08: 25 points times the mean of the kept shares, each 1 at most, and of the words' share, which may vary by a tenth."""
    words = output["words"] / F.when(source["words"] > 0, source["words"])
    by_words = F.when(words.between(0.9, 1.1), 1.0).when(words < 0.9, words / 0.9).otherwise(1.0 - (words - 1.1) / 0.1)
    kept = F.filter(F.concat(F.transform(_shares(source, output), lambda x: F.least(x, F.lit(1.0))), F.array(by_words)), lambda x: x.isNotNull())
    return F.when(F.size(kept) == 0, 25.0).otherwise(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept) * 25)


def quality_score(source: Column, output: Column, structural: Column | bool = True, math: Column | float = 1.0, persian: Column | float = 1.0, links: Column | float = 1.0) -> Column:
    """Q09: structure 25, least kept share times 25, formulas 20, Persian 20, links 10, rounded to even."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.bround(F.when(lit(structural), 25.0).otherwise(0.0) + F.coalesce(F.array_min(_shares(source, output)), F.lit(1.0)) * 25 + lit(math) * 20 + lit(persian) * 20 + lit(links) * 10).cast("bigint")


def preserved(source: Column, output: Column) -> Column:
    """Q02: nine tenths of headings and formulas and all half-spaces are kept."""
    return (ratio(source["headings"], output["headings"]) >= 0.9) & (ratio(source["formulas"], output["formulas"]) >= 0.9) & (ratio(source["half_spaces"], output["half_spaces"]) >= 1.0)


def frontmatter(text: Column) -> Column:
    """The block between the first two rules; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^---\n((?s).*?)\n---", 1)


def body(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^---\n(?s).*?\n---[ \t]*\n?", "")


def issues(text: Column, fmt: Column) -> Column:
    """Q06: issues (level, code) of a source text of the given format."""
    t = F.coalesce(text, F.lit(""))
    issue = lambda when, level, code: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = F.array(
        issue(F.trim(t) == "", "error", "empty"),
        issue(F.length(t) > 10_000_000, "warning", "large"),
        issue(t.contains("\ufffd"), "error", "encoding"),
        issue((fmt == "latex") & (rx.count(t, r"\{") != rx.count(t, r"\}")), "error", "braces"),
        issue((fmt == "latex") & (rx.count(t, r"\\begin\{") != rx.count(t, r"\\end\{")), "error", "environments"),
        issue((fmt == "latex") & ~rx.has(t, r"\\documentclass"), "info", "no-class"),
        issue((fmt == "html") & ~rx.has(t, r"(?i)<html"), "info", "no-html"),
        issue((fmt == "markdown") & ~t.startswith("---"), "warning", "no-frontmatter"),
        issue(rx.has(t, "[\u064a\u0643]"), "info", "arabic-letters"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def readiness(found: Column) -> Column:
    """100 less the points of each issue, 0 at least."""
    points = F.aggregate(found, F.lit(0), lambda a, x: a + F.when(x["level"] == "error", LEVELS["error"]).when(x["level"] == "warning", LEVELS["warning"]).otherwise(LEVELS["info"]))
    return F.greatest(F.lit(100) - points, F.lit(0)).cast("bigint")


def structure(text: Column) -> list[Column]:
    """Q11, Q12: tests of an MDX text."""
    t = F.coalesce(text, F.lit(""))
    opened, closed = rx.count(t, r"<[A-Z][A-Za-z]*(?:[ ][^>]*)?>") - rx.count(t, r"<[A-Z][A-Za-z]*(?:[ ][^>]*)?/>"), rx.count(t, r"</[A-Z][A-Za-z]*>")
    return [
        (frontmatter(text) != "").alias("frontmatter"),
        (~rx.has(t, r"<[a-z][^>]*[ ]class=")).alias("no_class"),
        (opened == closed).alias("closed"),
        (~rx.has(t, r"<[A-Z]") | rx.has(t, r"(?m)^import[ ]")).alias("imports"),
        (~t.contains("\ufffd")).alias("encoding"),
        (rx.count(t, r"\{") == rx.count(t, r"\}")).alias("braces"),
        (rx.count(t, r"```") % 2 == 0).alias("fences"),
        (~rx.has(t, '"[^"\n]*[\u0600-\u06ff][^"\n]*"')).alias("quotes"),
    ]


def grade(score: Column) -> Column:
    """F42."""
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor")


def weighted(flags: dict[str, Column]) -> Column:
    """Q10: points of the tests passed."""
    return sum((F.when(flags[name], points).otherwise(0) for name, points in WEIGHTS.items() if name in flags), F.lit(0)).cast("bigint")
