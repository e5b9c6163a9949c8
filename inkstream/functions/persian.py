"""Persian text: half-spaces, letters, digits, quotation marks, spacing and direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import rx

ZWNJ = "\u200c"
#: Letters and digits that are mapped one to one.
ARABIC_LETTERS = ("\u064a\u0643\u0649\u06c0", "\u06cc\u06a9\u06cc\u06c1")
ARABIC_LETTERS_SHORT = ("\u064a\u0643", "\u06cc\u06a9")
TO_PERSIAN_DIGITS = ("0123456789\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹")
TO_LATIN_DIGITS = ("۰۱۲۳۴۵۶۷۸۹", "0123456789")
#: Letters that count as Persian and as Latin script.
PERSIAN = "[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff]"
LATIN = "[a-zA-Z]"
#: Spans in which typography is left alone, in order of precedence.
PROTECTED = r"(?s)```.*?```|`[^`]+`|\$\$.*?\$\$|\$[^$]+\$|https?://[^ \t\n\r\f]+|<[^>]+>"


def zwnj_count(text: Column) -> Column:
    """number of half-spaces."""
    return (F.length(text) - F.length(F.replace(text, F.lit(ZWNJ), F.lit("")))).cast("bigint")


def zwnj_positions(text: Column) -> Column:
    """positions of half-spaces, from 0: sums of the lengths between them, in one pass."""
    parts = F.split(text, ZWNJ, -1)
    zero = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["found"], F.array(a["at"] + F.length(x))).alias("found"), (a["at"] + F.length(x) + 1).alias("at"))
    # the piece behind the last one ends the text
    return F.when(text.isNotNull(), F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, step, lambda a: a["found"]))


def zwnj_report(before: Column, after: Column) -> Column:
    """kept if no fewer half-spaces remain; how many were lost."""
    b, a = zwnj_count(before), zwnj_count(after)
    return F.struct(b.alias("before"), a.alias("after"), (a >= b).alias("preserved"), F.greatest(b - a, F.lit(0)).alias("lost"))


def zwnj_report_exact(before: Column, after: Column) -> Column:
    """kept if as many half-spaces remain; the numbers of those lost."""
    b, a = zwnj_count(before), zwnj_count(after)
    return F.struct(b.alias("before"), a.alias("after"), (a == b).alias("preserved"), F.when(b > a, F.sequence(F.lit(0).cast("bigint"), b - a - 1)).otherwise(F.array().cast("array<bigint>")).alias("positions_lost"))


#: A character of private use that stands for a half-space while others are rewritten.
TOKEN = "\ue200"


def protected_zwnj(text: Column, fix) -> Column:
    """``fix`` applied to ``text`` with its half-spaces out of reach."""
    return F.replace(fix(F.replace(text, F.lit(ZWNJ), F.lit(TOKEN))), F.lit(TOKEN), F.lit(ZWNJ))


def ensure_zwnj(word: Column, prefix: str | None = None, suffix: str | None = None) -> Column:
    """a half-space between a prefix or suffix and its stem."""
    if prefix:
        rest = F.substring(word, len(prefix) + 1, 10_000)
        word = F.when(word.startswith(prefix) & (rest != "") & ~rest.startswith(ZWNJ), F.concat(F.lit(prefix + ZWNJ), rest)).otherwise(word)
    if suffix:
        stem = F.left(word, F.greatest(F.length(word) - len(suffix), F.lit(0)))
        word = F.when(word.endswith(suffix) & (stem != "") & ~stem.endswith(ZWNJ), F.concat(stem, F.lit(ZWNJ + suffix))).otherwise(word)
    return word


def fix_letters(text: Column) -> Column:
    """Arabic letters to Persian ones."""
    return F.translate(text, *ARABIC_LETTERS)


def persian_digits(text: Column) -> Column:
    """Latin and Arabic digits to Persian ones."""
    return F.translate(text, *TO_PERSIAN_DIGITS)


def latin_digits(text: Column) -> Column:
    """Persian digits to Latin ones."""
    return F.translate(text, *TO_LATIN_DIGITS)


def guillemets(text: Column) -> Column:
    """straight quotation marks in pairs to guillemets."""
    return F.regexp_replace(F.regexp_replace(text, '"([^"]*)"', "«$1»"), "'([^']*)'", "«$1»")


def spacing(text: Column) -> Column:
    """no space before, one after punctuation."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t\n\r\f]+([:؛؟!])", "$1"), "([.،:؛])(?=[^ \t\n\r\f])", "$1 ")


def outside_protected(text: Column, fix) -> Column:
    """F16: ``fix`` applied outside code, formulas, addresses and tags."""
    return rx.splice(text, PROTECTED, fix_gap=fix)


def normalise(text: Column) -> Column:
    """letters, quotation marks, spacing and digits, outside protected spans."""
    return outside_protected(text, lambda t: persian_digits(spacing(guillemets(fix_letters(t)))))


def normalise_with(text: Column, yeh: bool = True, keh: bool = True, quotes: bool = True, spaces: bool = True, numerals: str = "persian") -> Column:
    """letters, quotation marks, spacing and digits as configured; ۀ stays."""
    letters_from, letters_to = ("\u064a\u0649", "\u06cc\u06cc") if yeh else ("", "")
    letters_from, letters_to = (letters_from + "\u0643", letters_to + "\u06a9") if keh else (letters_from, letters_to)
    digits = {"persian": persian_digits, "latin": latin_digits}.get(numerals, lambda t: t)
    return outside_protected(F.translate(text, letters_from, letters_to) if letters_from else text, lambda t: digits((spacing if spaces else lambda x: x)((guillemets if quotes else lambda x: x)(t))))


#: Prefixes and endings that are joined to their word by a half-space.
_WORD = "([\u0600-\u06ff]{2,})"
_END = "(?=[\\s.,:;!?)،؛»]|$)"


def insert_zwnj(text: Column) -> Column:
    """half-space after می and نمی, before ها, های, هایی, ای, تر and ترین."""
    text = F.regexp_replace(text, f"(?<![\u0600-\u06ff])(می|نمی) +{_WORD}", f"$1{ZWNJ}$2")
    for ending in ("(هایی|های|ها)", "(ای)", "(ترین|تر)"):
        text = F.regexp_replace(text, f"{_WORD} +{ending}{_END}", f"$1{ZWNJ}$2")
    return text


def letters(text: Column) -> Column:
    """Numbers of Persian (fa) and of Latin (en) letters."""
    return F.struct(rx.count(text, PERSIAN).alias("fa"), rx.count(text, LATIN).alias("en"))


#: What is no prose, in order of removal, and a string without which there is none of it.
NOT_PROSE = (("(?s)```.*?```", "```"), ("`[^`]+`", "`"), (r"(?s)\$\$.*?\$\$", "$$"), (r"\$[^$]+\$", "$"), (r"\\[a-zA-Z]+\{[^}]*\}", "\\"), (r"\\[a-zA-Z]+", "\\"), (r"https?://[^ \t\n\r\f]+", "http"))


def prose(text: Column) -> Column:
    """``text`` without code, formulas, commands and addresses.

    A pattern runs only over texts that hold its sign: a substring test costs
    far less than a regular expression that finds nothing.
    """

    def without(pattern: str, sign: str):  # noqa: ANN202
        return lambda t: F.when(t.contains(sign), F.regexp_replace(t, pattern, " ")).otherwise(t)

    for pattern, sign in NOT_PROSE:
        text = rx.let(text, without(pattern, sign))
    return text


def language(text: Column) -> Column:
    """persian_ratio, english_ratio and class (fa+en, fa, en or unknown) of the prose in ``text``."""

    def of_counts(c: Column) -> Column:
        total = c["fa"] + c["en"]
        rf = F.when(total > 0, F.round(c["fa"] / total, 3)).otherwise(0.0)
        re_ = F.when(total > 0, F.round(c["en"] / total, 3)).otherwise(0.0)
        cls = F.when((rf >= 0.15) & (re_ >= 0.15), "fa+en").when(rf > 0.5, "fa").when(re_ > 0.5, "en").otherwise("unknown")
        return F.struct(rf.alias("persian_ratio"), re_.alias("english_ratio"), cls.alias("detected"))

    return rx.let(rx.let(prose(text), letters), of_counts)


def converter_language(text: Column) -> Column:
    """En without Persian letters, fa-en if Latin ones are more than twice as many, else fa."""
    return rx.let(letters(text), lambda c: F.when((c["fa"] == 0) & (c["en"] > 0), "en").when(c["en"] > 2 * c["fa"], "fa-en").otherwise("fa"))


def direction(text: Column) -> Column:
    """P10: direction of a block; empty is rtl, a tenth of either script is mixed unless rtl leads."""

    def of_counts(c: Column) -> Column:
        total = c["fa"] + c["en"]
        share = c["fa"] / F.when(total > 0, total)
        return F.when(total == 0, "ltr").when((share >= 0.1) & (share <= 0.9), F.when(share >= 0.5, "rtl").otherwise("mixed")).when(c["fa"] > c["en"], "rtl").otherwise("ltr")

    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "rtl").otherwise(rx.let(letters(text), of_counts))


def wrap_ltr(text: Column) -> Column:
    """Left-to-right paragraphs in a div."""
    fix = lambda p: F.when((direction(p) == "ltr") & ~p.rlike(r"^\s*(---|```|\$\$|<)"), F.concat(F.lit('<div dir="ltr">\n\n'), p, F.lit("\n\n</div>"))).otherwise(p)
    return F.array_join(F.transform(F.split(text, "\n\n", -1), fix), "\n\n")
