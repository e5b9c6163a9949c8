"""Slugs, ids and short forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import rx

#: Persian letters and their Latin spelling in slugs; several letters for some.
SLUG_LETTERS = {
    "ا": "a", "آ": "a", "ب": "b", "پ": "p", "ت": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ذ": "z", "ر": "r", "ز": "z", "ژ": "zh", "س": "s",
    "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "gh", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "و": "v", "ه": "h", "ی": "y",
}
#: Digits in slugs; letters of metadata slugs that differ from the others; and words that have a spelling of their own there, in the order in which they are replaced.
SLUG_DIGITS = dict(zip("۰۱۲۳۴۵۶۷۸۹", "0123456789", strict=True))
METADATA_LETTERS = SLUG_LETTERS | {"ق": "q", "ۀ": "h"}
METADATA_WORDS = {
    "مبانی": "mabani", "منطق": "mantigh", "ریاضی": "riyazi", "اثبات": "esbat", "صوری": "suri", "قضیه": "ghaziyah", "تعریف": "tarif", "لم": "lam", "نتیجه": "natije", "مثال": "mesal", "برهان": "borhan", "فصل": "fasl",
    "مقدمه": "moqaddameh", "کتاب": "ketab", "مقاله": "maqaleh", "درس": "dars", "جزوه": "jozeh", "آموزش": "amuzesh", "راهنما": "rahnameh", "قانون": "ghanun", "اصل": "asl", "حدس": "hads", "فرض": "farz", "شرط": "shart",
    "برابر": "barabar", "وارون": "varun", "مجموعه": "majmueh", "عضو": "ozv", "تابع": "tabe", "رابطه": "rabeteh", "دامنه": "dameh", "برد": "bard", "هم\u200cارز": "ham-arz", "مزدوج": "mozawaj", "وارونه": "varuneh", "متقابل": "motaqabel",
    "متقاطر": "motaqater",
}


def _compatible() -> dict[str, str]:
    """Characters whose compatibility form is other letters, digits or spaces, by the rule itself."""
    table = {}
    for block in ((0xA0, 0x17F), (0x2000, 0x206F), (0x2100, 0x218F), (0x2460, 0x24FF), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF5E)):
        for i in range(block[0], block[1] + 1):
            form = unicodedata.normalize("NFKC", chr(i))
            if form != chr(i):
                table[chr(i)] = form
    return table


_COMPATIBLE = _compatible()
_SPECIAL = "[\u00a0-\u017f\u2000-\u218f\u2460-\u24ff\u3000\ufb00-\ufefc\uff01-\uff5e]"
#: Kinds of labels by prefix.
LABEL_KINDS = {"eq": "معادله", "fig": "شکل", "tab": "جدول", "sec": "بخش", "ch": "فصل", "thm": "قضیه", "def": "تعریف", "lem": "لم", "alg": "الگوریتم", "lst": "برنامه"}


def ascii_slug(text: Column, fallback: Column, most: int = 60) -> Column:
    """lower case, other characters than ASCII dropped, everything but letters and digits to hyphens, cut; ``fallback`` if nothing is left."""
    plain = F.regexp_replace(F.lower(text), r"[^\x00-\x7f]", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(F.coalesce(slug, F.lit("")) == "", fallback).otherwise(slug)


def compatible(text: Column) -> Column:
    """``text`` in compatibility form: widths, ligatures and positional forms; texts without such characters aren't looked at closely."""
    table = F.create_map(*(F.lit(x) for kv in _COMPATIBLE.items() for x in kv))
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(text.rlike(_SPECIAL), each).otherwise(text)


def _spelled(text: Column, table: dict[str, str]) -> Column:
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for letter, latin in table.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def transliterate(text: Column) -> Column:
    """Persian letters and digits in Latin script."""
    return _spelled(F.translate(F.lower(text), "\u064a\u0643", "\u06cc\u06a9"), SLUG_LETTERS | SLUG_DIGITS)


def persian_slug(text: Column, fallback: Column, most: int = 60) -> Column:
    """slug of text in either script; every other character is a hyphen."""
    slug = F.regexp_replace(F.regexp_replace(transliterate(compatible(F.trim(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.when(F.length(slug) > most, F.regexp_replace(F.substring(slug, 1, most), "-+$", "")).otherwise(slug)
    return F.when(F.coalesce(slug, F.lit("")) == "", fallback).otherwise(slug)


def metadata_slug(text: Column, most: int = 60) -> Column:
    """known words and letters spelled out, other letters and digits kept, spaces and low lines to hyphens, the rest dropped; cut at a hyphen; document if nothing is left."""
    for word, latin in METADATA_WORDS.items():
        text = F.replace(text, F.lit(word), F.lit(latin))
    whole = F.regexp_replace(_spelled(text, METADATA_LETTERS | SLUG_DIGITS), r"[^\p{L}\p{N} _-]", "")
    whole = F.regexp_replace(F.regexp_replace(F.lower(whole), "[ _-]+", "-"), "^-+|-+$", "")
    cut = rx.let(whole, lambda s: F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(F.substring(s, 1, most), "-[^-]*$", "")))
    return F.when(F.coalesce(cut, F.lit("")) == "", "document").otherwise(cut)


def valid_slug(slug: Column) -> Column:
    """P14."""
    return F.coalesce(slug.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def unique_slugs(df: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """Repeated slugs get -1, -2 ... in the order given."""
    n = F.row_number().over(W.partitionBy(slug).orderBy(*order)) - 1
    return df.withColumn("unique_slug", F.when(n > 0, F.concat(F.col(slug), F.lit("-"), n.cast("string"))).otherwise(F.col(slug)))


def truncate(text: Column, most: int, mark: str = "...") -> Column:
    """cut at the last space or half-space in the second half of the cut."""
    cut = F.substring(text, 1, most)
    last = most - F.least(*(F.coalesce(F.nullif(F.locate(s, F.reverse(cut)), F.lit(0)), F.lit(most)) for s in (" ", "\u200c")))
    body = F.when(last > most / 2, F.left(cut, last)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(body, F.lit(mark)))


def human_size(n: Column) -> Column:
    """bytes with one decimal place and a unit."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kb, F.concat(F.format_string("%.1f", n.cast("double")), F.lit(" B")))
        .when(n < mb, F.concat(F.format_string("%.1f", F.bround(n / kb, 1)), F.lit(" KB")))
        .when(n < gb, F.concat(F.format_string("%.1f", F.bround(n / mb, 1)), F.lit(" MB")))
        .when(n >= gb, F.concat(F.format_string("%.1f", F.bround(n / gb, 1)), F.lit(" GB")))
    )


def label_id(label: Column) -> Column:
    """colons and underscores to hyphens."""
    return F.translate(label, ":_", "--")


def label_kind(label: Column) -> Column:
    """what a label's prefix stands for; empty if unknown."""
    kinds = F.create_map(*(F.lit(x) for kv in LABEL_KINDS.items() for x in kv))
    return F.coalesce(F.element_at(kinds, F.split_part(label, F.lit(":"), F.lit(1))), F.lit(""))


def unescape(text: Column) -> Column:
    """six HTML entities."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def iso_date(text: Column, otherwise: str) -> Column:
    """a full date as it is, a bare year as its first day, else ``otherwise``."""
    full = F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    year = F.regexp_extract(text, "^[ \t\n\r\f]*([0-9]{4})[ \t\n\r\f]*$", 1)
    return F.coalesce(F.nullif(full, F.lit("")), F.when(year != "", F.concat(year, F.lit("-01-01"))), F.lit(otherwise))


def camel(text: Column) -> Column:
    """kebab case to camel case."""
    return F.array_join(F.transform(F.split(text, "-"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000)))), "")


def width_percent(option: Column) -> Column:
    """a share of the text width as a percentage."""
    share = F.regexp_extract(option, r"([0-9]*\.?[0-9]+)\\(textwidth|linewidth|columnwidth)", 1)
    return F.when(share != "", F.concat(F.round(share.cast("double") * 100).cast("int").cast("string"), F.lit("%")))


def short_hash(text: Column, n: int = 8) -> Column:
    """F39."""
    return F.substring(F.md5(text), 1, n)
