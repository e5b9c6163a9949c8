"""Visually identical text with different characters (problem 2).

Text is brought to one form: compatibility normalisation composed, white space
mapped to the plain space, default-ignorable characters removed (but for the
zero-width non-joiner between two letters of the Persian script), look-alike
letters mapped to the script of their word, and full case folding for keys.
All work is done once per distinct value of a batch, and of a task for short ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZWNJ = "‌"
#: Default-ignorable characters other than the zero-width non-joiner.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​‍-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
#: Spaces other than the plain one. Line breaks are ordinary.
SPACES = "   -   　"
#: Blocks of width, ligature and positional forms, of small and capital Roman numbers, and of mathematical letters.
FORMS = "ĲĳĿŀŉſǄ-ǌǱ-ǳ\u212a\u212bⅠ-ⅿﬀ-ﬆﬓ-ﬗיִ-ﭏﭐ-﷿ﹰ-ﻼ！-ￜ\U0001d400-\U0001d7ff"
#: Letters of other scripts and the Latin ones they look like.
CYRILLIC = dict(zip("аеорсухіѕјԁһԛԝӏѵүАВЕКМНОРСТУХІЅЈԌԚԜӀҮ", "aeopcyxisjdhqwlvyABEKMHOPCTYXISJGQWIY", strict=True))
GREEK = dict(zip("οανιυρκϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "oaviupkcjABEZHIKMNOPTYXCJ", strict=True))
ARMENIAN = dict(zip("օսհոյցզաՕՍԼՏ", "ouhnjgqwOULS", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃᎥ", "ABCDEGHJKLMPRSTVWYZi", strict=True))
COPTIC = dict(zip("ⲟⲣⲥⲭⲕⲒⲎⲔⲘⲚⲞⲢⲤⲦⲬⲂⲨ", "opcxkIHKMNOPCTXBY", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
#: Latin letters that look like another Latin letter.
LATIN_TWINS = {"ɡ": "g", "ɑ": "a"}
#: The ranges of these scripts.
SCRIPTS = (("cyrillic", "Ѐ-ԯ", CYRILLIC), ("greek", "Ͱ-Ͽἀ-῿", GREEK), ("armenian", "԰-֏", ARMENIAN), ("cherokee", "Ꭰ-᏿", CHEROKEE), ("coptic", "Ⲁ-⳿", COPTIC), ("lisu", "ꓐ-꓿", LISU))
#: Arabic letters and digits that stand for Persian ones, and letters of other languages of that script.
PERSIAN_TWINS = dict(zip("كيى٠١٢٣٤٥٦٧٨٩", "کیی۰۱۲۳۴۵۶۷۸۹", strict=True))
HEH_TWINS = dict(zip("ہھە", "ههه", strict=True))
#: Common words that tell Persian from Arabic.
PERSIAN_WORDS = frozenset("در از که را با است این برای هر تا آن بر یک يک يك است بود شد می مي ها های چگونه درباره و کرد شود آمده بررسی بررسي رویکرد یادداشت".split())
ARABIC_WORDS = frozenset("في من على أن هذا هذه ذلك كل لكل إذا كان حتى التي الذي إلى عن مع بعد قبل كيف حول بين نحو دليل فإن".split())

_MARK = "̀-ͯٓ-ٕ"
_OTHER = "".join(r for _, r, _ in SCRIPTS)
_SUSPECT = re.compile(f"[{IGNORABLE}{SPACES}{FORMS}{_MARK}{_OTHER}\u2126\u212a\u212b{''.join(LATIN_TWINS)}{''.join(PERSIAN_TWINS)}{''.join(HEH_TWINS)}]|[0-9۰-۹]{ZWNJ}?[۰-۹0-9]|[A-Za-z][۰-۹]|[۰-۹][A-Za-z]|{ZWNJ}")
_HIDDEN = re.compile(f"[{IGNORABLE}{SPACES}]")
_FORM = re.compile(f"[{FORMS}]")
_ZWNJ = re.compile(f"(?<![ؠ-يٮ-ۓەۮۯۺ-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ]){ZWNJ}|{ZWNJ}(?![ؠ-يٮ-ۓەۮۯۺ-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ])")
_WORD = re.compile(r"[^\W_]+")
_LATIN = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
_TWIN = re.compile(f"[{_OTHER}]")
_LATIN_TWIN = re.compile(f"[{''.join(LATIN_TWINS)}]")
_NAMED = [(name, re.compile(f"[{r}]")) for name, r, _ in SCRIPTS] + [("latin", _LATIN)]
_TO_LATIN = {c: latin for _, _, table in SCRIPTS for c, latin in table.items()}
_FROM_LATIN = {name: {latin: c for c, latin in table.items()} for name, _, table in SCRIPTS}
_PERSIAN_TWIN = re.compile(f"[{''.join(PERSIAN_TWINS)}]")
_HEH_TWIN = re.compile(f"[{''.join(HEH_TWINS)}]")
_DIGITS = re.compile("[0-9٠-٩۰-۹]+")
_EASTERN = re.compile("[٠-٩۰-۹]")
_SEGMENT = re.compile("[^.!?؟؛\n]+")


def is_persian(segment: str) -> bool:
    """Whether text of the Arabic script is Persian rather than Arabic.

    Letters that only Persian has, half-spaces and common words are weighed
    against letters, articles and common words of Arabic.
    """
    persian = arabic = 0
    for word in _WORD.findall(segment.replace(ZWNJ, "ـ")):
        persian += 2 * (word in PERSIAN_WORDS) + any(c in "پچژگ" for c in word) + ("ـ" in word) + ("ک" in word or "ی" in word)
        arabic += 2 * (word in ARABIC_WORDS) + ("ة" in word) + (word.startswith("ال") and len(word) > 3) + any(c in "إأ" for c in word)
    return persian > arabic


def _mixed_digits(text: str) -> bool:
    for run in _DIGITS.findall(text):
        if len({(c <= "9") + 2 * ("٠" <= c <= "٩") for c in run}) > 1:
            return True
    return False


@lru_cache(1 << 12)
def _script(char: str) -> str | None:
    return next((name for name, letters in _NAMED if letters.match(char)), None)


@lru_cache(1 << 16)
def one_script(word: str) -> str:
    """``word`` with its letters in one script, Latin if possible; as it is if some letter has no twin in any of its scripts.

    Digits of the Arabic script beside Latin letters become plain ones.
    """
    scripts = [_script(c) for c in word]
    if "latin" in scripts and _EASTERN.search(word):
        word = _EASTERN.sub(lambda m: str(unicodedata.digit(m.group())), word)
    present = sorted({x for x in scripts if x}, key=lambda x: (x != "latin", -scripts.count(x), x))
    for base in present if len(present) > 1 else ():
        back = _FROM_LATIN.get(base)
        out = [c if x in (None, base) else _TO_LATIN.get(c) if base == "latin" else back.get(_TO_LATIN.get(c, c)) for c, x in zip(word, scripts, strict=True)]
        if None not in out:
            return "".join(out)
    return word


def _lone_letters(text: str) -> bool:
    """Whether words of one Cyrillic letter stand for Latin ones: among Latin words, without a whole word of that script."""
    words = _WORD.findall(text)
    alone = any(len(w) == 1 and w in CYRILLIC for w in words)
    return alone and bool(re.search("[A-Za-z]{2}", text)) and not any(len(w) > 1 and "Ѐ" <= w[0] <= "ԯ" and one_script(w) == w for w in words)


def _of_one_script(text: str) -> str:
    lone = _lone_letters(text)
    return _WORD.sub(lambda m: CYRILLIC.get(m.group(), m.group()) if lone and len(m.group()) == 1 else one_script(m.group()), text)


def is_variant(text: str | None, name: bool = False) -> bool:
    """Whether ``text`` has a character that looks like, or hides behind, an ordinary one.

    Null and empty texts have none. ``name`` says that the text is a person's
    name: one without any sign of Arabic is taken for Persian.
    """
    if not text or not _SUSPECT.search(text):
        return False
    if _HIDDEN.search(text) or _FORM.search(text) or _ZWNJ.search(text) or _HEH_TWIN.search(text):
        return True
    if unicodedata.normalize("NFC", text) != text or _mixed_digits(text) or _LATIN_TWIN.search(text):
        return True
    if (_TWIN.search(text) or _EASTERN.search(text)) and _of_one_script(text) != text:
        return True
    if _PERSIAN_TWIN.search(text):
        for segment in _SEGMENT.findall(text):
            if _PERSIAN_TWIN.search(segment) and (is_persian(segment) or (name and not re.search(r"\bال|[ةإأ]", segment))):
                return True
    return False


def one_form(text: str | None, name: bool = False) -> str | None:
    """``text`` in its one form. Null stays null. The result is a fixed point of this function."""
    while text and not (text.isascii() and not _SUSPECT.search(text)):
        out = _one_pass(text, name)
        if out == text:
            break
        text = out  # composing a mark can make a word of what was two
    return text


def _one_digits(m: re.Match) -> str:
    """A run of digits in the script of most of them; Persian on a tie."""
    kinds = [(c <= "9") + 2 * ("٠" <= c <= "٩") for c in m.group()]
    base = max((0, 2, 1), key=kinds.count)
    return "".join(chr({0: 0x6F0, 1: 0x30, 2: 0x660}[base] + unicodedata.digit(c)) for c in m.group())


def _one_pass(text: str, name: bool) -> str:
    out = unicodedata.normalize("NFC", text)
    out = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out)
    out = re.sub(f"[{SPACES}]", " ", re.sub(f"[{IGNORABLE}]", "", out))
    out = _ZWNJ.sub("", re.sub(f"{ZWNJ}+", ZWNJ, out))
    out = _LATIN_TWIN.sub(lambda m: LATIN_TWINS[m.group()], out)
    if _TWIN.search(out) or _EASTERN.search(out):
        out = _of_one_script(out)
    out = _DIGITS.sub(_one_digits, out)
    out = _HEH_TWIN.sub(lambda m: HEH_TWINS[m.group()], out)
    if _PERSIAN_TWIN.search(out):
        fixed = lambda m: "".join(PERSIAN_TWINS.get(c, c) for c in m.group()) if is_persian(m.group()) or (name and not re.search(r"\bال|[ةإأ]", m.group())) else m.group()
        out = _SEGMENT.sub(fixed, out)
    return unicodedata.normalize("NFC", out)


def comparison_key(text: str | None, name: bool = False) -> str | None:
    """The form by which texts are compared: one form, compatibility composed, case folded, spaces joined."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", one_form(text, name)).casefold()
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", folded)).strip()


#: Characters of values that are kept with their result from batch to batch, and how many of them.
SHORT = (256, 1 << 16)


def _per_distinct(batch: pa.RecordBatch, column: int):
    """(distinct values, index of each row's value) of one column."""
    coded = batch.column(column).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices


def _once(of: Callable) -> Callable:
    """``of`` one value, computed once a task for values that are short, as titles and names are: they repeat across batches."""
    kept = lru_cache(SHORT[1])(of)
    return lambda v: kept(v) if v is None or len(v) <= SHORT[0] else of(v)


def variants(df: DataFrame, key: str, column: str, field: str, name: bool = False, restorer=None) -> DataFrame:
    """(field, row_id) of the rows whose ``column`` is a variant.

    ``restorer`` is a broadcast pair model; a value that is garbled under it is
    left out. One narrow pass and a distinct on the rows found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkstream.llm.garbling import Restorer

        fixer = Restorer(restorer.value) if restorer is not None else None
        test = _once(lambda v: is_variant(v, name))
        for batch in batches:
            values, index = _per_distinct(batch, 1)
            hit = [test(v) for v in values]
            if fixer:
                hit = [h and not (fixer.suspects([v])[0] and fixer.restore(v)[0]) for h, v in zip(hit, values, strict=True)]
            mask = pa.array(hit, pa.bool_()).take(index).fill_null(False) if values else pa.array([False] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask)], names=["row_id"])

    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(column).cast("string").alias("__text"))
    return rows.mapInArrow(run, "row_id bigint").distinct().select(F.lit(field).alias("field"), "row_id")


def normalised(df: DataFrame, key: str, column: str, field: str, name: bool = False) -> DataFrame:
    """(field, row_id, text, key): every row's value in one form and its comparison key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _once(lambda v: (one_form(v, name), comparison_key(v, name)))
        for batch in batches:
            values, index = _per_distinct(batch, 1)
            forms, keys = (pa.array(c, pa.string()).take(index) for c in (zip(*map(both, values), strict=True) if values else ([], [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), forms, keys], names=["row_id", "text", "key"])

    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(column).cast("string").alias("__text"))
    return rows.mapInArrow(run, "row_id bigint, text string, key string").select(F.lit(field).alias("field"), "row_id", "text", "key")
