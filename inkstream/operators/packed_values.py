"""Several values packed in one field (problem 4).

A quote-aware finite-state tokenizer walks a value once. Its state is the open
quotation mark, the nesting depth of braces, brackets and parentheses, and an
escape flag; what is enclosed is never split. Every delimiter seen in the
ground state becomes a cut candidate of one *kind* (semicolon, comma, word
...). Which kinds do separate is decided per value and field: see
:func:`split_authors` and :func:`split_pages`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that open an enclosure and the mark that closes it.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
NESTING = {"{": "}", "(": ")", "[": "]"}
#: Delimiter characters by kind, and delimiter words.
MARKS = {";": "semi", "؛": "semi", "|": "bar", "/": "bar", "\n": "bar", "\r": "bar", "\t": "bar", "&": "and", "+": "and", ",": "comma", "،": "comma"}
WORDS = {"and": "and", "AND": "and", "And": "and", "و": "and", "und": "and", "et": "and"}
#: Parts that stand between commas inside one name.
NAME_SUFFIXES = frozenset({"jr", "jr.", "sr", "sr.", "ii", "iii", "iv"})

Cut = tuple[int, int, str]


def cuts(value: str) -> list[Cut]:
    """The delimiters outside every enclosure, as (start, end, kind).

    A quotation mark opens an enclosure only at the start of an item, so an
    apostrophe or inch mark inside a word changes nothing. An enclosure that is
    never closed doesn't enclose: the scan goes on behind its opening mark.
    A backslash makes the next character ordinary.
    """
    out: list[Cut] = []
    i, n, fresh = 0, len(value), True
    while i < n:
        ch = value[i]
        if ch == "\\" and i + 1 < n:
            i += 2
            fresh = False
            continue
        if (ch in QUOTES and fresh) or ch in NESTING:
            end = _close(value, i)
            if end > 0:
                i = end
                fresh = False
                continue
        kind = MARKS.get(ch)
        if kind is not None:
            out.append((i, i + 1, kind))
            i += 1
            fresh = True
            continue
        if ch.isspace():
            i += 1
            continue
        if fresh or value[i - 1].isspace():
            j = i
            while j < n and value[j].isalpha():
                j += 1
            if j > i and i > 0 and value[i - 1].isspace() and (j < n and value[j].isspace()) and value[i:j] in WORDS:
                out.append((i, j, WORDS[value[i:j]]))
                i = j
                fresh = True
                continue
        fresh = False
        i += 1
    return out


def _close(value: str, start: int) -> int:
    """The position behind the mark that closes the enclosure opened at ``start``; 0 if there is none."""
    opening = value[start]
    i, n = start + 1, len(value)
    if opening in QUOTES:
        closing = QUOTES[opening]
        while i < n:
            if value[i] == "\\":
                i += 2
            elif value[i] == closing:
                if closing == opening and i + 1 < n and value[i + 1] == closing:
                    i += 2  # a doubled mark is an escaped one
                else:
                    return i + 1
            else:
                i += 1
        return 0
    stack = [NESTING[opening]]
    while i < n:
        ch = value[i]
        if ch == "\\":
            i += 2
            continue
        if ch in NESTING:
            stack.append(NESTING[ch])
        elif ch == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return 0


def bare(item: str) -> str:
    """``item`` trimmed, without the braces or quotation marks that enclose all of it."""
    item = item.strip()
    while len(item) > 1 and (item[0] in QUOTES or item[0] == "{") and _close(item, 0) == len(item):
        inner = item[1:-1].strip()
        if not inner:
            break
        item = inner
    return item


def _pieces(value: str, at: list[Cut]) -> list[str]:
    out, last = [], 0
    for start, end, _ in [*at, (len(value), len(value), "")]:
        piece = value[last:start].strip()
        if piece:
            out.append(piece)
        last = end
    return out


def _enclosed(piece: str) -> bool:
    return len(piece) > 1 and (piece[0] in QUOTES or piece[0] == "{") and _close(piece, 0) == len(piece)


def _comma_names(piece: str) -> list[str]:
    """Splits a piece without stronger delimiters at its commas.

    Commas separate names only if every part is a name by itself: at least two
    words, or enclosed. Otherwise the piece is one name "family, given".
    """
    at = [c for c in cuts(piece) if c[2] == "comma"]
    if not at:
        return [piece]
    parts = _pieces(piece, at)
    if len(parts) < 2:
        return parts
    if all(_enclosed(p) or len(p.split()) > 1 for p in parts):
        return parts
    return [piece]


def split_authors(value: str | None) -> list[str]:
    """The names in ``value`` in written order, as written, without enclosing marks.

    Semicolons, bars, slashes, line breaks, ampersands and the words "and" and
    "و" always separate. Commas do if each name between them has two words or
    more. Null, empty and blank values have no names.
    """
    if value is None or not value.strip():
        return []
    out: list[str] = []
    whole = bare(value)
    if _enclosed(value.strip()) and whole != value.strip():
        return [whole]
    for piece in _pieces(value, [c for c in cuts(value) if c[2] != "comma"]):
        out += _comma_names(piece)
    return [x for x in map(bare, out) if x]


def split_pages(value: str | None) -> list[str]:
    """The pages and page ranges in ``value``; every delimiter outside enclosures separates."""
    if value is None or not value.strip():
        return []
    return [x for x in map(bare, _pieces(value, cuts(value))) if x]


SPLITTERS = {"author": split_authors, "pages": split_pages}


def unpack_values(df: DataFrame, key: str, fields: tuple[str, ...] = ("author", "pages"), least: int = 2) -> DataFrame:
    """One row (key, field, pos, item) for each value packed in ``fields`` of ``df``.

    Only values with at least ``least`` items give rows. A null key keeps its
    rows under a null key; rows repeated in ``df`` give the same items once.
    Other columns of ``df``, whatever their names, are not read. The work is
    one narrow pass: no shuffle before the final distinct on repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [])
            for at, field in enumerate(fields, 1):
                seen: dict[str | None, list[str]] = {}
                for row, value in enumerate(batch.column(at).to_pylist()):
                    items = seen.get(value)
                    if items is None:
                        items = seen[value] = SPLITTERS[field](value)
                    if len(items) >= least:
                        out[0].extend([row] * len(items))
                        out[1].extend([field] * len(items))
                        out[2].extend(range(1, len(items) + 1))
                        out[3].extend(items)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())],
                names=["__key", "field", "pos", "item"],
            )

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), *(F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)))
    rows = rows.mapInArrow(run, f"__key {key_type}, field string, pos int, item string")
    return rows.withColumnRenamed("__key", key).distinct()
