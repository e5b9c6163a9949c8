"""Garbled text from wrong character encoding (problem 3).

Adjacent character pairs are scored by their mutual information in a corpus.
In a text, maximum-scoring segments of improbable pairs are isolated, and
inverse mappings are tried only inside them. A mapping counts if it makes the
segment clearly more probable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.textchunks import chunks, points

#: Character classes: the pair table has at most CLASSES squared entries, whatever the corpus.
CLASSES = 1024
#: Improbability of a pair that the corpus lacks is -log(UNSEEN / (1 + UNSEEN)).
UNSEEN = 0.01
#: A mapping must lower the improbability of a segment by this much; by more if the segment has Arabic letters, of which some pairs are rare.
LEAST_GAIN = 4.0
LEAST_GAIN_ARABIC = 5.0
#: A pair of this improbability makes a text worth a closer look.
SUSPECT = 2.0
#: Ranges of code points with a class each; the rest share classes by block.
RANGES = ((0x0000, 0x0180), (0x0370, 0x0400), (0x0400, 0x0460), (0x0600, 0x0700), (0x2000, 0x2070))


def _class_table() -> np.ndarray:
    table = np.empty(0x110000, np.uint16)
    table[:] = 992 + (np.arange(0x110000) >> 7) % 32
    at = 0
    for lo, hi in RANGES:
        table[lo:hi] = np.arange(at, at + hi - lo)
        at += hi - lo
    return table


@lru_cache(1)
def class_table() -> np.ndarray:
    return _class_table()


def pair_counts(df: DataFrame, column: str) -> DataFrame:
    """(pair INT, n BIGINT): adjacent character-class pairs of all texts in ``column``.

    Counted per partition in a table of fixed size, then summed: the shuffle is
    bounded by the number of pairs, not by the text. Null and empty texts have
    no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        table = class_table()
        for batch in batches:
            for _, texts in chunks(batch, 0):
                joined = "\n".join(t for t in texts if t)
                if len(joined) > 1:
                    c = table[points(joined)].astype(np.int32)
                    counts += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["pair", "n"])

    return df.select(F.col(column).cast("string")).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class PairModel:
    """Mutual information of pairs; small enough to be sent to every task."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        self._cost: np.ndarray | None = None

    def __getstate__(self):
        return {"pairs": self.pairs, "counts": self.counts, "_cost": None}

    @staticmethod
    def fit(df: DataFrame, column: str) -> PairModel:
        """The model of all texts of ``df``. What reaches the driver is bounded by CLASSES squared pairs."""
        rows = pair_counts(df, column).toPandas()
        return PairModel(rows["pair"].to_numpy(np.int32), rows["n"].to_numpy(np.int64))

    @property
    def cost(self) -> np.ndarray:
        """Improbability (minus the smoothed mutual information) by pair."""
        if self._cost is None:
            n = np.zeros((CLASSES, CLASSES))
            n.ravel()[self.pairs] = self.counts
            total = max(n.sum(), 1.0)
            expected = np.outer(np.maximum(n.sum(1), 0.5), np.maximum(n.sum(0), 0.5)) / total
            self._cost = (-np.log((n + UNSEEN * expected) / ((1 + UNSEEN) * expected))).astype(np.float32).ravel()
        return self._cost

    def pair_costs(self, text: str) -> np.ndarray:
        c = class_table()[points(text)].astype(np.int32)
        cost = self.cost[c[:-1] * CLASSES + c[1:]]
        # pairs of two plain characters carry no sign of a wrong encoding
        return np.where((c[:-1] < 128) & (c[1:] < 128), -0.5, cost)

    def improbability(self, text: str) -> float:
        return float(np.maximum(self.pair_costs(f" {text} "), 0).sum())


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments of ``scores`` as [start, end), by the linear-time stack method.

    Fixed result: the segments are disjoint, each has a positive sum, and no
    prefix or suffix of a segment has a sum of zero or less.
    """
    stack: list[list[float]] = []  # start, end, sum before, sum up to
    total = 0.0
    for i, x in enumerate(scores.tolist()):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append([start, i + 1, left, total])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(a), int(b)) for a, b, *_ in stack]


@lru_cache(1)
def _codecs() -> dict[str, tuple[dict[str, int], list[str]]]:
    """By codec: character to byte, and byte to character. Bytes without a character stand for themselves."""
    out = {}
    for name in ("cp1252", "latin-1", "cp1256", "mac_roman", "cp437", "cp1251", "cp850", "cp1250"):
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        back = {c: b for b, c in enumerate(chars)}
        if name == "cp1252":
            back |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in back}
        out[name] = (back, chars)
    return out


#: Codecs in which UTF-8 bytes are read by mistake, and (read as, written in) of single-byte texts.
READ_UTF8_AS = ("cp1252", "latin-1", "cp1256", "mac_roman", "cp437", "cp1251", "cp850", "cp1250")
READ_BYTES_AS = (("cp1252", "cp1256"), ("latin-1", "cp1256"), ("mac_roman", "cp1256"), ("cp437", "cp1256"), ("cp1251", "cp1256"), ("cp1256", "cp1252"), ("mac_roman", "cp1252"))
#: A single-byte mapping needs so many mapped letters that a foreign symbol or a look-alike letter isn't taken for one.
LEAST_MAPPED = {"cp1256": 4, "cp1252": 1}
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")


def utf8_read_as(text: str, codec: str) -> str:
    """``text`` with every run that is UTF-8 under ``codec`` decoded; the rest as it is."""
    back, _ = _codecs()[codec]
    plain = "".join(chr(back[c]) if c in back else "￿" for c in text)
    out, last = [], 0
    for m in _SEQUENCE.finditer(plain):
        try:
            char = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if char < "\xa0":  # a control character is no text
            continue
        out += [text[last : m.start()], char]
        last = m.end()
    return "".join(out) + text[last:] if out else text


def bytes_read_as(text: str, read: str, written: str) -> str:
    """``text`` whose bytes were read as ``read``, decoded as ``written``.

    A character without a byte stays. Unchanged if too few letters are mapped,
    or if one becomes anything but a letter.
    """
    back, chars = _codecs()[read][0], _codecs()[written][1]
    mapped = [c for c in text if c > "\x7f" and c != "\u200c" and c in back]
    letters = [c for c in mapped if chars[back[c]].isalpha()]
    if len(letters) < LEAST_MAPPED[written] or any(c.isalpha() and not chars[back[c]].isalpha() for c in mapped if chars[back[c]] not in "،؛؟\u200c\u064b"):
        return text
    if written == "cp1252" and not all(_in_word(text, c) for c in letters):
        return text
    return "".join(chars[back[c]] if c in back and c > "\x7f" else c for c in text)


_ARABIC = re.compile("[\u0620-\u06ff]")


def _in_word(text: str, char: str) -> bool:
    """Whether every ``char`` in ``text`` stands beside a plain letter."""
    return all("a" <= text[max(i - 1, 0)].lower() <= "z" or "a" <= text[min(i + 1, len(text) - 1)].lower() <= "z" for i, c in enumerate(text) if c == char)


class Restorer:
    """Finds and restores garbled runs of single texts."""

    def __init__(self, model: PairModel):
        self.model = model

    def _windows(self, text: str, costs: np.ndarray) -> list[tuple[int, int]]:
        """Improbable segments, widened to white space and joined where they touch."""
        out: list[tuple[int, int]] = []
        for a, b in segments(costs):
            lo, hi = a, b + 1
            while lo > 0 and not text[lo - 1].isspace():
                lo -= 1
            while hi < len(text) and not text[hi].isspace():
                hi += 1
            if out and lo <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def window(self, part: str) -> str | None:
        """The best restoration of one window, or None.

        Every mapping is tried and the most probable result wins; this is
        repeated for text that was garbled more than once, as long as a mapping
        makes it clearly more probable.
        """
        best = None
        while True:
            now = part if best is None else best
            tried = {utf8_read_as(now, c) for c in READ_UTF8_AS} | {bytes_read_as(now, *c) for c in READ_BYTES_AS}
            tried.discard(now)
            if not tried:
                break
            cost, new = min((self.model.improbability(t), t) for t in tried)
            if cost > self.model.improbability(now) - (LEAST_GAIN_ARABIC if _ARABIC.search(now) else LEAST_GAIN):
                break
            best = new
        return best

    def restore(self, text: str) -> tuple[bool, str]:
        """(garbled, restored text). A text with replacement or C1 control characters is garbled even if nothing can be restored."""
        costs = self.model.pair_costs(text)
        out, last, found = [], 0, False
        for lo, hi in self._windows(text, costs):
            part = text[lo:hi]
            if not any(c > "\x7f" for c in part):
                continue
            new = self.window(part)
            if new is not None:
                found = True
                out += [text[last:lo], new]
                last = hi
        restored = "".join(out) + text[last:]
        lost = any(c == "�" or "\x80" <= c <= "\x9f" for c in text)
        return found or lost, restored

    def suspects(self, texts: list[str | None]) -> np.ndarray:
        """Which texts have an improbable pair with a character outside ASCII, or a replacement or C1 control character."""
        lengths = np.array([len(t or "") + 1 for t in texts])
        joined = "\n".join(t or "" for t in texts) + "\n"
        if len(joined) < 2:
            return np.zeros(len(texts), bool)
        p = points(joined)
        c = class_table()[p].astype(np.int32)
        hit = (self.model.cost[c[:-1] * CLASSES + c[1:]] > SUSPECT) & ((c[:-1] >= 128) | (c[1:] >= 128))
        hit |= (p[:-1] == 0xFFFD) | ((p[:-1] >= 0x80) & (p[:-1] < 0xA0))
        ends = np.cumsum(lengths)
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[np.minimum(ends, len(hit))] > total[ends - lengths]


def garbled(df: DataFrame, key: str, column: str, model: PairModel) -> DataFrame:
    """(key, original, restored, complete) for each row whose text is garbled.

    One narrow pass; the model travels as a broadcast variable of bounded size.
    complete is false if the restored text still has replacement or control
    characters. Null and empty texts are never garbled. Repeated rows give
    repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        done: dict[str, tuple[bool, str]] = {}
        for batch in batches:
            rows, originals, texts = [], [], []
            for start, part in chunks(batch, 1):
                for i in np.flatnonzero(restorer.suspects(part)).tolist():
                    text = part[i]
                    if text not in done:
                        if len(done) > 10_000:
                            done.clear()
                        done[text] = restorer.restore(text)
                    bad, restored = done[text]
                    if bad:
                        rows.append(start + i)
                        originals.append(text)
                        texts.append(restored)
            complete = [not any(c == "�" or "\x80" <= c <= "\x9f" for c in t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(originals, pa.string()), pa.array(texts, pa.string()), pa.array(complete, pa.bool_())],
                names=["__key", "original", "restored", "complete"],
            )

    rows = df.select(F.col(key).alias("__key"), F.col(column).cast("string").alias("__text"))
    out = rows.mapInArrow(run, f"__key {key_type}, original string, restored string, complete boolean")
    return out.withColumnRenamed("__key", key)
