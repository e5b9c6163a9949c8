"""Missing or wrong language labels (problem 7).

A nearest-centroid classifier: character n-grams of a segment, hashed, weighted
by TF-IDF and normalised, are compared by cosine with several clustered
centroids of each language; a segment far from all of them has no language. A
document's language is the one with most letters among its segments.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.textchunks import chunks, points

#: Hashed n-gram features, centroids per language, and rows of labelled text that are read for fitting at most.
FEATURES = 1 << 15
CENTROIDS = 3
FIT_ROWS = 20_000
#: A segment is rejected below this share of the weakest cosine that a labelled sentence has with its language: titles are shorter and less like the centroids than sentences.
REJECT = 0.3
#: A whole sentence has at least so many words and letters.
SENTENCE = (4, 15)
#: Segments classified at once; with FEATURES their keys fit 31 bits.
SEGMENTS = 1 << 14

#: Labels of the corpus' languages in every notation; the part before a region is looked up.
LABELS = {
    "fa": ("fa", "fas", "per", "pes", "prs", "farsi", "persian", "persisch", "persan", "فارسی"),
    "en": ("en", "eng", "english", "englisch", "anglais", "انگلیسی"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "آلمانی"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "فرانسوی"),
    "ar": ("ar", "ara", "arb", "arabic", "arabisch", "arabe", "عربی", "عربي", "العربية"),
}
#: Labels that name no language.
UNKNOWN = ("", "unknown", "und", "undetermined", "mis", "mul", "zxx", "none", "null", "n/a", "na", "?", "-", "unk", "xx", "nan")

_SPLIT = re.compile(r"(?<=[.!?؟۔…])[\"”»')\]*_]*\s+|\s*\n\s*")
_WHOLE = re.compile(r"[.!?؟۔…][\"”»')\]*_]*\s*$")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_MARKUP = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]{0,80}\])?|\$[^$\n]{0,300}\$|<[^<>\n]{1,300}>|https?://\S+|`[^`\n]{0,200}`|&#?\w{1,10};|\{\{[^{}\n]{0,200}\}\}")


def label(value: Column) -> Column:
    """The language that a label names: one of LABELS, null for a missing one, or the label itself for another language."""
    code = F.regexp_replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), r"[-_].*$", "")
    pairs = [F.lit(x) for lang, names in LABELS.items() for name in names for x in (name, lang)]
    return F.when(code.isin(*UNKNOWN), F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(F.create_map(*pairs), code), code))


def _has_markup(text: str) -> bool:
    return "\\" in text or "$" in text or "<" in text or "`" in text or "http" in text or "&" in text or "{{" in text


def sentences(text: str | None) -> list[str]:
    """The segments of ``text``: sentences and lines, without markup. Null and blank texts have none."""
    if not text:
        return []
    if _has_markup(text):
        text = _MARKUP.sub(" ", text)
    return [s for s in _SPLIT.split(text) if s and not s.isspace()]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each of its :func:`sentences`."""
    if not text:
        return []
    # where the text without markup stands in the text: (position without, position with markup)
    at, back, bare = [0], [0], text
    if _has_markup(text):
        parts, size, last = [], 0, 0
        for m in _MARKUP.finditer(text):
            parts += [text[last : m.start()], " "]
            size += m.start() - last + 1
            last = m.end()
            at += [size - 1, size]
            back += [m.start(), last]
        bare = "".join([*parts, text[last:]])
    original = lambda i: back[k := bisect_right(at, i) - 1] + i - at[k]
    ends = [(m.start(), m.end()) for m in _SPLIT.finditer(bare)]
    spans = zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(bare)], strict=True)
    return [(original(a), original(b)) for a, b in spans if bare[a:b] and not bare[a:b].isspace()]


def vectors(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, feature, count, letters by segment) of the hashed bigrams and trigrams of letters."""
    joined = "\n".join(f" {s} " for s in segments).lower() + "\n"
    c = points(joined)
    letter = _letters()[c]
    ends = c == 10
    seg = np.cumsum(ends) - ends
    # anything but a letter is a space, so digits and punctuation are no evidence
    code = np.where(letter, c, np.uint32(32)).astype(np.uint32)
    code[ends] = 10
    letters = np.bincount(seg, weights=letter, minlength=len(segments)).astype(np.int64)[: len(segments)]
    keys = []
    for n in (2, 3):
        h = code[: len(code) - n + 1].copy()
        ok = letter[: len(code) - n + 1] | letter[1 : len(code) - n + 2]
        for i in range(1, n):
            h = h * np.uint32(0x01000193) ^ code[i : len(code) - n + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) % np.uint32(FEATURES)
        inside = seg[: len(h)] == seg[n - 1 :]
        keys.append((seg[: len(h)][ok & inside] * FEATURES + h[ok & inside]).astype(np.int32))
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return key // FEATURES, key % FEATURES, count, letters


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[:0x3000] = [chr(i).isalpha() or i == 0x200C for i in range(0x3000)]
        table[0x3000:0xD800] = True
        _LETTERS.append(table)
    return _LETTERS[0]


class Classifier:
    """Centroids, feature weights and the rejection bound; its size is fixed."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: float):
        self.langs, self.idf, self.centroids, self.owner, self.least = langs, idf, centroids, owner, least

    @staticmethod
    def fit(texts: list[str], langs: list[str], seed: int = 7) -> Classifier:
        """Fits on labelled texts; each sentence is a training case. Memory grows with the texts, not with FEATURES for each sentence."""
        cases = [(s, lang) for text, lang in zip(texts, langs, strict=True) for s in sentences(text)]
        names = sorted({lang for _, lang in cases})
        parts = [vectors([s for s, _ in cases[at : at + SEGMENTS]]) for at in range(0, len(cases), SEGMENTS)]
        seg = np.concatenate([p[0].astype(np.int64) + i * SEGMENTS for i, p in enumerate(parts)])
        feature, count = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        n = len(cases)
        idf = np.log((1 + n) / (1 + np.bincount(feature, minlength=FEATURES))).astype(np.float32) + 1
        value = ((1 + np.log(count)) * idf[feature]).astype(np.float32)
        value /= np.maximum(np.sqrt(np.bincount(seg, value.astype(np.float64) ** 2, n)), 1e-9)[seg]
        rng = np.random.default_rng(seed)
        centroids, owner, own = [], [], []
        label_of = np.array([names.index(lang) for _, lang in cases])
        for i in range(len(names)):
            members = np.flatnonzero(label_of == i)
            at = np.flatnonzero(label_of[seg] == i)
            row, f, v = np.searchsorted(members, seg[at]), feature[at], value[at]
            k = min(CENTROIDS, len(members))

            def mean(chosen: np.ndarray, row: np.ndarray = row, f: np.ndarray = f, v: np.ndarray = v) -> np.ndarray:
                inside = chosen[row]
                return np.bincount(f[inside], v[inside], FEATURES) / max(chosen.sum(), 1)

            def cosines(centre: np.ndarray, row: np.ndarray = row, f: np.ndarray = f, v: np.ndarray = v, m: int = len(members)) -> np.ndarray:
                return np.stack([np.bincount(row, c[f] * v, m) for c in centre], axis=1)

            centre = np.stack([mean(np.arange(len(members)) == j) for j in rng.choice(len(members), k, replace=False)])
            for _ in range(15):
                near = cosines(centre).argmax(1)
                centre = np.stack([mean(near == j) if (near == j).any() else centre[j] for j in range(k)])
                centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
            centroids.append(centre.astype(np.float32))
            owner += [i] * k
            own.append(cosines(centre).max(1))
        return Classifier(names, idf, np.ascontiguousarray(np.concatenate(centroids).T), np.array(owner), float(REJECT * np.concatenate(own).min()))

    def classify(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, confidence, letters) of each segment. Confidence is the cosine's share over the best of each language."""
        lang, confidence, letters = [], [], []
        for at in range(0, len(segments), SEGMENTS):
            part = segments[at : at + SEGMENTS]
            a, b, n = self._classify(part)
            lang.append(a)
            confidence.append(b)
            letters.append(n)
        if not lang:
            return np.empty(0, int), np.empty(0), np.empty(0, int)
        return np.concatenate(lang), np.concatenate(confidence), np.concatenate(letters)

    def _classify(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seg, feature, count, letters = vectors(segments)
        weight = (1 + np.log(count)).astype(np.float32) * self.idf[feature]
        scores = np.zeros((len(segments), self.centroids.shape[1]), np.float32)
        norm = np.zeros(len(segments), np.float32)
        if len(seg):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            scores[seg[starts]] = np.add.reduceat(self.centroids[feature] * weight[:, None], starts, axis=0)
            norm[seg[starts]] = np.sqrt(np.add.reduceat(weight * weight, starts))
        scores /= np.maximum(norm, 1e-9)[:, None]
        best = np.stack([scores[:, self.owner == i].max(1) for i in range(len(self.langs))], axis=1)
        top = best.argmax(1)
        confidence = best.max(1) / np.maximum(best.sum(1), 1e-9)
        return np.where(best.max(1) >= self.least, top, -1), confidence, letters


def fit_on(samples: DataFrame, text: str = "text", lang: str = "lang") -> Classifier:
    """A classifier fitted on at most FIT_ROWS labelled rows: those with the smallest hashes, so the same ones every time."""
    rows = samples.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.orderBy(F.xxhash64(text), text, lang).limit(FIT_ROWS).collect()
    return Classifier.fit([r[0] for r in rows], [r[1] for r in rows])


def _segmented(model: Classifier, texts: list[str | None]):
    """(row of each segment, segments, language, confidence, letters) of many texts."""
    rows, segments = [], []
    for row, text in enumerate(texts):
        own = sentences(text)
        rows += [row] * len(own)
        segments += own
    return np.array(rows, int), segments, *model.classify(segments)


def document_languages(df: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """(key, lang, confidence): the language of most of each text's letters and its share.

    A text without a segment that has a language gives (key, null, 0). Null
    texts do too. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out_lang, out_share = [], []
            for _, texts in chunks(batch, 1):
                row, _, lang, _, letters = _segmented(m, texts)
                tally = np.zeros((len(texts), len(m.langs)))
                ok = lang >= 0
                np.add.at(tally, (row[ok], lang[ok]), letters[ok])
                total = tally.sum(1)
                best = tally.argmax(1)
                out_lang += [m.langs[b] if t > 0 else None for b, t in zip(best, total, strict=True)]
                out_share += (tally.max(1) / np.maximum(total, 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_lang, pa.string()), pa.array(out_share, pa.float64())], names=["__key", "detected", "confidence"])

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, detected string, confidence double").withColumnRenamed("__key", key)


def short_text_languages(df: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """(key, lang, confidence) of texts that are one segment, such as titles."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [(t or "").replace("\n", " ") for t in batch.column(1).to_pylist()]
            lang, confidence, letters = m.classify(texts)
            names = [m.langs[i] if i >= 0 and n else None for i, n in zip(lang, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(confidence, pa.float64())], names=["__key", "detected", "confidence"])

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, detected string, confidence double").withColumnRenamed("__key", key)


def mixed_segments(df: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """(key, lang, confidence, n_sentences): the languages of the whole sentences of each text, if there are two or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for start, texts in chunks(batch, 1):
                row, segments, lang, confidence, letters = _segmented(m, texts)
                found: dict[int, dict[int, list[float]]] = {}
                for r, s, i, c, n in zip(row.tolist(), segments, lang.tolist(), confidence.tolist(), letters.tolist(), strict=True):
                    if i >= 0 and n >= SENTENCE[1] and _WHOLE.search(s) and len(_WORDS.findall(s)) >= SENTENCE[0]:
                        found.setdefault(r, {}).setdefault(i, []).append(c)
                for r, langs in found.items():
                    if len(langs) > 1:
                        for i, c in langs.items():
                            for column, v in zip(out, (start + r, m.langs[i], sum(c) / len(c), len(c)), strict=True):
                                column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())],
                names=["__key", "lang", "confidence", "n_sentences"],
            )

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, lang string, confidence double, n_sentences bigint").withColumnRenamed("__key", key)


def segment_languages(df: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """(key, position, start, end, lang, confidence): every segment of each text, numbered from 0, with its place in the text.

    A segment that has no language gives null and 0. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, texts in chunks(batch, 1):
                row, _, lang, confidence, letters = _segmented(m, texts)
                spans = [(n, a, b) for t in texts for n, (a, b) in enumerate(sentence_spans(t))]
                known = (lang >= 0) & (letters > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + first, pa.int64())),
                        *(pa.array([x[i] for x in spans], pa.int64()) for i in range(3)),
                        pa.array([m.langs[i] if k else None for i, k in zip(lang, known, strict=True)], pa.string()),
                        pa.array(np.where(known, confidence, 0.0), pa.float64()),
                    ],
                    names=["__key", "position", "start", "end", "lang", "confidence"],
                )

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, position bigint, start bigint, end bigint, lang string, confidence double").withColumnRenamed("__key", key)
