"""Long exact spans shared between records (problem 10).

Documents are factored against reference blocks. A block is ``BLOCK``
characters at a content-defined place: of any ``SPAN - BLOCK + 1`` adjacent
places, the one whose block has the smallest hash, so every string of ``SPAN``
characters holds a whole block, and holds the same one wherever it occurs.
Blocks that occur in two documents are the index. At each occurrence the factor
is extended to both sides, and is a shared span if at least ``SPAN`` characters
agree exactly: hashes only propose, texts decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.llm.components import components
from inkstream.llm.staging import written
from inkstream.llm.textchunks import points

SPAN = 200
BLOCK = 64
#: Places of which one is kept.
PLACES = SPAN - BLOCK + 1
#: Characters beside a block that decide whether SPAN characters agree.
SIDE = SPAN - BLOCK
#: Characters handled at once; longer texts are cut into pieces that overlap by SPAN - 1.
PIECE = 1 << 17
#: Occurrences of one block that one task compares; a block with more is compared by the distributed way.
MOST_IN_TASK = 2048
#: Bits of the filter that tells the second pass which blocks are shared: 64 or more for each shared block, between these bounds (at most 32 MB). More shared blocks than fit are told by a join.
FILTER_BITS = (1 << 20, 1 << 28)
#: Bits of the filter that one task builds.
CHUNK_BITS = 1 << 16
_BASE = 0x9E3779B1


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(PIECE + SPAN, _BASE, np.uint32)
    down = np.full(PIECE + SPAN, pow(_BASE, -1, 1 << 32), np.uint32)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint32), np.cumprod(down, dtype=np.uint32)


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every ``width`` adjacent elements, in time that doesn't depend on ``width``."""
    rows = np.concatenate([x, np.full(-len(x) % width, fill, x.dtype)]).reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def places(c: np.ndarray) -> np.ndarray:
    """Starts of the blocks of a text of code points, ascending. A text below SPAN characters has none."""
    out = []
    for at in range(0, max(len(c) - SPAN + 1, 0), PIECE):
        piece = c[at : at + PIECE + SPAN - 1]
        up, down = _powers()
        sums = np.zeros(len(piece) + 1, np.uint32)
        np.cumsum(piece * up[: len(piece)], dtype=np.uint32, out=sums[1:])
        h = (sums[BLOCK:] - sums[:-BLOCK]) * down[: len(piece) - BLOCK + 1]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        least = _sliding(h, PLACES, np.minimum, 0xFFFFFFFF)
        edge = np.zeros(PLACES - 1, np.uint32)
        most = _sliding(np.concatenate([edge, least, edge]), PLACES, np.maximum, 0)
        out.append(np.flatnonzero(most == h) + at)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def _blocks(text: str) -> list[tuple[int, int]]:
    """(block hash, start) of every block of ``text``."""
    if len(text) < SPAN:
        return []
    digest = xxhash.xxh3_64_intdigest
    return [(digest(text[p : p + BLOCK].encode("utf-8", "surrogatepass")) - (1 << 63), p) for p in places(points(text)).tolist()]


def block_index(docs: DataFrame) -> DataFrame:
    """(block, n): blocks that occur in more than one of ``docs`` (doc_id, text), and how often they occur in all, repeats in one document included.

    Aggregated before the shuffle, so a block that most documents share is one
    row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter(h for h, _ in _blocks(text.as_py() or "")) if doc is not None else {}
                out[0].extend(own)
                out[1].extend([doc] * len(own))
                out[2].extend(own.values())
                if len(out[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["block", "doc_id", "n"])
                    out = ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["block", "doc_id", "n"])

    found = docs.mapInArrow(run, "block bigint, doc_id bigint, n bigint")
    found = found.groupBy("block").agg(F.min("doc_id").alias("__lo"), F.max("doc_id").alias("__hi"), F.sum("n").alias("n"))
    return found.where("__lo < __hi").select("block", "n")


def block_filter(index: DataFrame, n: int) -> np.ndarray:
    """A bit field of bounded size with the bit of each of the ``n`` indexed blocks set, built in chunks on the executors."""
    bits = min(max(1 << (64 * max(n, 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    bit = F.pmod("block", F.lit(bits))

    def chunk(group: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros(CHUNK_BITS, np.uint8)
        field[group["bit"].to_numpy() % CHUNK_BITS] = 1
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "field": [np.packbits(field, bitorder="little").tobytes()]})

    chunks = index.select(bit.alias("bit"), F.floor(bit / CHUNK_BITS).alias("chunk")).groupBy("chunk").applyInPandas(chunk, "chunk bigint, field binary")
    field = np.zeros(bits // 64, np.uint64)
    for at, part in chunks.collect():
        words = CHUNK_BITS // 64
        field[at * words : (at + 1) * words] = np.frombuffer(part, np.uint64)
    return field


def marked(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``docs`` with the starts of their indexed blocks, by a join: for more blocks than a filter holds.

    Only hashes and places are joined with the index. Texts are shuffled once,
    to meet the places of their own document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _blocks(text.as_py() or "") if doc is not None else []
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in own], pa.int64()), pa.array([doc] * len(own), pa.int64()), pa.array([p for _, p in own], pa.int64())], names=["block", "doc_id", "start"])

    found = docs.mapInArrow(run, "block bigint, doc_id bigint, start bigint").join(index.select("block"), "block", "left_semi")
    # as many as the document's own length allows
    return docs.join(found.groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "doc_id")


def occurrences(docs: DataFrame, field: np.ndarray | None) -> DataFrame:
    """(block, doc_id, starts, lasts, before, after) for the blocks whose bit is set, or that ``docs`` has the starts of, with up to SIDE characters on each side.

    A block with the same sides is one row a document, wherever it stands:
    starts and lasts are the first and the last start of each run of starts at
    most SPAN apart. A span around a block has SPAN characters at least, so the
    spans of a run are one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, (doc, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = value.as_py() or ""
                blocks = _blocks(text) if doc is not None else []
                if not blocks:
                    continue
                if words is None:
                    hit = np.isin([p for _, p in blocks], batch.column(2)[i].as_py())
                else:
                    at = np.array([h for h, _ in blocks], np.int64) % (len(words) * 64)
                    hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
                seen: dict[tuple[int, str, str], tuple[list[int], list[int]]] = {}
                for i in np.flatnonzero(hit).tolist():
                    h, p = blocks[i]
                    starts, lasts = seen.setdefault((h, text[max(p - SIDE, 0) : p], text[p + BLOCK : p + SPAN]), ([], []))
                    if lasts and p - lasts[-1] <= SPAN:  # a run of one character repeats a block at every place
                        lasts[-1] = p
                    else:
                        starts.append(p)
                        lasts.append(p)
                for (h, before, after), (starts, lasts) in seen.items():
                    for column, v in zip(out, (h, doc, starts, lasts, before, after), strict=True):
                        column.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES)
                    out = ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES)

    return docs.mapInArrow(run, "block bigint, doc_id bigint, starts array<bigint>, lasts array<bigint>, before string, after string")


_NAMES = ["block", "doc_id", "starts", "lasts", "before", "after"]
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string()]


def _agreeing(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi - 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def classes_of_block(ids: list[int], starts: list[list[int]], lasts: list[list[int]], befores: list[str], afters: list[str]) -> tuple[list[tuple[int, ...]], dict[tuple[int, int], tuple[int, int]]]:
    """(sets of documents that share a span at this block, covered span by (document, first start of a run)).

    Every pair of documents that shares SPAN characters around the block is in
    one of the sets, and no other pair is. Occurrences with the same sides are
    one case; few cases are compared in pairs, many by their SPAN-long windows.
    """
    cases: dict[tuple[str, str], list[int]] = {}
    for i, key in enumerate(zip(befores, afters, strict=True)):
        cases.setdefault(key, []).append(i)
    sides = [(b[::-1], a) for b, a in cases]
    rows = list(cases.values())
    docs = [{ids[i] for i in r} for r in rows]
    sets: set[tuple[int, ...]] = set()
    reach = [(-1, -1)] * len(sides)  # characters to the left and right that belong to a shared span
    for x, (b, a) in enumerate(sides):
        if len(docs[x]) > 1 and len(b) + len(a) >= SIDE:
            sets.add(tuple(sorted(docs[x])))
            reach[x] = (len(b), len(a))
    if len(sides) <= 40:
        for x in range(len(sides)):
            for y in range(x):
                left, right = _agreeing(sides[x][0], sides[y][0]), _agreeing(sides[x][1], sides[y][1])
                if left + right >= SIDE and len(docs[x] | docs[y]) > 1:
                    sets.add(tuple(sorted(docs[x] | docs[y])))
                    for z in (x, y):
                        reach[z] = (max(reach[z][0], left), max(reach[z][1], right))
    else:
        for left in range(SIDE + 1):
            windows: dict[tuple[str, str], list[int]] = {}
            for x, (b, a) in enumerate(sides):
                if len(b) >= left and len(a) >= SIDE - left:
                    windows.setdefault((b[:left], a[: SIDE - left]), []).append(x)
            for same in windows.values():
                members = set().union(*(docs[x] for x in same))
                if len(same) > 1 and len(members) > 1:
                    sets.add(tuple(sorted(members)))
                    for x in same:
                        reach[x] = (max(reach[x][0], left), max(reach[x][1], SIDE - left))
    covered = {}
    for x, (left, right) in enumerate(reach):
        if left >= 0:
            for i in rows[x]:
                for first, last in zip(starts[i], lasts[i], strict=True):
                    covered[ids[i], first] = (first - left, last + BLOCK + right)
    return sorted(sets), covered


def _set_key(members: tuple[int, ...]) -> bytes:
    return xxhash.xxh3_128_digest(np.array(members, np.int64).tobytes())


_FOUND = "class binary, doc_id bigint, start bigint, end bigint"


def _compare(rows: DataFrame) -> DataFrame:
    """Classes and spans of the occurrences ``rows``, block by block.

    Rows are sorted by block within partitions and streamed, so many small
    blocks cost no call each, and a task holds one block's rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        out: tuple[list, ...] = ([], [], [], [])

        def close() -> None:
            if len({r[0] for r in held}) < 2:
                return
            sets, covered = classes_of_block(*map(list, zip(*held, strict=True)))
            for s in sets:
                out[0].extend([_set_key(s)] * len(s))
                out[1].extend(s)
                out[2].extend([None] * len(s))
                out[3].extend([None] * len(s))
            for (doc, _), (a, b) in covered.items():
                for column, v in zip(out, (None, doc, a, b), strict=True):
                    column.append(v)

        def take() -> pa.RecordBatch:
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["class", "doc_id", "start", "end"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    close()
                    block, held = b, []
                held.append(row)
            if len(out[0]) > 50_000:
                yield take()
        close()
        yield take()

    rows = rows.select(*_NAMES)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, _FOUND)


def _compare_hot(hot: DataFrame) -> DataFrame:
    """The same as :func:`_compare` for blocks with any number of occurrences, by joins and aggregations only.

    Every occurrence gives its SPAN-long windows around the block; a window
    that two documents have is a class. Classes with the same members (equal
    number, sum of hashes, smallest and largest) are kept once.
    """
    windows = hot.select(
        "block", "doc_id", "starts", "lasts", F.length("before").alias("nb"), "before", "after", F.explode(F.sequence(F.lit(0), F.lit(SIDE))).alias("left")
    ).where((F.col("nb") >= F.col("left")) & (F.length("after") >= SIDE - F.col("left")))
    windows = windows.select(
        "doc_id",
        F.transform(F.arrays_zip("starts", "lasts"), lambda x: F.struct((x["starts"] - F.col("left")).alias("start"), (x["lasts"] - F.col("left") + SPAN).alias("end"))).alias("runs"),
        F.unhex(F.md5(F.concat(F.col("block").cast("string"), F.lit(":"), F.col("left").cast("string"), F.lit(":"), F.expr("right(before, left)"), F.lit("|"), F.expr(f"left(after, {SIDE} - left)")))).alias("w"),
    )
    found = windows.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    found = windows.join(found.where("lo < hi").select("w"), "w")
    members = found.select("w", "doc_id").distinct()
    sign = members.groupBy("w").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    keep = sign.groupBy("n", "s", "lo", "hi").agg(F.min("w").alias("w")).select("w")
    sets = members.join(keep, "w").select(F.col("w").alias("class"), "doc_id", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    spans = found.select(F.lit(None).cast("binary").alias("class"), "doc_id", F.inline("runs"))
    return sets.unionByName(spans)


def parse(docs: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """Classes and spans of ``docs`` (doc_id, text): rows (class, doc_id, -, -) and (-, doc_id, start, end).

    Two documents share SPAN characters exactly if some class has both. Null
    and short texts have neither. The first pass counts blocks, the second
    takes up the places of the shared ones; texts are never shuffled, only the
    surroundings of shared blocks are.
    """
    index = written(block_index(docs))
    n = index.count()
    if n * 64 <= FILTER_BITS[1]:
        rows = occurrences(docs, block_filter(index, n))
    else:
        rows = occurrences(marked(docs, index), None)
    hot = index.where(F.col("n") > most_in_task).select("block", F.lit(True).alias("__hot"))
    if not hot.take(1):
        return _compare(rows)
    rows = written(rows.join(hot, "block", "left"))
    cold = _compare(rows.where("__hot is null"))
    return cold.unionByName(_compare_hot(rows.where("__hot").drop("__hot")))


def _sets(docs: DataFrame, most_in_task: int) -> DataFrame:
    """(class, doc_id): sets of documents, each pair of which shares SPAN characters."""
    return parse(docs, most_in_task).where("class is not null").select("class", "doc_id").distinct()


def linked_pairs(docs: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents that share at least SPAN characters.

    Classes are made distinct before they are expanded; the expansion is a
    self-join whose hot classes the adaptive skew join splits.
    """
    sets = _sets(docs, most_in_task)
    a, b = sets.withColumnRenamed("doc_id", "doc_id_a"), sets.withColumnRenamed("doc_id", "doc_id_b")
    return a.join(b, "class").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def linked_classes(docs: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(doc_id, class_id, n_links): every document that shares a span, the smallest document it is connected with, and with how many it shares one.

    Documents that are in the same sets are one group, whatever their number;
    only groups are paired, so a text that a third of all documents share is
    never expanded into pairs.
    """
    sets = written(_sets(docs, most_in_task))
    sign = sets.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("s"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    same = sign.groupBy("n", "s", "lo", "hi").agg(F.min("doc_id").alias("group"), F.count("*").alias("size"))
    groups = written(sign.join(same, ["n", "s", "lo", "hi"]).select("doc_id", "group", "size"))
    heads = groups.where("doc_id = group").select("group", "size")
    members = written(sets.join(heads.withColumnRenamed("group", "doc_id"), "doc_id").select("class", F.col("doc_id").alias("group"), "size"))
    a, b = members.select("class", "group"), members.select("class", F.col("group").alias("other"), "size")
    links = a.join(b, "class").select("group", "other", "size").distinct().groupBy("group").agg((F.sum("size") - 1).alias("n_links"))
    first = members.groupBy("class").agg(F.min("group").alias("b"))
    edges = members.join(first, "class").where("group <> b").select(F.col("group").alias("a"), "b")
    label = components(edges).withColumnRenamed("node", "group")
    out = groups.join(links, "group").join(label, "group", "left")
    return out.select("doc_id", F.coalesce("root", "group").alias("class_id"), "n_links")


def shared_amounts(docs: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(doc_id, n_spans, shared_chars, n_chars) for every document with a shared span.

    Factors of a document that overlap or touch are one span. They are taken in
    order of their starts; their number is bounded by the document's own length.
    """
    spans = parse(docs, most_in_task).where("class is null").select("doc_id", "start", "end").distinct()
    reached = F.max("end").over(W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("reached", F.coalesce(reached, F.lit(-1)))
    own = F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))
    spans = spans.groupBy("doc_id").agg(F.count_if(F.col("start") > F.col("reached")).alias("n_spans"), F.sum(own).alias("shared_chars"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    return spans.join(sizes, "doc_id")


def of_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with exactly the columns this module reads."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
