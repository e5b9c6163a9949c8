"""Mixing sources to target weights (problem 9).

Every drawn document is a block with a release time and a deadline on the
mixture's time line of tokens: with weight w, the block that holds its source's
tokens a to b may start at a / w and must end by b / w. Earliest deadline first
among the released blocks then interleaves the sources so that each is within
one (the largest) block of its share at every time.

The order depends on all that was dealt before, so the time line is cut into
stretches of bounded size. A cut is a time before which a block belongs if its
middle does; of the times that are tried behind every stretch's length, the one
at which all sources are closest to their shares is taken. What was dealt up to
a cut then follows from sums, and every stretch is dealt by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.llm.staging import written

#: Documents of a source that one task orders, on average.
TASK_ROWS = 20_000
#: Rows that are put out at once.
BATCH_ROWS = 20_000
#: Rows of a mixture that one task deals, on average.
STRETCH_ROWS = 50_000
#: Times that are tried for a cut, half the largest block apart.
CUTS = 128


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, by ``keys`` in the order of (bucket, *order).

    No task orders a whole key: rows are summed within a bucket, and the sums of
    whole buckets, of which there are few, give each bucket's start.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, [*keys, bucket])
    return out.withColumn(name, F.col("__start") + F.col("__within")).drop("__start", "__within")


def plan(totals: dict[str, int], targets: list[tuple[int, str, float, int]]) -> list[tuple[int, str, float, int, int]]:
    """(mix_id, source, share, tokens to draw, tokens of the mix) for each target.

    A mix is as large as its scarcest source allows: no source gives more than
    max_repeats times its size. A source that has no tokens can't be drawn
    from; the others keep their proportions without it. Targets with a null or
    a share of 0 or less are left out.
    """
    out = []
    good = [t for t in targets if None not in t and t[2] > 0 and t[3] > 0 and totals.get(t[1], 0) > 0]
    for mix in sorted({t[0] for t in good}):
        mine = [t for t in good if t[0] == mix]
        whole = sum(t[2] for t in mine)
        size = min(int(t[3] * totals[t[1]] * whole / t[2]) for t in mine)
        out += [(mix, source, share / whole, round(share / whole * size), size) for _, source, share, _ in mine]
    return out


def mix(sizes: DataFrame, targets: list[tuple[int, str, float, int]], stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """(mix_id, position, source, doc_id, pass, tokens, release, deadline): the mixtures of ``sizes`` (doc_id, source, tokens).

    ``targets`` are the rows of a fixed table. Position counts a mixture's rows
    from 0 in the order they are to be read. A source is drawn in whole passes
    in a pseudo-random order, then from the start of that order as long as whole
    documents fit in its quota (one that doesn't is skipped), and then by the few
    documents that come closest to what is left. About ``stretch_rows`` rows are
    dealt by one task.
    """
    spark = sizes.sparkSession
    wanted = sorted({t[1] for t in targets if t[1] is not None})
    docs = sizes.where(F.col("source").isin(wanted) & (F.col("tokens") > 0)).select(F.col("doc_id").cast("bigint"), "source", F.col("tokens").cast("bigint"))
    sums = {r["source"]: r for r in docs.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.max("tokens").alias("most")).collect()}
    quotas = [q for q in plan({s: r["total"] for s, r in sums.items()}, targets) if q[3] > 0]
    if not quotas:
        return spark.createDataFrame([], SCHEMA)
    buckets = max(1, max(r["n"] for r in sums.values()) // TASK_ROWS)
    docs = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.floor(F.shiftrightunsigned("h", 33) * buckets / F.lit(float(1 << 31))))
    placed = written(running_sum(docs, ["source"], "bucket", ["h", "doc_id"], "tokens", "first").drop("h", "bucket"))
    rows = [(int(m), s, float(w), int(q), sums[s]["total"]) for m, s, w, q, _ in quotas]
    by_source = spark.createDataFrame(rows, "mix_id bigint, source string, share double, quota bigint, total bigint")
    drawn = placed.join(F.broadcast(by_source), "source")  # as many rows as the fixed table of targets
    drawn = drawn.withColumn("base", F.floor(F.col("quota") / F.col("total")).cast("int")).withColumn("rest", F.col("quota") - F.col("base") * F.col("total"))
    # the first document that doesn't fit in the last pass is skipped once, and those behind it move up
    over = drawn.where("first <= rest and first + tokens > rest and rest > 0").groupBy("mix_id", "source").agg(F.min(F.struct("first", "tokens")).alias("o")).collect()
    skips = [(r["mix_id"], r["source"], r["o"]["first"], r["o"]["tokens"]) for r in over]
    skipped = F.broadcast(spark.createDataFrame(skips, "mix_id bigint, source string, skip_first bigint, skip_tokens bigint"))
    drawn = drawn.join(skipped, ["mix_id", "source"], "left")
    moved = F.when(F.col("first") > F.col("skip_first"), F.col("skip_tokens")).otherwise(0)
    fits = (F.col("first") - moved + F.col("tokens") <= F.col("rest")) & ~F.coalesce(F.col("first") == F.col("skip_first"), F.lit(False))
    drawn = drawn.withColumn("moved", moved).withColumn("n", F.col("base") + fits.cast("int"))
    extra = _closers(drawn, quotas)
    passes = drawn.where("n > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("start", F.col("pass") * F.col("total") + F.col("first") - F.when(F.col("pass") == F.col("base"), F.col("moved")).otherwise(0))
    drawn = passes.select("mix_id", "source", "doc_id", "pass", "tokens", "start", "share")
    if extra:
        added = spark.createDataFrame(extra, "mix_id bigint, source string, doc_id bigint, pass int, tokens bigint, start bigint")
        drawn = drawn.unionByName(added.join(F.broadcast(by_source.select("mix_id", "source", "share")), ["mix_id", "source"]))
    drawn = drawn.select("mix_id", (F.col("start") / F.col("share")).alias("release"), ((F.col("start") + F.col("tokens")) / F.col("share")).alias("deadline"), "source", "doc_id", "pass", "tokens")
    return _interleaved(drawn, quotas, sums, stretch_rows)


SCHEMA = "mix_id bigint, position bigint, source string, doc_id bigint, pass int, tokens bigint, release double, deadline double"


def _interleaved(drawn: DataFrame, quotas: list[tuple[int, str, float, int, int]], sums: dict, stretch_rows: int) -> DataFrame:
    """The rows ``drawn`` in the order they are to be read, stretch by stretch."""
    spark = drawn.sparkSession
    sources = sorted({q[1] for q in quotas})
    lines = []
    for m in sorted({q[0] for q in quotas}):
        mine = {s: (w, q) for k, s, w, q, _ in quotas if k == m}
        step = max(sums[s]["most"] for s in mine) / 2
        per_row = sum(q for _, q in mine.values()) / max(sum(q * sums[s]["n"] / sums[s]["total"] for s, (_, q) in mine.items()), 1)
        lines.append((m, step, max(stretch_rows * per_row, 1.25 * CUTS * step), [mine[s][0] if s in mine else 0.0 for s in sources]))
    line = F.broadcast(spark.createDataFrame(lines, "mix_id bigint, step double, length double, weights array<double>"))  # a row for each mixture
    middle = (F.col("release") + F.col("deadline")) / 2
    drawn = drawn.join(line.drop("weights"), "mix_id").withColumn("stretch", F.floor(middle / F.col("length")))
    late = F.floor((middle - F.col("stretch") * F.col("length")) / F.col("step"))
    drawn = drawn.withColumn("late", F.least(late, F.lit(CUTS)).cast("int")).drop("step", "length")
    # what each source gave before every time that is tried, from sums: few rows for each stretch
    given = F.array(*(F.coalesce(F.sum(F.when(F.col("source") == s, F.col("tokens"))), F.lit(0)) for s in sources))
    tried = drawn.groupBy("mix_id", "stretch", "late").agg(given.alias("given"), F.count("*").alias("rows"))
    each = [F.col("given")[i] for i in range(len(sources))]
    whole = tried.groupBy("mix_id", "stretch").agg(F.array(*(F.sum(e) for e in each)).alias("given"), F.sum("rows").alias("rows"))
    by_mix = W.partitionBy("mix_id").orderBy("stretch")
    before = by_mix.rowsBetween(W.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    whole = whole.select("mix_id", "stretch", F.array(*(sum_before(e, before) for e in each)).alias("given_before"), sum_before("rows", before).alias("rows_before"), F.coalesce(F.lag("stretch").over(by_mix) != F.col("stretch") - 1, F.lit(True)).alias("first"))
    within = W.partitionBy("mix_id", "stretch").orderBy("late").rowsBetween(W.unboundedPreceding, -1)
    tried = tried.join(whole, ["mix_id", "stretch"]).join(line.select("mix_id", "weights"), "mix_id")
    so_far = F.array(*(sum_before(e, within) + F.col("given_before")[i] for i, e in enumerate(each)))
    tried = tried.select("mix_id", "stretch", "late", "first", "weights", so_far.alias("given"), (F.col("rows_before") + sum_before("rows", within)).alias("position"))
    tried = tried.withColumn("now", F.aggregate("given", F.lit(0).cast("bigint"), lambda a, x: a + x))
    off = F.array_max(F.zip_with("given", "weights", lambda g, w: F.abs(g - w * F.col("now"))))
    # a stretch with none before it starts at its first row
    cuts = tried.groupBy("mix_id", "stretch").agg(F.min(F.struct(F.when(F.col("first"), 0.0).otherwise(off).alias("off"), F.col("late"), F.col("now"), F.col("position"))).alias("c"))
    follows = F.lead("stretch").over(by_mix) == F.col("stretch") + 1
    heads = cuts.select("mix_id", "stretch", "c.now", "c.position", F.col("c.late").alias("since"), F.when(follows, F.lead("c.late").over(by_mix)).otherwise(0).alias("until"))
    # rows before a cut belong to the stretch before, so both get those that may; each takes its own
    ways = F.when((F.col("late") < CUTS) & (F.col("stretch") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = drawn.withColumn("next", F.explode(ways)).withColumn("stretch", F.col("stretch") - F.col("next"))
    nothing = {c: F.lit(None) for c in ("release", "deadline", "source", "doc_id", "pass", "tokens", "late", "next")}
    sent = sent.withColumns({c: F.lit(None).cast("bigint") for c in ("now", "position", "since", "until")}).unionByName(heads.withColumns(nothing))
    sent = sent.select("mix_id", "stretch", "release", "deadline", "source", "doc_id", "pass", "tokens", "late", "next", "now", "position", "since", "until")
    return sent.repartition("mix_id", "stretch").sortWithinPartitions("mix_id", "stretch", F.col("release").asc_nulls_first(), "deadline", "source", "doc_id", "pass").mapInArrow(_dealt, SCHEMA)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (mix_id, stretch, release), each stretch's head first, as they are to be read: of the blocks released by now, the one with the earliest deadline.

    Now is the number of tokens dealt. What is released and waits is held,
    which is about one block's tokens of each source. Where nothing is
    released, as at the end when a source is short of its quota, the next one is.
    """
    ready: list[tuple] = []
    out: list[tuple] = []
    at, now, position, since, until = None, 0, 0, 0, 0

    def deal() -> None:
        nonlocal now, position
        deadline, release, source, doc, turn, tokens = heapq.heappop(ready)
        out.append((at[0], position, source, doc, turn, tokens, release, deadline))
        now, position = now + tokens, position + 1

    def take() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else [()] * len(types)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["mix_id", "position", "source", "doc_id", "pass", "tokens", "release", "deadline"])
        out.clear()
        return batch

    for batch in batches:
        for m, k, release, deadline, source, doc, turn, tokens, late, following, *head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if release is None:
                while ready:
                    deal()
                at, (now, position, since, until) = (m, k), head
                continue
            if (m, k) != at or (late >= until if following else late < since):
                continue  # another stretch's
            while ready and release > now * (1 + 1e-12) + 1e-9:
                deal()
            heapq.heappush(ready, (deadline, release, source, doc, turn, tokens))
            if len(out) >= BATCH_ROWS:
                yield take()
    while ready:
        deal()
    yield take()


def _closers(drawn: DataFrame, quotas: list[tuple[int, str, float, int, int]]) -> list[tuple[int, str, int, int, int, int]]:
    """For each target the documents that bring its source closer to the quota.

    Each is the one that comes closest to what is left, among the documents
    that the last pass hasn't reached; ties go to the smaller doc_id. It ends
    when none comes closer. All results have a row for each target of the
    fixed table.
    """
    spark = drawn.sparkSession
    done = {(r["mix_id"], r["source"]): r["t"] for r in drawn.groupBy("mix_id", "source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    gaps = {(int(m), s): int(q - done.get((m, s), 0)) for m, s, _, q, _ in quotas}
    out: list[tuple[int, str, int, int, int, int]] = []
    while open_ := [(m, s, g) for (m, s), g in gaps.items() if g > 0]:
        left = drawn.join(F.broadcast(spark.createDataFrame(open_, "mix_id bigint, source string, gap bigint")), ["mix_id", "source"])
        left = left.where("abs(tokens - gap) < gap and n = floor(quota / total)")
        if out:
            taken = spark.createDataFrame([r[:3] for r in out], "mix_id bigint, source string, doc_id bigint")
            left = left.join(F.broadcast(taken), ["mix_id", "source", "doc_id"], "left_anti")
        best = left.groupBy("mix_id", "source", "quota").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("gap")).alias("off"), "doc_id", "n", "tokens")).alias("b")).collect()
        for r in best:
            key = (r["mix_id"], r["source"])
            out.append((*key, r["b"]["doc_id"], r["b"]["n"], r["b"]["tokens"], r["quota"] - gaps[key]))
        gaps = {(r["mix_id"], r["source"]): gaps[r["mix_id"], r["source"]] - r["b"]["tokens"] for r in best}
    return out


def shares(mixed: DataFrame, targets: list[tuple[int, str, float, int]]) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, most_repeats) of mixtures; a source that gives nothing has 0."""
    spark = mixed.sparkSession
    rows = [(int(m), s, float(w), int(r)) for m, s, w, r in targets if None not in (m, s, w, r)]
    wanted = spark.createDataFrame(rows, "mix_id bigint, source string, target_share double, max_repeats int")
    got = mixed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), (F.max("pass") + 1).alias("most_repeats"))
    whole = W.partitionBy("mix_id")  # one row for each target of the fixed table
    out = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "most_repeats"])
    total = F.sum("tokens").over(whole)
    return out.select("mix_id", "source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "tokens", "most_repeats", "max_repeats")
