"""Filling fixed-capacity containers with items (problem 8).

Items are packed in partitions by best-fit decreasing. Dual feasible functions
give a lower bound of a partition's containers, which certifies its packing or
shows a gap; the loosely filled containers of partitions with gaps are opened,
their items exchanged between partitions, and packed again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.staging import written

#: Items of a partition, on average.
PART_ITEMS = 8_000
#: A round of exchange must save this share of the containers that take part in it, or it is the last one.
LEAST_GAIN = 1e-4
#: A container filled below this share is loose.
LOOSE = 0.995
#: Thresholds, as parts of the capacity, of the bound of all items together.
THRESHOLDS = 64


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item. Items of equal size are taken in their order."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    levels: list[int] = []
    used = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(levels, size)
        if at == len(levels):
            left, bin_ = capacity, used
            used += 1
        else:
            left = levels[at]
            same = free[left]
            bin_ = same.pop()
            if not same:
                del free[left], levels[at]
        where[i] = bin_
        left -= size
        if left:
            if left not in free:
                free[left] = []
                insort(levels, left)
            free[left].append(bin_)
    return where


def feasible_sums(value: np.ndarray, count: np.ndarray, capacity: int, thresholds: list[int]) -> np.ndarray:
    """The sums of three families of dual feasible functions over ``count`` items of each size in ``value``.

    Fixed values (the functions' definitions, x being a size over the capacity):
    x itself; the rounding functions with k in 1 to 20; for each threshold e the
    function that counts sizes above 1 - e as 1 and drops those below e, and the
    function that weighs sizes above a half by what fits beside them. No packing
    has fewer containers than any of these sums.
    """
    x = value / capacity
    out = [(x * count).sum()]
    for k in range(1, 21):
        whole = value * (k + 1) % capacity == 0
        out.append((np.where(whole, x, value * (k + 1) // capacity / k) * count).sum())
    for e in thresholds:
        out.append((np.where(value > capacity - e, 1.0, np.where(value < e, 0.0, x)) * count).sum())
        parts = capacity // e
        out.append((np.where(value * 2 > capacity, 1 - (capacity - value) // e / parts, np.where(value >= e, 1 / parts, 0.0)) * count).sum())
    return np.array(out)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of ``sizes`` has fewer containers: the largest of the :func:`feasible_sums`, with 200 of the sizes up to a half as thresholds."""
    if not len(sizes):
        return 0
    value, count = np.unique(sizes, return_counts=True)
    thresholds = np.unique(value[value * 2 <= capacity])[:: max(1, len(value) // 200)].tolist()
    return int(np.ceil(feasible_sums(value, count, capacity, thresholds).max() - 1e-6))


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """Packs one partition; items of loose containers are marked if the bound shows a gap."""
    group = group.sort_values("doc_id", kind="stable")
    sizes, capacity = group["tokens"].to_numpy(np.int64), int(group["capacity"].iloc[0])
    where = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(where, weights=sizes)
    bound = lower_bound(sizes, capacity)
    gap = len(fill) > bound
    return group.assign(bin=where, bound=bound, loose=gap & (fill[where] < LOOSE * capacity))


_SCHEMA = "spec_id bigint, part bigint, doc_id bigint, piece int, tokens bigint, capacity bigint, bin bigint, bound bigint, loose boolean"


def _items(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, tokens, spec_id, capacity): every text with a size, for each capacity."""
    per_spec = F.explode(F.array(*(F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in specs)))
    sizes = sizes.where("tokens > 0 and doc_id is not null").select(F.col("doc_id").cast("bigint"), F.col("tokens").cast("bigint"))
    return sizes.withColumn("s", per_spec).select("doc_id", "tokens", "s.spec_id", "s.capacity")


def _rest(items: DataFrame) -> DataFrame:
    """What remains of every text when the full pieces are cut off."""
    return items.select("spec_id", "doc_id", F.expr("cast(tokens div capacity as int)").alias("piece"), (F.col("tokens") % F.col("capacity")).alias("tokens"), "capacity").where("tokens > 0")


def rounds_of(sizes: DataFrame, specs: list[tuple[int, int]], part_items: int = PART_ITEMS) -> list[DataFrame]:
    """The packings of every round: the columns of _SCHEMA. What is loose in a round is packed again in the next one.

    Each round mixes the loose items of all partitions anew into partitions of
    about ``part_items`` items. It ends when all packings are certified by
    their bounds, or when a round saves no more than LEAST_GAIN of the
    containers that take part in it; a round that needs more is not used.
    Nothing is loose in the last round.
    """
    rest = _rest(_items(sizes, specs)).withColumn("n", F.lit(0))
    counts = {r["spec_id"]: r["n"] for r in rest.groupBy("spec_id").agg(F.count("*").alias("n")).collect()}
    out: list[DataFrame] = []
    entered: dict[int, int] = {}
    while counts:
        parts = F.element_at(F.create_map(*(F.lit(x).cast("bigint") for s, n in counts.items() for x in (s, -(-n // part_items)))), F.col("spec_id"))
        rest = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(len(out))), parts))
        packed = written(rest.select("spec_id", "part", "doc_id", "piece", "tokens", "capacity").groupBy("spec_id", "part").applyInPandas(_pack, _SCHEMA))
        out.append(packed)
        # a row for each capacity
        state = packed.groupBy("spec_id", "part", "bin", "loose").agg(F.count("*").alias("items")).groupBy("spec_id").agg(
            F.count("*").alias("bins"), F.count_if("loose").alias("loose"), F.sum(F.when(F.col("loose"), F.col("items"))).alias("items"), F.countDistinct("part").alias("parts")
        )
        state = {r["spec_id"]: r for r in state.collect()}
        worse = [s for s, r in state.items() if r["bins"] > entered.get(s, r["bins"])]
        if worse:  # the packing before was better
            out[-2] = out[-2].withColumn("loose", F.col("loose") & ~F.col("spec_id").isin(worse))
            out[-1] = packed = packed.where(~F.col("spec_id").isin(worse))
        gained = {s for s, r in state.items() if s not in entered or entered[s] - r["bins"] > LEAST_GAIN * entered[s]}
        again = {s: r for s, r in state.items() if s in gained and s not in worse and r["loose"] and r["parts"] > 1}
        entered, counts = {s: r["loose"] for s, r in again.items()}, {s: r["items"] for s, r in again.items()}
        if again.keys() != state.keys():
            out[-1] = packed.withColumn("loose", F.col("loose") & F.col("spec_id").isin(list(again)))
        rest = packed.where(F.col("loose") & F.col("spec_id").isin(list(again)))
    return out


def pack(sizes: DataFrame, specs: list[tuple[int, int]], part_items: int = PART_ITEMS) -> DataFrame:
    """(spec_id, container, doc_id, piece, token_start, tokens): where each text of ``sizes`` (doc_id, tokens) goes.

    ``specs`` are (spec_id, capacity) of a fixed table. A text above the
    capacity is split: full pieces fill containers of their own and the rest is
    an item; no other text is split. Texts of size 0 and null sizes are not
    placed. Partitions have about ``part_items`` items whatever the number of
    texts; the result doesn't depend on how the tables are stored.
    """
    if not specs:
        empty = "spec_id bigint, container string, doc_id bigint, piece int, token_start bigint, tokens bigint"
        return sizes.sparkSession.createDataFrame([], empty)
    full = _items(sizes, specs).where("tokens >= capacity").select(
        "spec_id", "doc_id", "capacity", F.explode(F.expr("sequence(0, cast(tokens div capacity as int) - 1)")).alias("piece")
    )
    placed = full.select("spec_id", F.expr("concat('f-', doc_id, '-', piece)").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"))
    for n, packed in enumerate(rounds_of(sizes, specs, part_items)):
        placed = placed.unionByName(
            packed.where("not loose").select("spec_id", F.concat(F.lit(f"{n}-"), F.col("part"), F.lit("-"), F.col("bin")).alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), "tokens")
        )
    return placed


def certificates(sizes: DataFrame, specs: list[tuple[int, int]], part_items: int = PART_ITEMS) -> DataFrame:
    """(spec_id, round, part, items, containers, bound, certified, exchanged) of every partition that was packed.

    bound is the dual feasible bound of the partition's items: certified if it
    has no more containers. exchanged are its containers that were opened for
    the next round.
    """
    out = sizes.sparkSession.createDataFrame([], "spec_id bigint, round int, part bigint, items bigint, containers bigint, bound bigint, certified boolean, exchanged bigint")
    for n, packed in enumerate(rounds_of(sizes, specs, part_items) if specs else []):
        by_bin = packed.groupBy("spec_id", "part", "bin").agg(F.count("*").alias("items"), F.first("bound").alias("bound"), F.max("loose").alias("loose"))
        part = by_bin.groupBy("spec_id", "part").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.first("bound").alias("bound"), F.count_if("loose").alias("exchanged"))
        out = out.unionByName(part.withColumns({"round": F.lit(n), "certified": F.col("containers") == F.col("bound")}))
    return out


def least_containers(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(spec_id, least_containers): no packing of all texts has fewer containers, by dual feasible functions summed over all items.

    Full pieces count one each.
    """
    capacity = dict(specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            spec, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in np.unique(spec).tolist():
                value, count = np.unique(size[spec == s], return_counts=True)
                thresholds = sorted({max(1, capacity[s] * j // (2 * THRESHOLDS)) for j in range(1, THRESHOLDS + 1)})
                sums = feasible_sums(value, count, capacity[s], thresholds)
                total[s] = total[s] + sums if s in total else sums
        rows = [(s, i, x) for s, sums in total.items() for i, x in enumerate(sums.tolist())]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["spec_id", "f", "s"])

    items = _items(sizes, specs)
    sums = _rest(items).select("spec_id", "tokens").mapInArrow(run, "spec_id bigint, f int, s double").groupBy("spec_id", "f").agg(F.sum("s").alias("s"))
    rest = sums.groupBy("spec_id").agg(F.ceil(F.max("s") - 1e-6).alias("rest"))
    full = items.groupBy("spec_id").agg(F.sum(F.expr("tokens div capacity")).alias("full"))
    return full.join(rest, "spec_id", "left").select("spec_id", (F.col("full") + F.coalesce("rest", F.lit(0))).cast("bigint").alias("least_containers"))


def report(placed: DataFrame, sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(spec_id, capacity, containers, tokens, least_containers, unused_share) of a packing ``placed`` of ``sizes``."""
    capacity = F.element_at(F.create_map(*(F.lit(x).cast("bigint") for s in specs for x in s)), F.col("spec_id"))
    out = placed.groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("capacity", capacity)
    return out.join(least_containers(sizes, specs), "spec_id").select("spec_id", "capacity", "containers", "tokens", "least_containers", F.expr("1 - tokens / (containers * capacity)").alias("unused_share"))
