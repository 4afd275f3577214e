"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are put in a fixed pseudo-random order and cut into blocks.
Block ``i`` (from 1) of a source of weight ``w`` may run from slot
``floor((i - 1) / w)`` on and must have run by slot ``ceil(i / w)``; in every
slot the released block with the earliest deadline runs.  At any point of the
schedule a source is then less than one block away from its share.  When a source
runs out, an era ends: the weights of the others are scaled up to one and the
schedule goes on, so each row is placed exactly once and none is dropped or
repeated.

Inside an era the schedule repeats: after as many slots as the weights, as whole
numbers, sum up to, every source has had exactly its share.  So one period is
written, with the number of times it comes (work that does not grow with the
table), and is spread to all blocks in parallel.

Ranks come from counts per (source, bucket), summed up group by group, and a window
within a bucket, so a source that holds a third of the table is sorted in pieces
of one size.  A bucket learns its offset and the slots of its blocks before its rows
do; rows are shuffled once, by bucket.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Rows in a block.
BLOCK = 64
#: Rows that are ranked together, about; a source of any size is ranked in as many buckets as that takes.
RANKED_ROWS = 250
#: Buckets of a source whose counts are summed up together.
_GROUP = 4096
#: Distinct sources that a schedule takes; their counts go to the driver.
MAX_SOURCES = 100_000
#: Denominator that weights are rounded to, so that deadlines are whole-number arithmetic.
UNIT = 1_000_000
NO_SOURCE = "\x00none"


def _era(weight: dict[str, int]):
    """Yield (source, i) for one slot after the other, i from 1, as if no source ever ran out."""
    total = sum(weight.values())
    waiting = [(0, s, 1) for s in sorted(weight)]  # (release, source, i)
    ready: list[tuple[int, int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // weight[s]), release, s, i))
        if ready:  # the shares fill every slot
            _, _, s, i = heapq.heappop(ready)
            yield s, i
            heapq.heappush(waiting, (i * total // weight[s], s, i + 1))
        t += 1


def _turns(blocks: dict[str, int], weights: dict[str, float]) -> list[dict[str, int]]:
    """Whole-number weights of the sources that are scheduled together: first those of positive weight, then those of weight 0, which share alike."""
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    least = min((w for w in weights.values() if w > 0), default=1.0)
    given = {s: weights.get(s, least) for s, n in blocks.items() if n > 0}
    first = {s: max(1, round(UNIT * w)) for s, w in given.items() if w > 0}
    return [turn for turn in (first, {s: 1 for s, w in given.items() if w == 0}) if turn]


def schedule(blocks: dict[str, int], weights: dict[str, float]):
    """Yield (slot, source, block) of every block, blocks and slots from 0.

    ``weights`` are relative.  A source that has none counts as the smallest
    positive weight; one of weight 0 is only scheduled when the others have run
    out.  Ties go to the smaller release, then the name.
    """
    slot = 0
    for turn in _turns(blocks, weights):
        left = {s: blocks[s] for s in turn}
        while left:
            for s, _ in _era({s: turn[s] for s in left}):
                yield slot, s, blocks[s] - left[s]
                slot += 1
                left[s] -= 1
                if not left[s]:
                    del left[s]
                    break


def pattern(blocks: dict[str, int], weights: dict[str, float]):
    """Yield (source, block, slot, block_step, slot_step, times): ``schedule`` with one entry for what repeats in an era."""
    slot = 0
    for turn in _turns(blocks, weights):
        left = {s: blocks[s] for s in turn}
        while left:
            common = math.gcd(*[turn[s] for s in left])
            weight = {s: turn[s] // common for s in left}
            period = sum(weight.values())
            # whole periods after which every source still has a block
            times = min((n - 1) // weight[s] for s, n in left.items())
            if times:
                for t, (s, i) in enumerate(islice(_era(weight), period)):
                    yield s, blocks[s] - left[s] + i - 1, slot + t, weight[s], period, times
                slot += period * times
                left = {s: n - weight[s] * times for s, n in left.items()}
            for s, _ in _era(weight):
                yield s, blocks[s] - left[s], slot, 1, 1, 1
                slot += 1
                left[s] -= 1
                if not left[s]:
                    del left[s]
                    break


def smoothed(counts: dict[str, int], power: float = 0.7) -> dict[str, float]:
    """Weights from natural shares raised to ``power``."""
    total = sum(n**power for n in counts.values()) or 1.0
    return {s: n**power / total for s, n in counts.items()}


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    rows = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["s"]: r["count"] for r in rows}


_ENTRY = "mix_source string, block long, slot long, block_step long, slot_step long, times long"
_ENTRY_TYPES = (pa.string(), *[pa.int64()] * 5)


def plan(spark, counts: dict[str, int], weights: dict[str, float], block: int = BLOCK) -> DataFrame:
    """``mix_source, mix_block, mix_slot``: the pattern, made in one task of bounded work, spread to every block."""
    blocks = {s: -(-n // block) for s, n in counts.items()}

    def run(batches):
        for _ in batches:
            pass
        entries = pattern(blocks, weights)
        while rows := list(islice(entries, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY_TYPES, strict=True)], names=[x.split()[0] for x in _ENTRY.split(", ")])

    entries = materialise(spark.range(1, numPartitions=1).mapInArrow(run, _ENTRY), "mix-pattern")
    each = entries.repartition("mix_source", "block").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.select("mix_source", (F.col("block") + F.col("k") * F.col("block_step")).alias("mix_block"), (F.col("slot") + F.col("k") * F.col("slot_step")).alias("mix_slot"))


def _offsets(sizes: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """``s, b, offset, first_block, slots`` of every (source, bucket) of ``sizes`` (``mix_source, bucket, n``)."""
    grouped = sizes.withColumn("g", F.floor(F.col("bucket") / _GROUP))
    until = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("mix_source", "g").agg(F.sum("n").alias("all"))
    sums = sums.select("mix_source", "g", F.coalesce(F.sum("all").over(until(["mix_source"], "g")), F.lit(0)).alias("base"))
    inside = grouped.withColumn("more", F.coalesce(F.sum("n").over(until(["mix_source", "g"], "bucket")), F.lit(0)))
    placed = inside.join(sums, ["mix_source", "g"]).select("mix_source", "bucket", (F.col("base") + F.col("more")).alias("offset"), "n")
    span = F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("n") - 1) / block))
    met = placed.select("mix_source", "bucket", "offset", F.explode(span).alias("mix_block")).join(slots, ["mix_source", "mix_block"])
    listed = met.groupBy("mix_source", "bucket", "offset").agg(F.sort_array(F.collect_list(F.struct("mix_block", "mix_slot"))).alias("slots"))
    return listed.select(F.col("mix_source").alias("s"), F.col("bucket").alias("b"), "offset", F.col("slots")[0]["mix_block"].alias("first_block"), F.col("slots.mix_slot").alias("slots"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, ranked_rows: int = RANKED_ROWS, seed: int = 42) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with its place in the mixture.

    Adds ``mix_source`` (a null source is a source of its own), ``mix_rank`` (from
    0, in the source's pseudo-random order), ``mix_block``, ``mix_slot`` and
    ``mix_position`` (a total order of rows: by slot, then rank).  Without
    ``weights`` the natural shares raised to 0.7 are taken.  Rows that repeat are
    placed as often as they come; rows that agree in every column are
    interchangeable.  An empty table gives an empty result.
    """
    return _mixed(docs, source_counts(docs, source_col), weights, id_col, source_col, block, ranked_rows, seed)


def _mixed(docs: DataFrame, counts: dict[str, int], weights: dict[str, float] | None, id_col: str, source_col: str, block: int, ranked_rows: int, seed: int) -> DataFrame:
    weights = smoothed(counts) if weights is None else weights
    buckets = -(-max(counts.values(), default=1) // ranked_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(
        row.alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("mix_source"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        F.col(id_col).alias("i"),
    ).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sizes = materialise(keyed.groupBy("mix_source", "bucket").agg(F.count("*").alias("n")), "mix-buckets")
    offsets = materialise(_offsets(sizes, plan(docs.sparkSession, counts, weights, block), block), "mix-offsets")
    within = Window.partitionBy("mix_source", "bucket").orderBy("h", "i", *([F.xxhash64("row")] if docs.columns else []))
    ranked = keyed.withColumn("rn", F.row_number().over(within) - 1)
    placed = ranked.join(offsets, (F.col("mix_source") == F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("mix_rank", F.col("offset") + F.col("rn"))
    placed = placed.withColumn("mix_block", F.floor(F.col("mix_rank") / block).cast("long"))
    placed = placed.withColumn("mix_slot", F.get("slots", (F.col("mix_block") - F.col("first_block")).cast("int")))
    return placed.select("row", "mix_source", "mix_rank", "mix_block", "mix_slot", (F.col("mix_slot") * block + F.col("mix_rank") % block).alias("mix_position"))


def in_order(
    docs: DataFrame, weights: dict[str, float] | None = None, partitions: int | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, ranked_rows: int = RANKED_ROWS, seed: int = 42, place: str | None = None
) -> DataFrame:
    """The rows of ``docs``, columns as they are, in the mixture's order (over partitions and within them).

    With ``place`` a last column of that name (which replaces one of ``docs``) holds
    each row's ``mix_position``, so that the order outlasts files.

    There are ``partitions`` of equally many slots (as many as the session's
    shuffles have, if not given); slots are known, so nothing has to be sampled.
    """
    counts = source_counts(docs, source_col)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, sum(-(-c // block) for c in counts.values()))
    mixed = _mixed(docs, counts, weights, id_col, source_col, block, ranked_rows, seed)
    dealt = mixed.repartitionById(n, F.floor(F.col("mix_slot") * n / slots).cast("int"))
    ordered = dealt.sortWithinPartitions("mix_position")
    if place is None:
        return ordered.select("row.*")
    return ordered.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != place], F.col("mix_position").alias(place))
