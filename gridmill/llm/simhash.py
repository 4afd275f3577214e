"""SimHash near-duplicates through BK-trees.

Fingerprints: the 64 majority bits of the XXH64 values of a text's word shingles.

Search: the 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints within
``radius`` agree on at least two whole blocks, so each distinct fingerprint is
dealt to one bucket for every pair of blocks (6 pairs for radius 2), and every
link is met in some bucket.  A bucket's fingerprints form a shard: a BK-tree
whose children are keyed by their integer Hamming distance to the parent, in
which a query follows only the edges within the radius.  A bucket of more than
``shard_rows`` fingerprints is dealt again by the remaining bits, cut into
``radius + 1`` pieces of which a pair within the radius shares one; what is then
still above ``tree_rows`` is cut into chunks that meet pairwise, so that no tree
holds more than two chunks.  Copies never reach the trees: they share one
fingerprint.  Each shard sends its tree only to the
task that queries it, and returns a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .store import materialise

SEED = 42
RADIUS = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Fingerprints of a shard beyond which it is dealt again by its remaining bits.
SHARD_ROWS = 4096
#: Fingerprints of a chunk of a shard that is large even then.
TREE_ROWS = 32_768
#: Shingles hashed at a time, so that a very long text needs bounded memory.
_BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text; 0 for a text without words."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first white space after a word stays as the separator
    clean = np.where(space, np.uint8(32), _LOWER[raw])[keep]
    gap = np.concatenate(([True], clean == 32, [True])) if len(clean) else np.array([True])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    if not len(starts):
        return 0
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, hash64 = memoryview(clean.tobytes()), xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        values = np.array([hash64(view[s:e], seed) for s, e in spans], dtype="<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fp`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


class BKTree:
    """Distinct integers, each below the parent by its Hamming distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        node = (value, {})
        if self.root is None:
            self.root = node
            return
        at = self.root
        while distance := (at[0] ^ value).bit_count():
            below = at[1].get(distance)
            if below is None:
                at[1][distance] = node
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            held, children = todo.pop()
            distance = (held ^ value).bit_count()
            if distance <= radius:
                found.append(held)
            if children:
                for edge in range(max(1, distance - radius), distance + radius + 1):
                    if (child := children.get(edge)) is not None:
                        todo.append(child)
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``values``, from one BK-tree."""
    tree, parent, out = BKTree(), {}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in values:
        parent[value] = value
        for other in tree.within(value, radius):
            a, b = find(value), find(other)
            if a != b:
                parent[a] = b
                out.append((value, other))
        tree.add(value)
    return out


def _mask(width: int) -> int:
    return (1 << width) - 1


def _bits(low: int, width: int):
    return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit(_mask(width)))


def _layout(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``(a, b)``: spanning links among the distinct fingerprints of column ``fp``."""
    blocks = _layout(radius)
    pairs = list(combinations(range(len(blocks)), 2))
    keys = []
    for kind, (i, j) in enumerate(pairs):
        key = F.shiftleft(_bits(*blocks[i]), blocks[j][1]).bitwiseOR(_bits(*blocks[j]))
        # the remaining bits, cut into radius + 1 pieces across the other blocks
        rest = [b for k, b in enumerate(blocks) if k not in (i, j)]
        other, shift = F.lit(0).cast("long"), 0
        for low, width in rest:
            other = other.bitwiseOR(F.shiftleft(_bits(low, width), shift))
            shift += width
        keys.append(F.struct(F.lit(kind).alias("kind"), key.alias("key"), other.alias("other")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.kind", "b.key", "b.other")
    sizes = materialise(dealt.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    met = dealt.join(sizes, ["kind", "key"])
    width = 64 - 2 * (64 // (radius + 2))
    cuts = [width * i // (radius + 1) for i in range(radius + 2)]
    again = [
        F.struct(F.lit(i).alias("cut"), F.shiftrightunsigned("other", a).bitwiseAND(F.lit(_mask(b - a))).alias("sub"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]
    whole = F.array(F.struct(F.lit(-1).alias("cut"), F.lit(0).cast("long").alias("sub")))
    shard = ["kind", "key", "cut", "sub"]
    shards = met.select("fp", "kind", "key", "n", F.explode(F.when(F.col("n") > shard_rows, F.array(*again)).otherwise(whole)).alias("s")).select(
        "kind", "key", "s.cut", "s.sub", "fp", "n"
    )
    # only a bucket of more than tree_rows can have a shard of more
    large = shards.where(F.col("n") > tree_rows).groupBy(*shard).agg(F.ceil(F.count("*") / tree_rows).cast("int").alias("pieces")).where("pieces > 1")
    shards = shards.join(materialise(large, "large-shards"), shard, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    shards = shards.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    shards = shards.withColumns({"ca": F.least("chunk", "other"), "cb": F.greatest("chunk", "other")})
    order = [*shard, "ca", "cb"]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in order]
            if not held.num_rows:
                continue
            new = np.zeros(held.num_rows, dtype=bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            yield from _forests(held.column("fp").to_numpy(), starts, radius)
            held = held.slice(int(starts[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield from _forests(held.column("fp").to_numpy(), np.array([0, held.num_rows]), radius)

    return shards.select(*order, "fp").repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(run, "a long, b long").distinct()


def _forests(fps: np.ndarray, starts: np.ndarray, radius: int):
    """Links of every run of ``fps`` that begins at ``starts`` but the last, which may go on."""
    unsigned, out = fps.view(np.uint64), []
    for s, e in zip(starts.tolist(), starts.tolist()[1:], strict=False):
        if e - s > 1:
            out += forest(unsigned[s:e].tolist(), radius)
    if out:
        a, b = np.array(out, dtype=np.uint64).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], names=["a", "b"])


def _groups(rows: DataFrame, radius: int, shard_rows: int, tree_rows: int) -> DataFrame:
    """``fp, component_id, component`` of every fingerprint of ``rows`` (``id, fp``); ``component`` is one of its fingerprints."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comp = components(links(distinct.select("fp"), radius, shard_rows, tree_rows))
    rooted = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"), "least")
    names = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialise(rooted.select("fp", "component").join(names, "component").select("fp", "component_id", "component"), "components")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """``id, fp, component_id`` for every row.

    A text of fewer words than a shingle is one shingle; a null, empty or blank
    text has fingerprint 0 and links like any other.  ``component_id`` is the
    smallest id reachable over links; null ids pass links on but never name a
    component, unless no row of it has an id (then null).  Repeated rows are
    returned as often as they come.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return rows.join(_groups(rows, radius, shard_rows, tree_rows), "fp").select("id", "fp", "component_id")


def keep_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """The rows of ``docs``, columns as they are, that stay: one of each group of linked texts.

    Rows are told apart by their text, not by their id: an id that comes with
    texts of different groups stays once for each.  Of a group the row with the
    smallest id stays (null ids come last), then the longest text, then the one
    that was read first; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["row", "fp"])

    # fingerprints and row numbers are written beside the rows, so both are the same in every later pass
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    printed = docs.select(row, F.col(text_col).alias("text")).mapInArrow(run, StructType([StructField("row", docs.schema), StructField("fp", LongType())]))
    rows = materialise(printed.withColumn("number", F.monotonically_increasing_id()), "numbered")
    text, key = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`").cast("long")
    keys = rows.select("number", "fp", key.alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    grouped = keys.join(_groups(keys, radius, shard_rows, tree_rows), "fp")
    best = F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), (-F.col("chars")).alias("c"), F.col("number").alias("d")))
    stay = grouped.groupBy("component").agg(best.alias("best")).select(F.col("best.d").alias("number"))
    return rows.join(stay, "number", "left_semi").select("row.*")

