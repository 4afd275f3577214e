"""Embedding near-duplicates by E8 lattice hashing.

A table projects unit vectors at random to 8 dimensions (``parts`` times) and
decodes each projection to the nearest point of the E8 lattice; the points are
the vector's cell.  A vector is kept in its own cell of every table and also
probes the neighbouring cells that lie closest to it.  Vectors that meet in a cell
and share a label are verified by their cosine in double precision.

* Identical vectors (same label, same components) are one node from the start.
* A node's cells are computed once and written; they travel with its vector.
* A cell of more than ``chunk`` nodes is cut into chunks that meet pairwise in
  tasks of bounded size, so no cell is gathered in one task.
* A cell returns its verified links (a large one a spanning forest of them), from
  which connected components come, and for every node the number of its links.  A pair that meets
  in several cells is counted in the first of them, which both nodes' lists of
  cells tell, so each link that was found counts once and none is listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructType

from .components import components
from .store import materialise

THRESHOLD = 0.93
TABLES = 6
PROBES = 4
#: The lattice's unit in projected space; a pair at the threshold is about 0.37 apart.
SCALE = 0.75
#: Projections whose lattice points make a cell together.
PARTS = 2
#: Nodes of a cell that are compared with each other in one task, or with as many others.
CHUNK = 2048
#: Nodes up to which a cell's pairs are looked at together with those of other small cells.
SMALL = 16
#: Low bits of a cell's number, which hold its table.
_TABLE_BITS = 6


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        at = np.arange(len(odd))
        near[odd, worst] += np.where(off[at, worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def projections(dim: int, tables: int, parts: int, seed: int) -> np.ndarray:
    """(tables, parts, dim, 8): orthonormal columns, scaled to keep lengths on average."""
    rng = np.random.default_rng(seed)
    out = np.zeros((tables, parts, dim, 8))
    for t in range(tables):
        for p in range(parts):
            q, _ = np.linalg.qr(rng.standard_normal((dim, 8)) if dim >= 8 else rng.standard_normal((8, 8)))
            out[t, p] = q[:dim] * np.sqrt(dim / 8) if dim >= 8 else q[:dim]
    return out


def _hash(points: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of half-whole coordinates."""
    h = np.full(len(points), 1469598103934665603, dtype=np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ (np.rint(2 * points[:, k]).astype(np.int64).view(np.uint64))) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, matrices: np.ndarray, scale: float, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes): the own cell of each row, then the cells it probes."""
    tables, parts = matrices.shape[:2]
    if tables > 1 << _TABLE_BITS:
        raise ValueError(f"at most {1 << _TABLE_BITS} tables")
    around = neighbours()
    out = np.zeros((len(unit), tables, 1 + probes), dtype=np.int64)
    rows = np.arange(len(unit))
    for t in range(tables):
        xs = [unit @ matrices[t, p] / scale for p in range(parts)]
        points = [decode_e8(x) for x in xs]
        out[:, t, 0] = _hash(np.concatenate(points, axis=1))
        # a neighbouring point is farther by its squared length, 2, less twice its share of the rest
        nearer = np.concatenate([(x - p) @ around.T for x, p in zip(xs, points, strict=True)], axis=1)
        best = np.argpartition(nearer, nearer.shape[1] - probes, axis=1)[:, nearer.shape[1] - probes :] if probes else np.zeros((len(unit), 0), dtype=np.int64)
        for k in range(probes):
            moved = np.stack(points, axis=1)
            moved[rows, best[:, k] // len(around)] += around[best[:, k] % len(around)]
            out[:, t, 1 + k] = _hash(moved.reshape(len(unit), -1))
    return out


def numbered(found: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Cells as numbers that differ by table (their low bits) and by ``space``, inside which alone rows may link."""
    with np.errstate(over="ignore"):
        mixed = (found.view(np.uint64) ^ space.view(np.uint64)[:, None, None]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
    tables = np.arange(found.shape[1], dtype=np.uint64)[None, :, None]
    return ((mixed & ~np.uint64((1 << _TABLE_BITS) - 1)) | tables).view(np.int64)


def counted_here(x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether cell i is the first one in which row i of ``x`` meets row i of ``y`` (rows, tables, 1 + probes).

    Two rows meet in a cell that is the own cell of one and in the list of the other.
    """
    at = (cell & ((1 << _TABLE_BITS) - 1)).astype(np.int64)
    first, rows = np.ones(len(x), dtype=bool), np.arange(len(x))
    for t in range(int(at.max(initial=0))):
        first &= (at <= t) | ~((x[:, t, :1] == y[:, t]).any(axis=1) | (y[:, t, :1] == x[:, t]).any(axis=1))
    own_x, own_y = x[rows, at, 0], y[rows, at, 0]
    none = np.iinfo(np.int64).max
    met_x = np.where((own_x[:, None] == y[rows, at]).any(axis=1), own_x, none)
    met_y = np.where((own_y[:, None] == x[rows, at]).any(axis=1), own_y, none)
    return first & (np.minimum(met_x, met_y) == cell)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, v, ka, kb`` of every row; ``v`` is null where a row links with nothing, equal rows share ``ka, kb``."""
    of = vectors.schema[vector_col].dataType
    v_type = "float" if isinstance(of, ArrayType) and isinstance(of.elementType, FloatType) else "double"
    v = F.col(vector_col).cast(f"array<{v_type}>")
    usable = (
        v.isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    one_zero = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast(v_type)).otherwise(x))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(F.coalesce(usable, F.lit(False)), one_zero).alias("v")
    )
    return rows.withColumns({"ka": F.xxhash64(F.lit(0), "label", "v"), "kb": F.xxhash64(F.lit(1), "label", "v")})


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups from batches sorted by ``keys``."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        last = int(_runs([np.asarray(held.column(k)) for k in keys])[-1])
        if last:
            yield held.slice(0, last).combine_chunks()
        held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric relation; each row is looked at once."""
    unseen, out = np.ones(len(close), dtype=bool), []
    for start in range(len(close)):
        if not unseen[start]:
            continue
        unseen[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(close[x] & unseen)
            unseen[new] = False
            found = new.tolist()
            out += [(x, y) for y in found]
            todo += found
    return out


def _verified(threshold: float, width: int, small: int):
    """Batches of ``a, b, links`` out of batches sorted by cell and chunks: links (``links`` null), and how many each node has (``b`` null).

    Pairs of one chunk are looked at once, and pairs of two chunks across them.
    """

    def pairs_of(unit, lists, own, weight, chunk, cell, mixed, i, j, found):
        """Verified pairs among (i, j) that are first met here; adds to ``found``."""
        for k in range(0, len(i), 200_000):
            x, y = i[k : k + 200_000], j[k : k + 200_000]
            use = (own[x] | own[y]) & (~mixed[x] | (chunk[x] != chunk[y]))
            x, y = x[use], y[use]
            use = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[use], y[use]
            new = counted_here(lists[x], lists[y], cell[x])
            x, y = x[new], y[new]
            found += np.bincount(x, weight[y], len(found)).astype(np.int64) + np.bincount(y, weight[x], len(found)).astype(np.int64)
            yield x, y

    def large(unit, lists, own, weight, chunk, cell, mixed, found):
        """A spanning forest of the links of one cell's rows; adds the pairs that are first met here to ``found``."""
        n = len(unit)
        close = np.zeros((n, n), dtype=bool)
        for a in range(0, n, 256):
            block = unit[a : a + 256] @ unit.T >= threshold
            block &= own[a : a + 256, None] | own[None, :]
            close[a : a + 256] = block
            here = block & (np.arange(n)[None, :] > np.arange(a, a + len(block))[:, None])
            if mixed:
                here &= chunk[a : a + 256, None] != chunk[None, :]
            x, y = np.nonzero(here)
            for k in range(0, len(x), 200_000):
                i, j = x[k : k + 200_000] + a, y[k : k + 200_000]
                new = counted_here(lists[i], lists[j], cell[i])
                found += np.bincount(i[new], weight[j[new]], n).astype(np.int64) + np.bincount(j[new], weight[i[new]], n).astype(np.int64)
        return np.array(_forest(close | close.T), dtype=np.int64).reshape(-1, 2).T

    def block(table):
        cell, ca, cb, chunk, ids, weight = (table.column(c).to_numpy() for c in ("cell", "ca", "cb", "chunk", "node", "n"))
        unit = _unit(_matrix(table.column("v").combine_chunks()))
        lists = table.column("cells").combine_chunks().flatten().to_numpy().reshape(len(ids), -1, width)
        own, mixed = (lists[:, :, 0] == cell[:, None]).any(axis=1), ca != cb
        starts = _runs([cell, ca, cb])
        sizes = np.diff(np.append(starts, len(ids)))
        found, links = np.zeros(len(ids), dtype=np.int64), []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():  # all small groups of one size together
            first, (one, two) = starts[sizes == size][:, None], np.triu_indices(size, 1)
            links += pairs_of(unit, lists, own, weight, chunk, cell, mixed, (first + one).ravel(), (first + two).ravel(), found)
        for at, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            part = slice(at, at + size)
            x, y = large(unit[part], lists[part], own[part], weight[part], chunk[part], cell[part], mixed[at], found[part])
            links.append((x + at, y + at))
        some = np.flatnonzero(found)
        for x, y in links:
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.nulls(len(x), pa.int64())], names=["a", "b", "links"])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(found[some])], names=["a", "b", "links"])

    def run(batches):
        for table in _whole_groups(batches, ["cell", "ca", "cb"]):
            dims = pc.list_value_length(table.column("v")).to_numpy()
            for dim in np.unique(dims).tolist():
                yield from block(table.filter(pa.array(dims == dim)).combine_chunks())

    return run


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    parts: int = PARTS,
    chunk: int = CHUNK,
    small: int = SMALL,
    seed: int = 42,
) -> DataFrame:
    """``id, n_links, component_id`` for every row.

    Two rows link when their labels are equal and not null and their cosine, in
    double precision, is at least ``threshold``; a vector that is null, empty,
    zero, or has a null or non-finite component links with nothing, not even a
    copy of itself.  Vectors of different length do not link.  ``n_links`` counts
    the other rows that it was found to link with directly; rows that repeat an id are rows of their own.  ``component_id`` is
    the smallest id reachable; null ids pass links on, and name a component only
    where it has no other id (then null).
    """
    rows = classes(vectors, id_col, vector_col, label_col)
    usable = rows.where("v is not null")
    # Identical vectors are one node; the key holds the vector itself, so equal hashes alone never join two.
    nodes = usable.groupBy("ka", "kb", "label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    keyed = nodes.select(F.monotonically_increasing_id().alias("node"), "ka", "kb", "n", "least", "v", F.xxhash64("label", F.size("v")).alias("space"))

    def deal(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = pc.list_value_length(table.column("v")).to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim)).combine_chunks()
                if dim not in made:
                    made[dim] = projections(dim, tables, parts, seed)
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096).combine_chunks()
                    found = cells(_unit(_matrix(some.column("v").combine_chunks())), made[dim], scale, probes)
                    flat = numbered(found, some.column("space").to_numpy()).reshape(-1)
                    ends = np.arange(0, len(flat) + 1, tables * (1 + probes), dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                    yield from some.drop_columns(["space"]).append_column("cells", lists).to_batches()

    placed = keyed.mapInArrow(deal, StructType([f for f in keyed.schema if f.name != "space"]).add("cells", ArrayType(LongType())))
    placed = materialise(placed, "cells")
    width = 1 + probes
    # a node that probes its way into a cell twice is there once; a cell without an owner has nothing to meet
    own = F.filter("cells", lambda _, i: i % width == 0)
    flagged = lambda found, mark: F.transform(found, lambda c: F.struct(c.alias("cell"), F.lit(mark).alias("own")))
    every = F.concat(flagged(F.array_distinct(own), True), flagged(F.array_except("cells", own), False))
    each = placed.select("node", F.inline(every))
    alive = each.groupBy("cell").agg(F.count("*").alias("group_rows"), F.max("own").alias("owned")).where("group_rows > 1 and owned")
    alive = materialise(alive.select("cell", F.ceil(F.col("group_rows") / chunk).cast("int").alias("pieces")), "met-cells")
    dealt = each.select("node", "cell").join(alive, "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("cell", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"), "chunk", "node")
    met = dealt.join(placed.select("node", "n", "v", "cells"), "node")
    key = ["cell", "ca", "cb"]
    found = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verified(threshold, width, small), "a long, b long, links long")
    found = materialise(found, "links")
    comp = materialise(components(found.where("links is null").select("a", "b")), "embedding-components")
    linked = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = placed.select("node", "ka", "kb", "n", "least").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.join(linked, "node", "left").join(least, "root")
    by_node = materialise(by_node.select("ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "embedding-nodes")
    matched = usable.select("id", "ka", "kb").join(by_node, ["ka", "kb"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return matched.unionByName(alone)
