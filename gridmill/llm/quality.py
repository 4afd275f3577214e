"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are, a batch at a time.  The trees are
fitted on every labelled row: up to ``TOGETHER`` rows in one place, more where
they lie, a job a level, of which only histograms of fixed size come back.  They
are flattened into arrays of equal-depth trees, and every batch of documents walks
all trees at once in numpy.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: Labelled rows up to which trees are fitted in one place; more stay where they lie.
TOGETHER = 20_000
#: 64-bit words of the filter of labelled ids; a false hit only costs a shuffle.
_WORDS = 1 << 18
#: Gradients are whole multiples of one part in this many, so that their sums are the same in every order.
_UNIT = 2.0**26
#: Bits of a 32-bit number that the search for quantiles does not tell apart.
_BLUR = 13
#: Rows whose log-odds a worker remembers between two jobs.
_REMEMBER = 2_000_000

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "words_per_line", "log_lines", "spaces", "upper", "lower", "digits",
    "symbols", "ends", "other_bytes", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "long_words",
    "short_words", "capital_words", "symbol_words", "alone_symbols", "word_spread",
)

_CLASSES = np.zeros((256, 7))
for _i in range(256):
    _c = chr(_i)
    _k = 0 if _c in " \t\n\r\x0b\x0c" else 6 if _i > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 5 if _c in ".,;:?'\"" else 4
    _CLASSES[_i, _k] = 1
_MARKS = frozenset("#*$%&|!@^~=<>{}[]\\/_+")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode()
    size = max(1, len(raw))
    space, upper, lower, digits, symbols, ends, other = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    marked = capital = alone = 0
    for word, times in counts.items():
        if word[-1] in _MARKS or word[0] in _MARKS:
            marked += times
            if word.isascii() and not word.isalnum() and not any(c.isalnum() for c in word):
                alone += times
        if word.isupper() and len(word) > 1:
            capital += times
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(sizes.mean()), n / max(1, len(lines)), np.log1p(len(lines)), space, upper, lower, digits,
        symbols, ends, other, len(counts) / n, max(counts.values(), default=0) / n, pairs, len(set(lines)) / max(1, len(lines)), float((sizes > 12).mean()),
        float((sizes < 4).mean()), capital / n, marked / n, alone / n, float(sizes.std()),
    ]


@dataclass
class Trees:
    """Complete trees of one depth, node by node in level order: ``(trees, nodes)`` arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of ``x``: all trees are walked together, level by level."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1e-3, edges: list[np.ndarray] | None = None) -> Trees:
    """Boost trees on the logistic loss; splits are sought over histograms of ``bins`` quantiles.

    Without rows of both labels the score is the smoothed share of label 1.
    """
    base = _base(y.sum(), len(y))
    if len(y) == 0 or y.min() == y.max():
        return _constant(base, depth)
    if edges is None:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned, total, walked = _binned(x, edges), np.full(len(y), base), 0

    def histograms(done: list, tree: tuple, level: int) -> np.ndarray:
        nonlocal walked
        for one in done[walked:]:
            total[:] += _gained(binned, one)
        walked = len(done)
        return _histograms(binned, y, total, tree, level, bins)

    return _boost(edges, base, histograms, rounds, depth, rate, l2, least)


def _base(ones: float, rows: int) -> float:
    share = (ones + 1) / (rows + 2)
    return float(np.log(share / (1 - share)))


def _constant(base: float, depth: int) -> Trees:
    inner = 2**depth - 1
    return Trees(np.zeros((1, inner), dtype=np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), base)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """``(features, rows)``: how many edges lie below each value."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)


def _walked(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row has come to after some levels."""
    at, row = np.zeros(binned.shape[1], dtype=np.int64), np.arange(binned.shape[1])
    for _ in range(levels):
        at = 2 * at + 1 + (binned[feature[at], row] > cut[at])
    return at


def _gained(binned: np.ndarray, tree: tuple) -> np.ndarray:
    feature, cut, leaf = tree
    return leaf[_walked(binned, feature, cut, int(np.log2(len(leaf)))) - len(feature)]


def _histograms(binned: np.ndarray, y: np.ndarray, total: np.ndarray, tree: tuple, level: int, bins: int) -> np.ndarray:
    """Gradients and curvatures, ``_UNIT`` times, by feature, node of the level and bin."""
    p = 1 / (1 + np.exp(-total))
    both, nodes = (np.rint((y - p) * _UNIT), np.rint(p * (1 - p) * _UNIT)), 2**level
    at = (_walked(binned, *tree, level) - nodes + 1) * bins
    slots = (at + b for b in binned)
    return np.array([[np.bincount(slot, v, nodes * bins).reshape(nodes, bins) for v in both] for slot in slots]).swapaxes(0, 1)


def _boost(edges: list[np.ndarray], base: float, histograms, rounds: int, depth: int, rate: float, l2: float, least: float) -> Trees:
    """Trees by ``histograms(trees so far, (features, cuts) of the next one, level)``, which are sums over all rows."""
    inner = 2**depth - 1
    done, thresholds = [], []
    for _ in range(rounds):
        # a cut that no bin lies above: all rows go left
        feature, cut, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, 255), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            gl, hl = histograms(done, (feature, cut), level).cumsum(axis=-1) / _UNIT
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            for f, e in enumerate(edges):
                gain[f, :, len(e) :] = 0
            leaf = np.zeros((nodes, 2, 2))
            for node in range(nodes):
                f, k = np.unravel_index(gain[:, node].argmax(), gain[:, node].shape)
                g, h = gt[0, node, 0], ht[0, node, 0]
                leaf[node, 0] = g, h
                if gain[f, node, k] > 1e-9:
                    feature[first + node], cut[first + node], threshold[first + node] = f, k, edges[f][k]
                    leaf[node] = (gl[f, node, k], hl[f, node, k]), (g - gl[f, node, k], h - hl[f, node, k])
        # the last level's halves are the leaves
        done.append((feature, cut, rate * leaf[:, :, 0].ravel() / (leaf[:, :, 1].ravel() + l2)))
        thresholds.append(threshold)
    return Trees(np.stack([f for f, _, _ in done]), np.stack(thresholds), np.stack([v for _, _, v in done]), base)


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _quantiles(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Edges of each feature at ``bins`` quantiles of all rows, to one part in a thousand of a value; the same in whatever order rows come."""

    def run(batches):
        for batch in batches:
            raw = _matrix(batch.column(1)).astype(np.float32).view(np.uint32)
            raw = np.where(raw >> 31 != 0, ~raw, raw | np.uint32(1 << 31)) >> _BLUR
            found = [np.unique(raw[:, f], return_counts=True) for f in range(raw.shape[1])]
            f = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.concatenate([k for k, _ in found]).astype(np.int64)), pa.array(np.concatenate([n for _, n in found]))], names=["f", "key", "n"])

    # features times cells of a 32-bit number at most, whatever the rows are
    met = rows.mapInArrow(run, "f long, key long, n long").groupBy("f", "key").agg(F.sum("n").alias("n")).toPandas().sort_values(["f", "key"])
    edges = []
    for f in range(features):
        own = met[met["f"] == f]
        sums = own["n"].to_numpy().cumsum()
        keys = own["key"].to_numpy()[np.searchsorted(sums, sums[-1] * np.linspace(0, 1, bins + 1)[1:-1])]
        last = ((keys.astype(np.uint32) + np.uint32(1)) << np.uint32(_BLUR)) - np.uint32(1)
        edges.append(np.unique(np.where(last >> 31 != 0, last & np.uint32((1 << 31) - 1), ~last).view(np.float32).astype(float)))
    return edges


#: Log-odds of batches, by their content: how many trees they come from, and the values.
_known: dict[tuple, tuple[int, np.ndarray]] = {}


def _log_odds(key: tuple, binned: np.ndarray, base: float, done: list) -> np.ndarray:
    """Log-odds after all trees of ``done``; a worker that has met the rows before goes on from there."""
    n, total = _known.pop(key, (0, None))
    if total is None or n > len(done):
        n, total = 0, np.full(binned.shape[1], base)
    for tree in done[n:]:
        total = total + _gained(binned, tree)
    _known[key] = len(done), total
    while len(_known) > 1 and sum(len(t) for _, t in _known.values()) > _REMEMBER:
        del _known[next(iter(_known))]
    return total


def fit_rows(rows: DataFrame, features: int, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1e-3, together: int = TOGETHER, edges: list[np.ndarray] | None = None) -> Trees:
    """``fit`` on every row of ``label int, x array<double>``; above ``together`` rows a job a level brings back histograms.

    The rows' order and partitions make no difference.
    """
    rows = materialise(rows, "tree-rows")
    n, ones, least_label, most = rows.agg(F.count("*"), F.sum("label"), F.min("label"), F.max("label")).first()
    if n <= together:
        found = rows.toPandas()
        x = np.array(found["x"].tolist(), dtype=float).reshape(-1, features)
        y = found["label"].to_numpy(dtype=float)
        order = np.lexsort((*x.T, y))
        return fit(x[order], y[order], rounds, depth, rate, bins, l2, least, edges)
    base = _base(ones, n)
    if least_label == most:
        return _constant(base, depth)
    edges = edges or _quantiles(rows, features, bins)

    def pack(batches):
        for batch in batches:
            binned = np.ascontiguousarray(_binned(_matrix(batch.column(1)), edges).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in binned], pa.binary())], names=["label", "bins"])

    packed, name = materialise(rows.mapInArrow(pack, "label int, bins binary"), "tree-bins"), uuid.uuid4().hex

    def histograms(done: list, tree: tuple, level: int) -> np.ndarray:
        def run(batches):
            sums = np.zeros((2, features, 2**level, bins))
            for batch in batches:
                y, raw = batch.column(0).to_numpy(), b"".join(batch.column(1).to_pylist())
                if len(y):
                    binned = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(-1, features).T)
                    key = name, hashlib.blake2b(raw, digest_size=16).digest()
                    sums += _histograms(binned, y, _log_odds(key, binned, base, done), tree, level, bins)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        parts = packed.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r[0]).reshape(2, features, 2**level, bins) for r in parts)

    return _boost(edges, base, histograms, rounds, depth, rate, l2, least)


def labelled(labels: DataFrame, label_col: str, id_col: str, modulus: int, held_out: int) -> DataFrame:
    """``id, label`` of every labelled row that is not held out.

    Rows with a null id or label are left out; an id with several labels has the largest.
    """
    key = F.col(id_col).cast("long")
    free = F.crc32(key.cast("string").cast("binary")) % modulus != held_out
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & free)
    return known.groupBy(key.alias("id")).agg(F.max(label_col).cast("int").alias("label"))


def labelled_texts(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``label, text`` of each row of ``known`` (``id, label``) that has a text; of an id that comes with several texts the smallest.

    A filter of fixed size keeps the texts of most other ids from being shuffled.
    """
    word, bit = F.expr(f"pmod(shiftrightunsigned(xxhash64(id), 6), {_WORDS})").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))")
    bits = known.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    near = texts.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    met = near.select("id", "text").join(known, "id")
    return met.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int = 1, together: int = TOGETHER) -> Trees:
    """Fit on every labelled row whose ``crc32(id) % modulus`` is not ``held_out``."""
    texts = labelled_texts(docs, materialise(labelled(labels, label_col, id_col, modulus, held_out), "labelled"), id_col, text_col)

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    return fit_rows(texts.mapInArrow(run, "label int, x array<double>"), len(FEATURES), together=together)


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row, from its whole text; a null text scores as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def accepted(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose score is at least ``threshold``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
