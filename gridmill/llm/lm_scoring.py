"""Cross-entropy difference scoring.

Two n-gram models of characters, one of a target set and one of the whole corpus,
share one vocabulary (every character that either holds), one order and one
smoothing.  They are matched in size too: the
corpus's counts are scaled to as many tokens as the target has, so that
smoothing weighs the same in both.  A document's score is the mean difference of
its per-token losses (target minus background): the lower, the closer to the
target.

Every count covers every text, and every gram is counted for itself.  The counts
are a table on shared storage, which grows with the corpus and never goes to the
driver.  Documents are scored in chunks: a chunk's distinct grams are joined with
the models' losses, and its documents read theirs from that part of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

ORDER = 5
#: Size of the vocabulary at least.
SYMBOLS = 128
#: Bits of a symbol in a gram's key, which is two whole numbers: the first two symbols, and the last three.
BITS = 21
_LOW = (1 << BITS) - 1
#: Characters of the documents that are counted or scored together, about.
CHUNK = 16_000_000
#: Positions looked at together.
_STEP = 4_000_000
#: Characters of a chunk's documents that are scored together, about, which bounds a worker's memory.
_PART = 1_000_000
#: Grams that a task sums up before it passes them on.
_HELD = 2_000_000
#: Symbol 0 stands before a text.
_START = 0
#: Strength of the lower order in each context, in tokens.
PRIOR = 4.0


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (code points and one) of texts one after the other, each behind start symbols, and the number of symbols of each text."""
    starts = np.full(ORDER - 1, _START, dtype=np.int32)
    parts = [starts[:0]]
    for text in texts:
        parts += [starts, _code_points(text or "").astype(np.int32) + 1]
    return np.concatenate(parts), np.array([len(p) for p in parts[2::2]], dtype=np.int64)


def _steps(symbols: np.ndarray, step: int = 0):
    """Pieces of ``symbols`` with the symbols before them, and the place of the first gram's end."""
    step = step or _STEP
    for at in range(0, len(symbols), step):
        first = max(0, at - ORDER + 1)
        if len(symbols) - first >= ORDER:
            yield symbols[first : at + step], first + ORDER - 1


def _grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both numbers of the key of the gram that ends at each symbol from the fifth on."""
    s, n = symbols.astype(np.int64), len(symbols) - ORDER + 1
    return s[:n] << BITS | s[1 : n + 1], s[2 : n + 2] << 2 * BITS | s[3 : n + 3] << BITS | s[4:]


class _Packing:
    """Grams of few distinct symbols as one number."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.used = np.flatnonzero(np.bincount(symbols, minlength=1))
        self.bits = max(1, (len(self.used) - 1).bit_length())
        self.fits = ORDER * self.bits <= 63
        self.dense = np.zeros(int(self.used[-1]) + 1 if len(self.used) else 1, dtype=np.int64)
        self.dense[self.used] = np.arange(len(self.used))

    def pack(self, columns: list[np.ndarray]) -> np.ndarray:
        key = self.dense[columns[0]]
        for c in columns[1:]:
            key = key << self.bits | self.dense[c]
        return key

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        d, n = self.dense[symbols], len(symbols) - ORDER + 1
        key = d[:n].copy()
        for i in range(1, ORDER):
            key <<= self.bits
            key |= d[i : n + i]
        return key

    def unpack(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d, e = (self.used[key >> self.bits * i & (1 << self.bits) - 1] for i in range(ORDER - 1, -1, -1))
        return a << BITS | b, c << 2 * BITS | d << BITS | e


def _distinct(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of the distinct grams that end at a character."""
    real, packing = symbols[ORDER - 1 :] != _START, _Packing(symbols)
    if packing.fits:
        key, n = np.unique(packing.windows(symbols)[real], return_counts=True)
        return *packing.unpack(key), n
    (his, hi), (los, lo) = (np.unique(k[real], return_inverse=True) for k in _grams(symbols))
    key, n = np.unique(hi * len(los) + lo, return_counts=True)
    return his[key // max(1, len(los))], los[key % max(1, len(los))], n


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Sums of two tables of ``hi, lo, n``."""
    if not len(a[0]):
        return b
    hi, lo, n = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    return hi[first], lo[first], np.add.reduceat(n, first)


def _counted(rows):
    """Record batches of ``chunk, hi, lo, n`` out of batches of ``chunk, text``; a gram may come more than once."""

    def emit(chunk, found):
        hi, lo, n = found
        for at in range(0, len(hi), 100_000):
            some = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi[some]), chunk, dtype=np.int64)), pa.array(hi[some]), pa.array(lo[some]), pa.array(n[some])], names=["chunk", "hi", "lo", "n"])

    def more(found, texts):
        for part, _ in _steps(_symbols(texts)[0]):
            found = _merged(found, _distinct(part))
        return found

    none = (np.zeros(0, dtype=np.int64),) * 3
    found, held, size, at = none, [], 0, None
    for batch in rows:
        for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (chunk != at or size >= _STEP):
                found, held, size = more(found, held), [], 0
            if chunk != at or len(found[0]) > _HELD:
                yield from emit(at, found)
                found = none
            at = chunk
            held.append(text)
            size += len(text or "") + ORDER - 1
    yield from emit(at, more(found, held))


def grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``hi, lo, n``: how often each gram of ``ORDER`` symbols comes, in parts that are yet to be summed."""
    rows = docs.select(F.lit(0).cast("long").alias("chunk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "chunk long, hi long, lo long, n long").drop("chunk")


def _summed(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts of both models by the last ``order`` symbols."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * max(0, order - 3)) - 1))
    lo = F.col("lo").bitwiseAND(F.lit((1 << BITS * min(3, order)) - 1))
    return rows.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


@dataclass
class Models:
    """Counts of both models' grams (``hi, lo, t, b``) and of their tokens, and the size of the vocabulary."""

    grams: DataFrame
    target_tokens: int
    corpus_tokens: int
    size: int


def fit(target: DataFrame, corpus: DataFrame, target_col: str = "text", corpus_col: str = "text") -> Models:
    """Both models over every character of target and corpus (``SYMBOLS`` at least, two of them the start and all others); an empty target or corpus gives a uniform model."""
    none = F.lit(0).cast("long")
    own = grams(target, target_col).select("hi", "lo", F.col("n").alias("t"), none.alias("b"))
    all_of = grams(corpus, corpus_col).select("hi", "lo", none.alias("t"), F.col("n").alias("b"))
    found = materialise(_summed(own.union(all_of)), "lm-grams")
    characters = _summed(found, 1)
    total = characters.agg(F.coalesce(F.sum("t"), none).alias("t"), F.coalesce(F.sum("b"), none).alias("b"), F.count("*").alias("n")).first()
    return Models(found, total["t"], total["b"], max(SYMBOLS, total["n"] + 2))


def _losses(every: DataFrame, models: Models) -> DataFrame:
    """``hi, lo, target, background``: bits of each gram's last symbol, every order smoothed by the next lower one."""
    scales = {"t": 1.0, "b": models.target_tokens / models.corpus_tokens if models.target_tokens and models.corpus_tokens else 1.0}
    totals = {"t": models.target_tokens, "b": models.corpus_tokens}
    levels = {ORDER: every}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = materialise(_summed(levels[n + 1], n), f"lm-order-{n}")
    p = None
    for n in range(1, ORDER + 1):
        level = levels[n]
        if n == 1:
            level = level.withColumns({f"h{m}": F.lit(float(totals[m])) for m in scales} | {f"p{m}": F.lit(1 / models.size) for m in scales})
        else:
            before = level.groupBy(F.col("hi").alias("h"), F.shiftright("lo", BITS).alias("l")).agg(*[F.sum(m).alias(f"h{m}") for m in scales])
            lower = p.select(F.col("hi").alias("k"), F.col("lo").alias("j"), *[f"p{m}" for m in scales])
            suffix = [F.col(c).bitwiseAND(F.lit((1 << BITS * w) - 1)) for c, w in (("hi", max(0, n - 4)), ("lo", min(3, n - 1)))]
            level = level.join(before, (F.col("hi") == F.col("h")) & (F.shiftright("lo", BITS) == F.col("l"))).join(lower, (suffix[0] == F.col("k")) & (suffix[1] == F.col("j")))
        p = level.select("hi", "lo", *[((F.col(m) * s + PRIOR * F.col(f"p{m}")) / (F.col(f"h{m}") * s + PRIOR)).alias(f"p{m}") for m, s in scales.items()])
    bits = [(-F.log2(F.least(F.greatest(F.col(f"p{m}"), F.lit(1e-9)), F.lit(1.0)))).cast("float").alias(name) for m, name in (("t", "target"), ("b", "background"))]
    return p.select("hi", "lo", *bits)


def _chunked(docs: DataFrame) -> DataFrame:
    """``id, text`` with the number of the chunk that a row belongs to; a chunk is no longer than ``CHUNK`` and a text."""

    def run(batches):
        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = size + np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ORDER - 1)
            if len(ends):
                size = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(first + ends // CHUNK), batch.column(0), batch.column(1)], names=["chunk", "id", "text"])

    return docs.mapInArrow(run, "chunk long, id long, text string")


class _Finder:
    """Places of keys in a table of distinct ones: guessed by a hash and compared, else searched for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys)
        self.keys, self.sorted = keys, keys[self.order]
        self.shift = np.uint64(64 - max(1, (4 * len(keys)).bit_length()))
        self.guess = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.guess[self._hash(keys)] = np.arange(len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=np.int32)
        found = self.guess[self._hash(keys)]
        missed = np.flatnonzero(self.keys[found] != keys)
        if len(missed):
            found[missed] = self.order[np.searchsorted(self.sorted, keys[missed])]
            if not np.array_equal(self.keys[found[missed]], keys[missed]):
                raise ValueError("a gram without a loss")
        return found


def _parts(texts: pa.ChunkedArray):
    """Symbols and sizes of some texts after the other, of ``_PART`` characters and a text at most."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "") + ORDER - 1
        if size >= _PART:
            yield _symbols(held)
            held, size = [], 0
    if held:
        yield _symbols(held)


def _scored(texts: pa.ChunkedArray, hi: np.ndarray, lo: np.ndarray, bits: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Tokens of each text and its mean of each of ``bits``, which are given for the grams ``hi, lo``; an empty text has 0."""
    columns = [hi >> BITS, hi & _LOW, lo >> 2 * BITS, lo >> BITS & _LOW, lo & _LOW]
    # every symbol of the texts ends a gram
    packing = _Packing(np.concatenate([[_START], *map(np.unique, columns)]))
    if packing.fits:
        keys = packing.pack(columns)
    else:
        his, los = np.unique(hi), np.unique(lo)
        keys = np.searchsorted(his, hi) * len(los) + np.searchsorted(los, lo)
    del columns
    find, parts = _Finder(keys), []
    for symbols, sizes in _parts(texts):
        begins = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
        sums = [np.zeros(len(sizes)) for _ in bits]
        for part, first in _steps(symbols, _PART):
            real = part[ORDER - 1 :] != _START
            if packing.fits:
                key = packing.windows(part)[real]
            else:
                a, b = (k[real] for k in _grams(part))
                key = np.searchsorted(his, a) * len(los) + np.searchsorted(los, b)
            where = find(key)
            # the texts that this piece holds or goes on with
            some = slice(np.searchsorted(begins, first, "right") - 1, np.searchsorted(begins, first + len(real)))
            at = np.maximum(begins[some] - first, 0)
            for out, b in zip(sums, bits, strict=True):
                values = np.zeros(len(real), dtype=np.float32)
                values[real] = b[where]
                out[some] += np.add.reduceat(values, at, dtype=np.float64)
        parts.append([sizes, *[x / np.maximum(sizes, 1) for x in sums]])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, loss_target, loss_background, difference`` (bits a token) for every row and whole text.

    Rows that repeat are scored as often as they come, each for itself; there is
    nothing to tie.  A null or empty text has no tokens and losses of 0; an empty
    table gives an empty result.  Other columns, whatever their names, are neither
    read nor returned.
    """
    chunks = materialise(_chunked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "lm-chunks")
    met = chunks.select("chunk", "text").mapInArrow(_counted, "chunk long, hi long, lo long, n long")
    asked = materialise(met.drop("n"), "lm-asked")
    none = F.lit(0).cast("long")
    every = materialise(_summed(models.grams.union(asked.select("hi", "lo", none.alias("t"), none.alias("b")))), "lm-every")
    found = asked.join(_losses(every, models), ["hi", "lo"]).select("chunk", "hi", "lo", "target", "background")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        hi, lo, own, other = (known.column(c).to_numpy() for c in ("hi", "lo", "target", "background"))
        if not len(rows):
            n, own, other = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        else:
            n, own, other = _scored(rows.column("text"), hi, lo, (own, other))
        return pa.table({"id": rows.column("id"), "n_tokens": n, "loss_target": own, "loss_background": other, "difference": own - other})

    schema = "id long, n_tokens long, loss_target double, loss_background double, difference double"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)
