"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the letters of words, one fitted on toxic
and one on ordinary labelled documents, give every word a log-likelihood under
each class.  Rare and inflected expressions that were never seen whole back off to
their parts: the orders above ``SHARED`` are a class's own, those up to it come
from the continuation counts of both classes together, so what neither class knows
weighs nothing.  A document is compared by length-normalised differences: over the whole
text, and over windows of words, so that a few toxic words in a long text stand
out.  A few boosted trees turn these into a probability; they are fitted on
labelled rows that the language models have not seen.  Every labelled row is
counted or fits the trees.

Up to ``TOGETHER`` distinct words the models are counted in one place, beyond that
by aggregations on shared storage; both give the same.  Every letter sequence is
counted for itself.  Tables of up to ``GATHER`` sequences an order are gathered and
sent to the workers; larger ones stay on shared storage, and documents are scored in
chunks, whose distinct sequences are joined with these tables.  Both give the same.

Words are scored once for each distinct word of a worker, all new words of a
batch together in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm_scoring, quality
from .store import materialise

#: Distinct words up to which the models are counted in one place.
TOGETHER = 100_000
#: Letter sequences of one length up to which the tables are gathered; larger ones stay on shared storage.
GATHER = 1_000_000
ORDER = 6
#: Orders up to this one come from the counts of both classes together.
SHARED = 2
DISCOUNT = 0.75
WINDOWS = (1, 4, 16, 64)
#: Ranks of the highest word differences that are features.
TOPS = (1, 2, 3, 5, 8)
FEATURES = 1 + len(WINDOWS) + len(TOPS)
_WORD = re.compile(r"\w+")
_BEGIN, _END, _OTHER = 1, 2, 3
_BITS = 8
#: Words of the documents whose new words are scored together.
_TOGETHER = 150_000
#: New words that are scored at once.
_WORDS = 20_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class _Side:
    """One class: for each order sorted gram keys with counts, and sorted contexts with (total, kinds)."""

    grams: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    totals: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)


def _find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``sought`` in the sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(sought), dtype=np.int64), np.zeros(len(sought), dtype=bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


@dataclass
class Model:
    alphabet: dict[str, int]
    shared: np.ndarray
    sides: tuple[_Side, _Side]
    #: For each order the number that sequences are divided by, 0 where they are themselves.
    slots: list[int] = field(default_factory=lambda: [0] * (ORDER + 1))

    def pack(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter ids of all words in a row, each word with its begin and end; where words begin."""
        get = self.alphabet.get
        flat = bytearray()
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        for i, w in enumerate(words):
            flat.append(_BEGIN)
            flat += bytes([get(c, _OTHER) for c in w])
            flat.append(_END)
            starts[i + 1] = len(flat)
        return np.frombuffer(bytes(flat), dtype=np.uint8).astype(np.uint64), starts

    def differences(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of every word."""
        if not words:
            return np.zeros(0)
        ids, starts = self.pack(words)
        place = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
        logs = []
        for side in self.sides:
            p = self.shared[ids.astype(np.int64)]
            key = ids.copy()
            for n in range(2, ORDER + 1):
                # the gram of n letters that ends here; words shorter than that keep what they have
                key = key.copy()
                key[n - 1 :] |= ids[: max(0, len(ids) - n + 1)] << np.uint64(_BITS * (n - 1))
                far = place >= n - 1
                where = np.flatnonzero(far)
                gram = key[where]
                context = gram >> np.uint64(_BITS)
                if self.slots[n]:
                    gram, context = gram % np.uint64(self.slots[n]), context % np.uint64(self.slots[n])
                at, there = _find(side.contexts[n], context)
                where, gram, at = where[there], gram[there], at[there]
                total, kinds = side.totals[n][at], side.kinds[n][at]
                at, there = _find(side.grams[n], gram)
                seen = np.where(there, side.counts[n][at], 0) if len(side.grams[n]) else np.zeros(len(gram))
                # above 1 only where sequences are counted together
                p[where] = np.minimum(np.maximum(seen - DISCOUNT, 0) / total + DISCOUNT * kinds / total * p[where], 1)
                # letters at places before n - 1 must not carry a wrong longer key
                key[~far] = 0
            logs.append(np.where(place > 0, np.log(p), 0.0))
        return np.add.reduceat(logs[0] - logs[1], starts[:-1])


def fit_models(words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """Fit both models on distinct words with their counts in either class."""
    model = _empty(_letters(words, toxic + ordinary))
    ids, starts = model.pack(words)
    place = (np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
    # the last level: in how many different contexts a letter is met, in both classes together
    pairs = np.unique((ids[:-1] << np.uint64(_BITS) | ids[1:])[place[1:] > 0]) if len(ids) else np.zeros(0, dtype=np.uint64)
    met = np.bincount((pairs & np.uint64(2**_BITS - 1)).astype(np.int64), minlength=2**_BITS) + 0.5
    model.shared = met / met.sum()
    for n in range(2, ORDER + 1):
        key = np.zeros(len(ids), dtype=np.uint64)
        for back in range(n):
            key[back:] |= ids[: max(0, len(ids) - back)] << np.uint64(_BITS * back)
        both = [_counted_grams(ids, key, place, (toxic + ordinary)[word], n)] * 2 if n <= SHARED else [_counted_grams(ids, key, place, w[word], n) for w in (toxic, ordinary)]
        for side, (grams, counts) in zip(model.sides, both, strict=True):
            _add(side, grams, counts)
    return model


def _letters(words: list[str], each: np.ndarray) -> Counter:
    letters: Counter = Counter()
    for w, n in zip(words, each, strict=True):
        for c in w:
            letters[c] += int(n)
    return letters


def _empty(letters: Counter) -> Model:
    """A model of no order with an alphabet of the most frequent letters."""
    kept = sorted(letters, key=lambda c: (-letters[c], c))[: 2**_BITS - 4]
    return Model({c: i + 4 for i, c in enumerate(kept)}, np.zeros(0), tuple(_Side(*([np.zeros(0)] * 2 for _ in range(5))) for _ in range(2)))


def _add(side: _Side, grams: np.ndarray, counts: np.ndarray, contexts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
    """The next order of a class, whose contexts follow from its grams unless they are given."""
    if contexts is None:
        found, inverse = np.unique(grams >> np.uint64(_BITS), return_inverse=True)
        contexts = found, *(np.bincount(inverse, w, len(found)) if len(found) else np.zeros(0) for w in (counts, None))
    for column, value in zip((side.grams, side.counts, side.contexts, side.totals, side.kinds), (grams, counts, *contexts), strict=True):
        column.append(value)


def _places(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of the last ``ORDER`` letters at each letter, shorter ones where a word begins; places in words, and where words begin."""
    ids, starts = model.pack(words)
    place = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    key = ids.copy()
    for back in range(1, ORDER):
        key[back:] |= np.where(place[back:] >= back, ids[: max(0, len(ids) - back)] << np.uint64(_BITS * back), np.uint64(0))
    return key, place, starts


def _windows(model: Model, words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequences of ``_places`` and their counts in either class."""
    key, place, starts = _places(model, words)
    use, word = place > 0, np.repeat(np.arange(len(words)), np.diff(starts))
    keys, inverse = np.unique(key[use], return_inverse=True)
    return keys, *(np.bincount(inverse, w[word[use]], len(keys)) if len(keys) else np.zeros(0) for w in (toxic, ordinary))


@dataclass
class _Known:
    """What ``Model`` gives for words whose letter sequences are all among sorted ``keys`` with their differences."""

    letters: Model
    keys: np.ndarray
    values: np.ndarray

    def differences(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        key, place, starts = _places(self.letters, words)
        at, there = _find(self.keys, key)
        if not there[place > 0].all():
            raise ValueError("a letter sequence without a difference")
        return np.add.reduceat(np.where(place > 0, self.values[at], 0.0), starts[:-1])


@dataclass
class Tables:
    """Both models on shared storage: an alphabet, the last level, and ``key, t, b`` of every letter sequence by its length."""

    letters: Model
    grams: dict[int, DataFrame]

    def chances(self, asked: DataFrame) -> DataFrame:
        """``key, pt, pb``: the last letter's probability after the others in either class, for each sequence of ``asked`` (``key``, distinct)."""
        levels = {ORDER: asked}
        for n in range(ORDER - 1, 0, -1):
            own = F.col("key").bitwiseAND(F.lit((1 << _BITS * n) - 1)).alias("key")
            levels[n] = materialise(levels[n + 1].select(own).distinct(), f"asked-{n}")
        last = F.get(F.array(*[F.lit(float(v)) for v in self.letters.shared]), F.col("key").cast("int"))
        p = levels[1].select("key", last.alias("pt"), last.alias("pb"))
        for n in range(2, ORDER + 1):
            context = F.shiftright("key", _BITS)
            sums = [x for c in "tb" for x in (F.sum(c).cast("double").alias(f"h{c}"), F.count_if(F.col(c) > 0).alias(f"k{c}"))]
            contexts = self.grams[n].groupBy(context.alias("context")).agg(*sums)
            # sequences that are shorter than n are neither grams nor contexts of this order
            level = levels[n].join(p.withColumnRenamed("key", "lower"), F.col("key").bitwiseAND(F.lit((1 << _BITS * (n - 1)) - 1)) == F.col("lower"))
            level = level.join(self.grams[n], "key", "left").join(contexts, context == F.col("context"), "left")
            each = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0)) / F.col(f"h{c}") + F.lit(DISCOUNT) * F.col(f"k{c}") / F.col(f"h{c}") * F.col(f"p{c}")
            p = level.select("key", *[F.when(F.col(f"h{c}") > 0, each(c)).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in "tb"])
        return p

    def features(self, docs: DataFrame, finish, schema: str) -> DataFrame:
        """``finish(ids, features)`` of ``id, text`` rows, chunk by chunk: a chunk meets the chances of its own sequences only."""
        letters = self.letters
        chunks = materialise(lm_scoring._chunked(docs), "toxicity-chunks")

        def asked(batches):
            for batch in batches:
                chunk = batch.column(0).to_numpy()
                for c in np.unique(chunk):
                    words = set().union(*[words_of(t.as_py()) for t in batch.column(1).filter(pa.array(chunk == c))])
                    key, place, _ = _places(letters, list(words))
                    key = np.unique(key[place > 0]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, dtype=np.int64)), pa.array(key)], names=["chunk", "key"])

        met = materialise(chunks.select("chunk", "text").mapInArrow(asked, "chunk long, key long").distinct(), "toxicity-asked")
        found = met.join(self.chances(materialise(met.select("key").distinct(), f"asked-{ORDER}")), "key").select("chunk", "key", "pt", "pb")

        def run(rows: pa.Table, known: pa.Table) -> pa.Table:
            keys, pt, pb = (known.column(c).to_numpy() for c in ("key", "pt", "pb"))
            # logarithms as Model takes them, to the last bit
            keys, values = keys.astype(np.uint64), np.log(pt) - np.log(pb)
            order = np.argsort(keys)
            scorer = Scorer(_Known(letters, keys[order], values[order]))
            return finish(rows.column("id"), scorer.features(rows.column("text").to_pylist()))

        return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def fit_tables(words: DataFrame, slots: int | None = None, gather: int = GATHER) -> Model | Tables:
    """``fit_models`` of ``word, toxic, ordinary`` by aggregations; where an order has more than ``gather`` sequences the tables are not gathered.

    A caller that gives ``slots`` gets a model of that size instead, in which
    sequences with equal remainders are counted together; ``train`` does not.
    """

    def letters(batches):
        for batch in batches:
            found = _letters(batch.column(0).to_pylist(), batch.column(1).to_numpy() + batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["letter", "n"])

    met = words.mapInArrow(letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).toPandas()
    model = _empty(Counter(dict(zip(met["letter"], met["n"], strict=True))))

    def windows(batches):
        for batch in batches:
            keys, t, b = _windows(model, batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(t.astype(np.int64)), pa.array(b.astype(np.int64))], names=["key", "t", "b"])

    every = words.mapInArrow(windows, "key long, t long, b long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    levels = {ORDER: materialise(every, f"letters-{ORDER}")}
    for n in range(ORDER - 1, 1, -1):
        own = F.col("key").bitwiseAND(F.lit((1 << _BITS * n) - 1)).alias("key")
        counts = [F.sum(c).alias(c) for c in "tb"] + [F.count_if(F.col(c) > 0).alias(f"k{c}") for c in "tb"] + [F.count("*").alias("k")]
        levels[n] = materialise(levels[n + 1].groupBy(own).agg(*counts), f"letters-{n}")
    last = levels[2].where(F.col("key") >= 1 << _BITS).groupBy(F.col("key").bitwiseAND(F.lit(2**_BITS - 1)).alias("id")).agg(F.count("*").alias("n")).toPandas()
    shared = np.full(2**_BITS, 0.5)
    shared[last["id"].to_numpy(dtype=np.int64)] += last["n"].to_numpy()
    model.shared = shared / shared.sum()
    tables: dict[int, DataFrame] = {}
    for n in range(2, ORDER + 1):
        level = levels[n].where(F.col("key") >= 1 << _BITS * (n - 1))
        # orders below the highest count the different letters before a gram, but for grams that begin a word
        raw = F.shiftright("key", _BITS * (n - 1)) == _BEGIN if n < ORDER else F.lit(True)
        kinds = {c: F.col(f"k{c}") if n < ORDER else F.col(c) for c in "tb"}
        counts = {c: F.when(raw, F.col(c)).otherwise(kinds[c]) for c in "tb"}
        if n <= SHARED:
            both = F.when(raw, F.col("t") + F.col("b")).otherwise(F.col("k"))
            counts = {"t": both, "b": both}
        tables[n] = level.select("key", *[c.alias(name) for name, c in counts.items()])
    rows = {n: found.count() for n, found in tables.items()}
    if slots is None and max(rows.values()) > gather:
        return Tables(model, tables)
    for n, found in tables.items():
        model.slots[n] = slots if slots is not None and rows[n] > slots else 0
        sums = [F.sum(c).alias(c) for c in "tb"]
        if model.slots[n]:
            slot = lambda key: F.pmod(key, F.lit(slots).cast("long"))  # noqa: E731, B023
            context = slot(F.shiftright("key", _BITS)).alias("key")
            contexts = found.groupBy(context).agg(*sums, *[F.count_if(F.col(c) > 0).alias(f"k{c}") for c in "tb"]).toPandas().sort_values("key")
            found = found.groupBy(slot(F.col("key")).alias("key")).agg(*sums)
        grams = found.toPandas().sort_values("key")
        for side, c in zip(model.sides, "tb", strict=True):
            own, given = grams[grams[c] > 0], None
            if model.slots[n]:
                some = contexts[contexts[f"k{c}"] > 0]
                given = some["key"].to_numpy(dtype=np.uint64), some[c].to_numpy(dtype=float), some[f"k{c}"].to_numpy(dtype=float)
            _add(side, own["key"].to_numpy(dtype=np.uint64), own[c].to_numpy(dtype=float), given)
    return model


def _counted_grams(ids: np.ndarray, key: np.ndarray, place: np.ndarray, each: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of ``n`` letters and their Kneser-Ney counts, where the letter at each place counts ``each`` times.

    Orders below the highest count the different letters before a gram, but for
    grams that begin a word.
    """
    use = (place >= n - 1) & (each > 0)
    grams, inverse = np.unique(key[use], return_inverse=True)
    counts = np.bincount(inverse, each[use], len(grams)) if len(grams) else np.zeros(0)
    if n < ORDER:
        longer = (place >= n) & (each > 0)
        wide = np.unique(key[longer] | (ids[np.flatnonzero(longer) - n] << np.uint64(_BITS * n)))
        own, kinds = np.unique(wide & np.uint64(2 ** (_BITS * n) - 1), return_counts=True)
        at, there = _find(own, grams)
        begins = grams >> np.uint64(_BITS * (n - 1)) == _BEGIN
        counts = np.where(begins | ~there, counts, kinds[at] if len(kinds) else 0)
    return grams, counts


class Scorer:
    """Document features from one model, remembering at most ``remember`` words."""

    def __init__(self, model: Model | _Known, remember: int = 300_000) -> None:
        self.model, self.remember, self.known = model, remember, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        out: list[list[float]] = []
        part: list[list[str]] = []
        held = 0
        for text in texts:
            part.append(words_of(text))
            held += len(part[-1])
            if held >= _TOGETHER:
                out += self._features(part)
                part, held = [], 0
        out += self._features(part)
        return np.array(out, dtype=float).reshape(-1, FEATURES)

    def _features(self, documents: list[list[str]]) -> list[list[float]]:
        """Features of some documents, whose new words are scored in one go."""
        known = self.known
        distinct = set().union(*documents)
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > self.remember:
            known.clear()
            new = list(distinct)
        for a in range(0, len(new), _WORDS):
            some = new[a : a + _WORDS]
            known.update(zip(some, self.model.differences(some).tolist(), strict=True))
        out = []
        for words in documents:
            v = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
            size = np.fromiter(map(len, words), dtype=float, count=len(words)) + 1
            out.append(document_features(v, size))
        return out


def document_features(v: np.ndarray, size: np.ndarray) -> list[float]:
    """Length-normalised differences: of the whole text, of the highest window of each width, and the highest words."""
    if not len(v):
        return [0.0] * (FEATURES)
    sums, sizes = np.concatenate(([0.0], v.cumsum())), np.concatenate(([0.0], size.cumsum()))
    found = [sums[-1] / sizes[-1]]
    for w in WINDOWS:
        w = min(w, len(v))
        found.append(float(((sums[w:] - sums[:-w]) / (sizes[w:] - sizes[:-w])).max()))
    most = np.sort(v if len(v) <= TOPS[-1] else np.partition(v, -TOPS[-1])[-TOPS[-1] :])[::-1]
    return [*found, *[float(most[k - 1]) if k <= len(most) else 0.0 for k in TOPS]]


def _counted(texts: DataFrame):
    """Distinct words of ``label, text`` rows with their counts in either class."""

    def run(batches):
        sides = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sides[bool(label)].update(words_of(text.as_py()))
        words = list(sides[0] | sides[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([sides[1][w] for w in words], pa.int64()), pa.array([sides[0][w] for w in words], pa.int64())], names=["word", "toxic", "ordinary"]
        )

    parts = texts.mapInArrow(run, "word string, toxic long, ordinary long")
    return materialise(parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "words")


@dataclass
class Classifier:
    model: Model | Tables
    trees: quality.Trees

    def score(self, texts: list[str | None], scorer: Scorer) -> np.ndarray:
        return self.trees.score(scorer.features(texts))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0, together: int = TOGETHER, gather: int = GATHER) -> Classifier:
    """Fit on every labelled row whose ``crc32(id) % modulus`` is not ``held_out``.

    Of these, a quarter (by another hash) fits the trees and the others the
    language models; an id that is labelled both ways counts as toxic.  Without
    labelled rows the score is a constant.
    """
    known = materialise(quality.labelled(labels, label_col, id_col, modulus, held_out), "labelled")
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4))
    words = _counted(quality.labelled_texts(docs, known.where(fold != 0), id_col, text_col))
    if words.count() <= together:
        found = words.toPandas().sort_values("word")
        model = fit_models(found["word"].tolist(), found["toxic"].to_numpy(dtype=float), found["ordinary"].to_numpy(dtype=float))
        del found
    else:
        model = fit_tables(words, gather=gather)
    texts = quality.labelled_texts(docs, known.where(fold == 0), id_col, text_col)
    if isinstance(model, Tables):
        finish = lambda ids, x: pa.table({"label": ids.cast(pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
        rows = model.features(texts.select(F.col("label").cast("long").alias("id"), "text"), finish, "label int, x array<double>")
        return Classifier(model, quality.fit_rows(rows, FEATURES, rounds=40, depth=3, least=1.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.features(batch.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    rows = texts.mapInArrow(run, "label int, x array<double>")
    return Classifier(model, quality.fit_rows(rows, FEATURES, rounds=40, depth=3, least=1.0))


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row, from its whole text; a null or empty text has no words and scores as such."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if isinstance(classifier.model, Tables):
        trees = classifier.trees
        return classifier.model.features(rows, lambda ids, x: pa.table({"id": ids, "score": trees.score(x)}), "id long, score double")
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        scorer = Scorer(sent.value.model)
        for batch in batches:
            scores = sent.value.score([t.as_py() for t in batch.column(1)], scorer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])

    return rows.mapInArrow(run, "id long, score double")
