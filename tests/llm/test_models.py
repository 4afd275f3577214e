"""Quality, toxicity, language-model scores, mixing, chat, WARC and embeddings."""

import base64
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmill.llm import chat, embedding_dedup, lm_scoring, mixing, quality, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, id int, score string, mix_slot int, __row string"
LABELS = "doc_id long, quality int, toxic int, id string"


def held_out(found, labels, column):
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


# -- classifiers ---------------------------------------------------------------


def test_classifiers_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = queries.op3_quality(spark, "/root/testdata/sf0.01").cache()
    assert held_out(good, labels, "quality") > 0.95
    assert good.where("score < 0 or score > 1 or score is null").count() == 0
    assert held_out(queries.op10_toxicity(spark, "/root/testdata/sf0.01"), labels, "toxic") > 0.9


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, x) for x in (labels, turned))
    assert np.array_equal(one.leaf, two.leaf) and np.array_equal(one.threshold, two.threshold)


def odd_documents(spark):
    texts = [None, "", " ", "moron idiot", "#### &&&&", "ok " * 60_000, "ok", "ok", "日本"]
    return spark.createDataFrame([(i, t, None, 1, "s", 2, "r") for i, t in enumerate(texts)] + [(7, "ok", None, 1, "s", 2, "r"), (None, "x", None, 1, "s", 2, "r")], DOCS)


def test_classifiers_on_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(8)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 0, 0, "x")], LABELS)
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        for given_labels in (labels, labels.limit(0)):
            model = module.train(docs, given_labels)
            rows = module.score(docs, model).collect()
            assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
            assert module.score(docs.limit(0), model).count() == 0
            empty = {r.score for r in rows if r.id in (0, 1)}
            assert len(empty) == 1
    assert quality.accepted(docs, quality.train(docs, labels), threshold=0.0).columns == docs.columns


def test_flattened_trees_against_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x, y, rounds=20, depth=3)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.95
    for row, raw in zip(x[:30], trees.raw(x[:30]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert total == pytest.approx(raw)


def test_first_split_against_brute_force():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4))
    y = (x[:, 2] + 0.3 * rng.normal(size=120) > 0.2).astype(float)
    trees = quality.fit(x, y, rounds=1, depth=1, rate=1.0, bins=8)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = max(
        ((g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1), f, cut) for f in range(4) for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) for low in [x[:, f] <= cut]),
        key=lambda b: b[0],
    )
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == best[1:]
    low = x[:, best[1]] <= best[2]
    assert trees.leaf[0].tolist() == pytest.approx([g[s].sum() / (h[s].sum() + 1) for s in (low, ~low)])


def test_kneser_ney_sums_to_one():
    words = ["idiot", "idea", "ideal", "the", "then", "moron"]
    model = toxicity.fit_models(words, np.array([5.0, 0, 0, 3, 1, 4]), np.array([0.0, 4, 2, 9, 3, 0]))
    assert model.shared.sum() == pytest.approx(1)
    d = dict(zip(words, model.differences(words), strict=True))
    assert d["idiot"] > 3 and d["moron"] > 3 and d["ideal"] < 0
    assert model.differences(["zzz"])[0] == pytest.approx(model.differences(["zzz", "q"])[0])
    assert len(model.differences(["a"])) == 1 and len(model.differences([])) == 0


def plain_kneser_ney(counts, others, word):
    """log P(word) under one class, by dictionaries: ``counts`` and ``others`` are {word: times} of this class and of the other."""
    begin, end = "<", ">"
    alphabet = set("".join([*counts, *others]))
    pooled = {w: counts.get(w, 0) + others.get(w, 0) for w in {*counts, *others}}
    known = lambda w: begin + "".join(c if c in alphabet else "?" for c in w) + end

    def grams(table, n):
        raw, kinds = {}, {}
        for w, times in table.items():
            s = known(w)
            for i in range(n - 1, len(s)):
                if times:
                    g = s[i - n + 1 : i + 1]
                    raw[g] = raw.get(g, 0) + times
                    if i >= n:
                        kinds.setdefault(g, set()).add(s[i - n])
        if n == toxicity.ORDER:
            return raw
        return {g: v if g[0] == begin or g not in kinds else len(kinds[g]) for g, v in raw.items()}

    met = {}
    for w in {*counts, *others}:
        s = known(w)
        for a, b in zip(s, s[1:], strict=False):
            met.setdefault(b, set()).add(a)
    shared = {c: len(met.get(c, ())) + 0.5 for c in met}
    total = sum(len(v) for v in met.values()) + 0.5 * 2**toxicity._BITS
    tables = {n: grams(pooled if n <= toxicity.SHARED else counts, n) for n in range(2, toxicity.ORDER + 1)}
    out, s = 0.0, known(word)
    for i in range(1, len(s)):
        p = shared.get(s[i], 0.5) / total
        for n in range(2, min(toxicity.ORDER, i + 1) + 1):
            gram = s[i - n + 1 : i + 1]
            after = {g: v for g, v in tables[n].items() if g[:-1] == gram[:-1]}
            if not after:
                continue
            p = (max(tables[n].get(gram, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * p) / sum(after.values())
        out += np.log(p)
    return out


def test_kneser_ney_against_dictionaries():
    words = ["idiot", "idea", "ideal", "the", "then", "moron", "idiotic", "a", "an"]
    toxic, ordinary = np.array([5.0, 0, 0, 3, 1, 4, 2, 0, 1]), np.array([0.0, 4, 2, 9, 3, 0, 0, 7, 1])
    model = toxicity.fit_models(words, toxic, ordinary)
    sides = [{w: int(n) for w, n in zip(words, x, strict=True) if n} for x in (toxic, ordinary)]
    asked = [*words, "zzz", "idiots", "b", "thenidiot", "x"]
    want = [plain_kneser_ney(sides[0], sides[1], w) - plain_kneser_ney(sides[1], sides[0], w) for w in asked]
    assert model.differences(asked) == pytest.approx(want, abs=1e-9)


def test_trees_of_rows_where_they_lie(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 4)), 2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(int)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) for f in range(4)]
    want = quality.fit(x, y.astype(float), rounds=6, depth=3, bins=16, edges=edges)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "label int, x array<double>")
    for parts in (1, 5):
        got = quality.fit_rows(rows.repartition(parts), 4, rounds=6, depth=3, bins=16, together=10, edges=edges)
        assert np.array_equal(got.feature, want.feature) and np.array_equal(got.threshold, want.threshold) and got.leaf == pytest.approx(want.leaf)
    own = [quality.fit_rows(rows.repartition(parts), 4, rounds=6, depth=3, bins=16, together=10) for parts in (1, 5)]
    assert np.array_equal(own[0].threshold, own[1].threshold) and np.array_equal(own[0].leaf, own[1].leaf)
    right = [((t.score(x) >= 0.5) == y).mean() for t in (own[0], want)]
    assert right[1] > 0.9 and abs(right[0] - right[1]) < 0.02
    for e, f in zip(quality._quantiles(rows, 4, 16), range(4), strict=True):
        assert np.abs(e - np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1], method="inverted_cdf")).max() < 0.003


def test_every_labelled_row_is_learned_from(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    free = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60_000))
    assert free > quality.TOGETHER
    known = quality.labelled(labels, "quality", "doc_id", 3, 1)
    docs = spark.range(70_000).selectExpr("id doc_id", "concat('t', id) text").union(spark.createDataFrame([(2, "a"), (None, "x")], "doc_id long, text string"))
    found = quality.labelled_texts(docs, known, "doc_id", "text")
    assert found.count() == known.count() == free
    assert found.where("text in ('t2', 'a')").select("text").collect() == ([("a",)] if zlib.crc32(b"2") % 3 != 1 else [])


def test_letter_tables_against_those_of_one_place(spark):
    words = ["idiot", "idea", "ideal", "the", "then", "moron", "idiotic", "a", "an", "\u00e9t\u00e9"]
    toxic, ordinary = np.array([5, 0, 0, 3, 1, 4, 2, 0, 1, 1]), np.array([0, 4, 2, 9, 3, 0, 0, 7, 1, 0])
    rows = spark.createDataFrame([(w, int(t), int(b)) for w, t, b in zip(words, toxic, ordinary, strict=True)], "word string, toxic long, ordinary long").repartition(3)
    want, got = toxicity.fit_models(words, toxic.astype(float), ordinary.astype(float)), toxicity.fit_tables(rows)
    asked = [*words, "zzz", "idiots", "b", "thenidiot", "x"]
    assert got.differences(asked) == pytest.approx(want.differences(asked), abs=1e-12)
    # more sequences than slots are counted together: tables keep their size, nothing is left out
    few = toxicity.fit_tables(rows, slots=23)
    for side, own, n in zip(few.sides, (toxic, ordinary), ("toxic", "ordinary"), strict=True):
        assert all(len(g) <= 23 and len(c) <= 23 for g, c in zip(side.grams[3:], side.contexts[3:], strict=True)), n
        assert side.counts[toxicity.ORDER].sum() == sum(max(0, len(w) + 3 - toxicity.ORDER) * k for w, k in zip(words, own, strict=True))
    assert np.isfinite(few.differences(asked)).all()


def test_letter_tables_that_are_not_gathered_give_the_same(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\u05d0\u05d1 unheardof \u4e2d"), (-4, "!?")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    whole = toxicity.train(docs, labels)
    parts = toxicity.train(docs, labels, together=0, gather=0)
    assert isinstance(whole.model, toxicity.Model) and isinstance(parts.model, toxicity.Tables)
    want, got = ({r.id: r.score for r in toxicity.score(docs, c).collect()} for c in (whole, parts))
    assert len(got) == docs.count() and got == pytest.approx(want, abs=1e-12)
    # every sequence is counted for itself, however many there are
    few = spark.createDataFrame([("idiot", 2, 0), ("idea", 0, 3)], "word string, toxic long, ordinary long")
    assert isinstance(toxicity.fit_tables(few, gather=3), toxicity.Tables)
    assert toxicity.fit_tables(few).slots == [0] * (toxicity.ORDER + 1)


# -- language models -----------------------------------------------------------


def test_language_model_scores(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 5, None, 1, "s", 2, "r"), (2, "zqx jkv wpq " * 9, None, 1, "s", 2, "r"), (3, None, None, 1, "s", 2, "r"), (None, "", None, 1, "s", 2, "r")], DOCS)
    models = lm_scoring.fit(docs.where("doc_id = 1").select("text"), docs)
    got = {r.id: r for r in lm_scoring.score(docs, models).collect()}
    assert got[1].difference < 0 < got[2].difference and got[3].n_tokens == 0 and got[None].difference == 0
    empty = lm_scoring.fit(docs.limit(0), docs.limit(0))
    assert lm_scoring.score(docs, empty).count() == 4


def plain_scores(target, corpus, texts, size):
    """Losses by dictionaries of exact grams, every order smoothed by the next lower one."""
    tables, tokens = [], []
    for side in (target, corpus):
        grams, befores = {}, {}
        for text in side:
            s = (None,) * 4 + tuple(text)
            for i in range(4, len(s)):
                for n in range(1, 6):
                    gram = s[i - n + 1 : i + 1]
                    grams[gram] = grams.get(gram, 0) + 1
                    befores[gram[:-1], n] = befores.get((gram[:-1], n), 0) + 1
        tables.append((grams, befores))
        tokens.append(sum(map(len, side)))
    out = []
    for text in texts:
        s, losses = (None,) * 4 + tuple(text), []
        for (grams, befores), scale in zip(tables, (1.0, tokens[0] / tokens[1]), strict=True):
            total = 0.0
            for i in range(4, len(s)):
                p = 1 / size
                for n in range(1, 6):
                    gram = s[i - n + 1 : i + 1]
                    p = (grams.get(gram, 0) * scale + 4 * p) / (befores.get((gram[:-1], n), 0) * scale + 4)
                total -= np.log2(p)
            losses.append(total / len(text))
        out.append(losses)
    return out


def test_language_model_scores_against_exact_grams(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(97, 123, 1500))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, None, 1, "s", 2, "r") for i, t in enumerate(texts)], DOCS).repartition(3)
    want = plain_scores(texts[:4], texts, texts, lm_scoring.SYMBOLS)
    for step, chunk in ((4_000_000, 8_000_000), (1000, 5000)):
        monkeypatch.setattr(lm_scoring, "_STEP", step, raising=False)
        monkeypatch.setattr(lm_scoring, "CHUNK", chunk, raising=False)
        models = lm_scoring.fit(docs.where("doc_id < 4"), docs)
        got = {r.id: (r.loss_target, r.loss_background) for r in lm_scoring.score(docs, models).collect()}
        assert np.allclose([got[i] for i in range(80)], want, rtol=0, atol=1e-4)


def test_language_model_scores_a_chunk_in_parts(monkeypatch):
    """A worker holds the symbols of some texts, not of the whole chunk; sums do not depend on where a part ends."""
    texts = ["abcab" * 300, "", None, "\x00b\u00dfc" * 40, "a", "cabba" * 7] * 4
    symbols, _ = lm_scoring._symbols(texts)
    hi, lo, n = lm_scoring._distinct(symbols)
    bits = (np.arange(len(hi), dtype=np.float32), n.astype(np.float32))
    whole = lm_scoring._scored(pa.chunked_array([texts]), hi, lo, bits)
    monkeypatch.setattr(lm_scoring, "_PART", 100)
    sizes = [len(p[0]) for p in lm_scoring._parts(pa.chunked_array([texts]))]
    assert len(sizes) > 4 and max(sizes) < 100 + 1500 + 5 and sum(sizes) == len(symbols)
    for a, b in zip(whole, lm_scoring._scored(pa.chunked_array([texts]), hi, lo, bits), strict=True):
        assert np.allclose(a, b)


@pytest.mark.parametrize("characters", [300, 6000])
def test_language_model_tells_rare_scripts_apart(spark, characters):
    """Every character is a symbol; beyond 4,095 of them a gram is too wide for one number."""
    rng = np.random.default_rng(7)
    common = ["".join(map(chr, rng.integers(0x20, 0xA0, 400))) * 3 for _ in range(6)]
    rare = ["".join(map(chr, 0x4E00 + rng.permutation(characters))) for _ in range(3)]
    texts = common + rare + ["\x00" * 7 + "\U0010ffff"]
    docs = spark.createDataFrame([(i, t, None, 1, "s", 2, "r") for i, t in enumerate(texts)], DOCS).repartition(3)
    models = lm_scoring.fit(docs.where("doc_id = 6"), docs)
    got = {r.id: (r.loss_target, r.loss_background) for r in lm_scoring.score(docs, models).collect()}
    want = plain_scores([texts[6]], texts, texts, len(set("".join(texts))) + 2)
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=0, atol=1e-4)


# -- mixing --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 40), st.integers(1, 50)), min_size=1))
def test_schedule_stays_within_one_block(spec):
    blocks = {s: n for s, (n, _) in spec.items()}
    weights = {s: float(w) for s, (_, w) in spec.items()}
    rows = list(mixing.schedule(blocks, weights))
    assert [r[0] for r in rows] == list(range(sum(blocks.values())))
    for s in blocks:
        assert [b for _, x, b in rows if x == s] == list(range(blocks[s]))
    left, done, start = dict(blocks), dict.fromkeys(blocks, 0), 0
    for slot, s, _ in rows:
        live = [x for x in left if left[x]]
        total = sum(round(mixing.UNIT * weights[x]) for x in live)
        done[s] += 1
        t = slot + 1 - start
        for x in live:
            assert abs(done[x] - t * Fraction(round(mixing.UNIT * weights[x]), total)) < 1
        left[s] -= 1
        if not left[s]:
            start, done = slot + 1, dict.fromkeys(blocks, 0)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 300), st.integers(0, 5)), min_size=1))
def test_pattern_is_the_schedule(spec):
    blocks = {s: n for s, (n, _) in spec.items()}
    weights = {s: w / 8 for s, (_, w) in spec.items()}
    whole = list(mixing.schedule(blocks, weights))
    spread = [(slot + k * c, s, b + k * a) for s, b, slot, a, c, times in mixing.pattern(blocks, weights) for k in range(times)]
    assert sorted(spread) == whole
    # a source of weight 0 comes after all others
    late = [slot for slot, s, _ in whole if not weights[s]]
    assert not late or min(late) == sum(n for s, n in blocks.items() if weights[s])


def test_pattern_does_not_grow_with_the_table():
    blocks, weights = {"a": 10**9, "b": 10**9, "c": 10**8}, {"a": 0.5, "b": 0.375, "c": 0.125}
    assert sum(1 for _ in mixing.pattern(blocks, weights)) < 100
    with pytest.raises(ValueError):
        list(mixing.schedule({"a": 1}, {"a": -1.0}))


def test_mix_places_every_row_once(spark):
    rows = [(i, "t", None if i % 7 == 0 else f"s{i % 3}" if i % 2 else "s0", 1, "s", 2, "r") for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:5] + [(None, None, None, None, None, None, None)], DOCS)
    got = mixing.mix(docs, {"s0": 0.7, "s1": 0.2}, block=4, ranked_rows=40).collect()
    assert len(got) == 306 and len({r.mix_position for r in got}) == 306
    for s in {r.mix_source for r in got}:
        ranks = sorted(r.mix_rank for r in got if r.mix_source == s)
        assert ranks == list(range(len(ranks)))
    sizes = {s: sum(r.mix_source == s for r in got) for s in {r.mix_source for r in got}}
    due = {(s, b): slot for slot, s, b in mixing.schedule({s: -(-n // 4) for s, n in sizes.items()}, {"s0": 0.7, "s1": 0.2})}
    assert all(r.mix_block == r.mix_rank // 4 and due[r.mix_source, r.mix_block] == r.mix_slot for r in got)
    ordered = mixing.in_order(docs, block=4)
    assert ordered.columns == docs.columns and ordered.count() == 306
    places = {(r.row.doc_id, r.row.source): r.mix_position for r in mixing.mix(docs, block=4).collect()}
    in_files = [places[r.doc_id, r.source] for r in ordered.collect() if (r.doc_id or 9) >= 5]
    assert in_files == sorted(in_files)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.in_order(docs.limit(0)).count() == 0


# -- chat ----------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet=st.sampled_from("\\<|>/[]INST turnend\nsx"), max_size=30)), max_size=5))
def test_turns_come_back(turns):
    pieces = chat.rendered(turns)
    assert "".join(p.text for p in pieces) == chat.render(turns)
    assert [chat.parse(p.text) for p in pieces] == turns
    assert [chat.unescape(p.text[p.content_begin : p.content_end]) for p in pieces] == [t for _, t in turns]
    whole = chat.rendered(turns, chat.Template(chat.render, None))
    assert [p.text for p in whole] == [p.text for p in pieces]
    assert not any(p.rewrites for p in whole)


def test_rewriting_templates_are_found():
    def last_only(turns):
        return "".join(f"[{r}]{'...' if i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns))

    marks = [p.rewrites for p in chat.rendered([("u", "one"), ("a", "two"), ("u", "three")], chat.Template(last_only, None))]
    assert marks == [False, True, True]


def test_prefixes_are_compared_unless_a_bound_is_given():
    def last_only(turns):
        return "".join(f"[{r}]{'...' if i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns))

    marks = [p.rewrites for p in chat.rendered([("u", "one"), ("a", "two"), ("u", "three")], chat.Template(last_only))]
    assert marks == [False, True, True]
    assert chat.HOUSE.context is None


def test_a_bound_is_not_trusted():
    def last_only(turns):
        return "".join(f"[{r}]{'...' if i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns))

    turns = [("u", "one"), ("a", "two"), ("u", "three")]
    for context in (0, 1, 2, None):
        pieces = chat.rendered(turns, chat.Template(last_only, context))
        assert [p.rewrites for p in pieces] == [False, True, True]
    # and one that holds gives what whole prefixes give
    assert chat.rendered(turns, chat.Template(chat.render, 0)) == chat.rendered(turns)


def test_texts_without_a_place_have_no_span(spark):
    twice = chat.Template(lambda turns: "".join(f"({t.upper()}|{len(t)})" for _, t in turns))
    hidden = chat.Template(lambda turns: "*" * len(turns))
    assert [p.placed for p in chat.rendered([("a", "xy")], hidden)] == [False]
    assert [p.text[p.content_begin : p.content_end] for p in chat.rendered([("a", "xy")], twice)] == ["XY"]
    rows = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", "t")], "conv_id long, turn long, role string, text string"), hidden).collect()
    assert [(r.loss_begin, r.loss_end, r.placed) for r in rows] == [(None, None, False)]


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, piece string, begin int"
    rows = [(1, 0, "user", "hi", "p", 0), (1, 1, "assistant", "<|end|>\n", "p", 0), (1, 1, "assistant", "<|end|>\n", "p", 0), (1, None, None, None, "p", 0), (None, 0, "assistant", None, "p", 0), (2, 5, "assistant", "é" * 50_000, "p", 0), (2, 4, "system", "\\", "p", 0)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    by = {k: sorted([r for r in rows if r[0] == k], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for k in (1, 2, None)}
    for k, turns in by.items():
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0


# -- WARC ----------------------------------------------------------------------


def plain_archive(rows, least_bytes=0):
    """(page_id, url, size, digest, type, refers_to) of every record, with one response for each payload."""
    out = []
    for html in {r[2] or "" for r in rows}:
        same = sorted((r for r in rows if (r[2] or "") == html), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        raw = html.encode()
        for n, r in enumerate(same):
            later = n > 0 and len(raw) >= least_bytes
            out.append((r[0], None if r[1] is None else r[1].replace("\r\n", " "), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", same[0][0] if later else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least_bytes", "file_bytes", "words"), [(0, 32_000_000, 1 << 20), (4, 1_000, 1), (0, 1, 2)])
def test_warc_round_trip(spark, least_bytes, file_bytes, words):
    body = "WARC/1.1\r\n\r\n é" + "\r\n\r\n"
    rows = [(5, "u\r\nx", body, "d"), (3, None, body, "d"), (9, "z", None, "d"), (8, "z", "", "d"), (4, "z", "one", "d"), (3, None, body, "d"), (None, "n", "one", "d"), (7, "big", "y" * 300_000, "d"), (4, "z", "one", "d")]
    rows += [(100 + i, f"u{i}", f"page {i % 40}", "d") for i in range(60)] + [(None, None, "two", "d"), (None, "m", "two", "d")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive(frame, least_bytes=least_bytes, file_bytes=file_bytes, words=words).collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain_archive(rows, least_bytes)
    assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(rows)
    named = {r.record_id: r for r in got}
    for r in got:
        if r.record_type == "revisit":
            assert r.payload is None and (named[r.refers_to_record].record_type, named[r.refers_to_record].payload_digest) == ("response", r.payload_digest)
        else:
            assert hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reads_members_and_finds_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    pack = lambda b: (c := zlib.compressobj(wbits=31)).compress(b) + c.flush()
    assert len(list(warc.records(warc._inflate(pack(record) + pack(record))))) == 2
    big = record.replace(b"Length: 2", b"Length: 5000000").replace(b"ab", b"ab" * 2_500_000)
    sizes = [len(block) for _, block in warc.records(warc._inflate(pack(big) + pack(record) + pack(big + record), piece=1000))]
    assert sizes == [5_000_000, 2, 5_000_000, 2]
    for size in (1, 7, 64):
        whole = record * 3
        assert len(list(warc.records(whole[i : i + size] for i in range(0, len(whole), size)))) == 3
    with pytest.raises(ValueError):
        list(warc.records(warc._inflate(pack(big)[:-9])))
    with pytest.raises(ValueError):
        list(warc.records(record[:-1]))
    with pytest.raises(ValueError):
        list(warc.records(record.replace(b"Length: 2", b"Length: 3")))


# -- embeddings ----------------------------------------------------------------


def test_e8_decodes_to_the_nearest_point():
    rng = np.random.default_rng(2)
    around = embedding_dedup.neighbours()
    assert len({tuple(v) for v in around}) == 240 and np.allclose((around**2).sum(axis=1), 2)
    x = rng.normal(scale=3, size=(500, 8))
    points = embedding_dedup.decode_e8(x)
    own = ((x - points) ** 2).sum(axis=1)
    others = ((x[:, None] - points[:, None] - around[None]) ** 2).sum(axis=2).min(axis=1)
    assert (own <= others + 1e-9).all()


def brute(rows, threshold=0.93):
    n = len(rows)
    usable = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    link = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=float) / max(map(abs, rows[k][1])) for k in (i, j))
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    label = list(range(n))
    for i, j in zip(*np.nonzero(link), strict=True):
        if label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    least = {k: min((rows[i][0] for i in range(n) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    return sorted(((rows[i][0], int(link[i].sum()), least[label[i]]) for i in range(n)), key=repr)


@pytest.mark.parametrize(("chunk", "small"), [(7, 16), (2048, 16), (2048, 1), (20, 8)])
def test_embedding_groups_against_brute_force(spark, chunk, small):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 64))
    rows = []
    for i in range(160):
        v = base[i % 25] + (0.0 if i % 10 == 0 else 0.15) * rng.normal(size=64)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    tight = base[0] + 0.05 * rng.normal(size=(60, 64))
    rows += [(1000 + i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(tight)]
    rows += [(500, None, 0), (501, [0.0] * 64, 0), (502, [0.0] * 64, 0), (503, rows[0][1], None), (504, [float("nan")] * 64, 0), (505, [None] + [1.0] * 63, 0), (506, [float("inf")] * 64, 0), (510, [3e200] + [1e200] * 63, 0), (511, [3.1e200] + [1e200] * 63, 0), (512, [3e-200] + [1e-200] * 63, 1), (513, [3.1e-200] + [1e-200] * 63, 1), (507, [], 1), (508, [1.0, 2.0], 1), (509, [2.0, 4.0], 1), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    for kind in ("float", "double"):
        if kind == "float":  # numbers beyond its range are tried as doubles alone
            given_rows = [r for r in rows if not 510 <= (r[0] or 0) <= 513]
        else:
            given_rows = rows
        frame = spark.createDataFrame([(*r, "x", 1) for r in given_rows], f"vec_id long, embedding array<{kind}>, label int, node string, n int").repartition(4)
        got = sorted(((r.id, r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(frame, chunk=chunk, small=small).collect()), key=repr)
        assert got == brute(given_rows), kind
    assert embedding_dedup.embedding_groups(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Share of pairs at the threshold that meet in a cell, before components add more."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=(800, 64))
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    m = embedding_dedup.projections(64, embedding_dedup.TABLES, embedding_dedup.PARTS, 42)
    x, y = (embedding_dedup.cells(v, m, embedding_dedup.SCALE, embedding_dedup.PROBES) for v in (a, b))
    met = (x == y[:, :, :1]).any(axis=2) | (y == x[:, :, :1]).any(axis=2)
    assert met.any(axis=1).mean() > 0.95
