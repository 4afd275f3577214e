"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from gridmill.llm import mixing, quality, simhash
from gridmill.llm.store import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        seen.append(name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(before[r.doc_id] == r for r in after)
        ids = {r.doc_id for r in after}
        assert len(ids) == len(after)
        if name == "quality":
            trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            x = [quality.statistics(r.text) for r in before.values()]
            import numpy as np

            assert ids == {k for k, s in zip(before, trees.score(np.array(x)), strict=True) if s >= 0.5}
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            assert len(good & ids) >= 0.95 * len(good & set(before)) and len(bad & ids) <= 0.3 * max(1, len(bad & set(before)))
        if name == "exact_dedup":
            groups = {}
            for r in before.values():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
            assert ids == {min(g, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id for g in groups.values()}
        if name == "simhash":
            prints = {k: simhash.fingerprint(r.text) for k, r in before.items()}
            label = {k: k for k in prints}
            for a in prints:
                for b in prints:
                    if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                        old, new = max(label[a], label[b]), min(label[a], label[b])
                        label = {k: new if v == old else v for k, v in label.items()}
            assert ids == set(label.values())
        if name == "mixing":
            assert ids == set(before)
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            for r in after:
                want = library.encode(before[r.doc_id].text or "")
                assert r.ids == want and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert seen == ["quality", "exact_dedup", "simhash", "mixing", "sentencepiece"]


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_run_returns_the_order_of_the_mixture(spark):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    rows = sorted(pipeline.run(spark, SF).select("doc_id", "mix_position").collect(), key=lambda r: r.mix_position)
    assert len({r.mix_position for r in rows}) == len(rows)
    counts = {}
    for r in rows:
        counts[sources[r.doc_id]] = counts.get(sources[r.doc_id], 0) + 1
    due = {slot: s for slot, s, _ in mixing.schedule({s: -(-n // mixing.BLOCK) for s, n in counts.items()}, mixing.smoothed(counts))}
    assert len(counts) > 1 and all(due[r.mix_position // mixing.BLOCK] == sources[r.doc_id] for r in rows)


def test_encode_returns_the_places_that_the_mixture_gives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    mixed = materialise(pipeline.mix_sources(spark, docs, SF, place=pipeline.PLACE), "test-placed")
    assert mixed.columns == [*docs.columns, pipeline.PLACE]
    # encode takes a row's place as it is given, also one that it would not have found itself
    given = mixed.withColumn(pipeline.PLACE, mixed[pipeline.PLACE] * 2 + 1)
    found = {r.doc_id: r.mix_position for r in pipeline.encode(spark, given, SF).collect()}
    assert found == {r.doc_id: r[pipeline.PLACE] for r in given.collect()} and len(found) == 30


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, number int, __row string, component long, mix_slot int"


def odd_documents(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id", "text").orderBy("doc_id").limit(3).collect()
    texts = [(r.doc_id, r.text) for r in good]
    texts += [texts[0], (texts[0][0], texts[1][1]), (None, texts[2][1]), (None, None), (None, ""), (77, None), (77, ""), (78, texts[0][1] + " \n"), (79, (texts[1][1] + " ") * 200), (-1, "a")]
    return spark.createDataFrame([(i, t, None, None if n % 2 else "s", None, "c", n, "x", 5, 6) for n, (i, t) in enumerate(texts)], ODD)


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    # every stage takes the whole odd table, whatever the one before would have kept
    for name, stage in pipeline.STAGES:
        last = name == pipeline.STAGES[-1][0]
        after = materialise(stage(spark, docs, SF), f"odd-{name}")
        assert last or after.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        before, rows = docs.collect(), after.collect()
        squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        if name == "exact_dedup":
            assert sorted(squeezed(r.text) for r in rows) == sorted({squeezed(r.text) for r in before})
        if name == "simhash":
            assert {simhash.fingerprint(r.text) for r in rows} <= {simhash.fingerprint(r.text) for r in before}
            prints = [simhash.fingerprint(r.text) for r in rows]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
        if name == "mixing":
            assert sorted(map(repr, rows)) == sorted(map(repr, before))
        if last:
            assert len(rows) == len(before) and len({r.mix_position for r in rows}) == len(rows)
