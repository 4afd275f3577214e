"""SentencePiece spans, exact dedup and SimHash against the library and brute force."""

import hashlib
import re

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmill.llm import exact_dedup, sentencepiece_spans, simhash
from gridmill.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A clashing set of column names that callers may have.
EXTRA = ", id string, run int, fp long, __row int, ids int, key int"
LONG = "palabra larga " * 40_000 + "x" * 30_000
TEXTS = [None, "", " ", "\n\t", "a b c", "A  b\nc", "a b", "abc", "a b c d e f", "▁x y", "日本 𝄞 ok", "  two  spaces ", "a b c", LONG, "\x00 odd �"]


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4, 5) for r in rows], SCHEMA + EXTRA)
    return spark.createDataFrame(rows, SCHEMA)


def docs(spark, texts, extra=False):
    return frame(spark, [(i, t, None, None if i % 2 else "s", None) for i, t in enumerate(texts)], extra)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_spans.Encoder(piece_model(), remember=50)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabcthe éß日𝄞.,<>0"), st.characters(codec="utf-8")), max_size=60))
def test_encodes_and_decodes_as_the_library(text, library, encoder):
    ids, begins, ends = encoder.encode(text)
    assert ids.tolist() == library.encode(text)
    assert encoder.model.decode(ids.tolist()) == library.decode(ids.tolist())
    slow = encoder.model.encode_spans(text.encode()) if text else []
    assert [list(x) for x in slow] == np.stack([ids, begins, ends], axis=1).tolist()
    raw = text.encode()
    assert ends.tolist() == sorted(ends.tolist()) and (not len(ids) or ends[-1] == len(raw))
    assert b"".join(raw[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)) == raw


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 31_999), max_size=30))
def test_decodes_any_ids_as_the_library(ids, library, encoder):
    assert encoder.model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_longest_prefix_normalisation_as_the_library(rule, encoder):
    import copy

    other = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = dict(sentencepiece_spans._fields(other.serialized_model_proto()))
    model = copy.copy(encoder.model)
    model.map = sentencepiece_spans.CharacterMap(dict(sentencepiece_spans._fields(spec[3]))[2])
    model.squeeze = model.dummy_prefix = model.escape = True
    for text in ["ﬁne Ⅷ ①", "  a  b  ", "ＡＢＣ　かﾞ", "é ½ ㌔", "", "   ", "x​y\r\nz", "ÀÉ ẞ"]:
        normal, source = other.normalize_with_offsets(text) if hasattr(other, "normalize_with_offsets") else (other.normalize(text), None)
        mine, at = model.normalise(text.encode())
        assert mine.decode() == normal, text
        assert len(at) == len(mine) + 1 and at == sorted(at)


def test_encoding_of_frames(spark, library):
    for extra in (False, True):
        found = {r.id: r for r in sentencepiece_spans.encode(docs(spark, TEXTS, extra), piece_model(), decode=True).collect()}
        for i, t in enumerate(TEXTS):
            assert found[i].ids == library.encode(t or "")
            assert found[i].decoded == library.decode(library.encode(t or ""))
    back = sentencepiece_spans.decode(sentencepiece_spans.encode(docs(spark, TEXTS), piece_model()), piece_model())
    assert {r.id: r.text for r in back.collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert sentencepiece_spans.encode(docs(spark, []), piece_model()).count() == 0


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups_against_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(4, "a b c", None, None, None), (None, "abc", None, None, None), (None, "alone", None, None, None)]
    for extra in (False, True):
        for fan_in in (2, 16):
            d = frame(spark, rows, extra).repartition(5)
            got = sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(d, fan_in=fan_in, slice_rows=7).collect()), key=repr)
            want = []
            for r in rows:
                same = [x for x in rows if squeezed(x[1]) == squeezed(r[1])]
                best = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
                want.append((r[0], best[0], len(same), r[0] == best[0], hashlib.sha256(squeezed(r[1]).encode()).hexdigest()))
            assert got == sorted(want, key=repr)
    kept = exact_dedup.keep_rows(frame(spark, rows, True))
    assert kept.columns == frame(spark, rows, True).columns
    assert sorted(squeezed(r.text) for r in kept.collect()) == sorted({squeezed(r[1]) for r in rows})
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.keep_rows(frame(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [1, 3])
def test_runs_do_not_depend_on_how_files_are_split(spark, partitions):
    # headers are read back in many splits: small row groups and small splits
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "200000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        n = 60_000
        rows = spark.range(0, n, 1, partitions).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % (n // 2)).alias("text"))
        got = exact_dedup.exact_groups(rows, run_rows=7_000)
        total = got.agg(F.count("*"), F.countDistinct("id"), F.min("group_size"), F.max("group_size"), F.count_if("kept"), F.count_if(F.col("keep_id") == F.col("id") % (n // 2))).first()
        assert tuple(total) == (n, n, 2, 2, n // 2, n)
        assert exact_dedup.keep_rows(rows).count() == n // 2
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


REPEATED = [(4, "A"), (4, "B"), (9, "B"), (2, "A"), (4, "A "), (None, "C"), (None, "C"), (None, "D"), (7, "D"), (2, "A"), (5, None), (6, ""), (5, " ")]


def test_rows_are_kept_by_text_where_ids_repeat(spark):
    rows = [(i, t, None, None, n) for n, (i, t) in enumerate(REPEATED)]
    best = {}
    for i, t in REPEATED:
        at = squeezed(t)
        best[at] = min(best.get(at, (0, True, 0, None, None)), (-len(t or ""), i is None, i or 0, i, t), key=lambda x: x[:3])
    exact = sorted(((r.doc_id, r.text) for r in exact_dedup.keep_rows(frame(spark, rows)).collect()), key=repr)
    assert [(i, squeezed(t)) for i, t in exact] == sorted(((v[3], k) for k, v in best.items()), key=repr)
    near = simhash.keep_rows(frame(spark, rows, True)).collect()
    label = components([plain_fingerprint(t) for _, t in REPEATED])
    want = {}
    for k, (i, t) in zip(label, REPEATED, strict=True):
        want[k] = min(want.get(k, (True, 0, 0)), (i is None, i or 0, -len(t or "")))
    assert sorted((r.doc_id is None, r.doc_id or 0, -len(r.text or "")) for r in near) == sorted(want.values())


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉß \n\t\x0b\x1c日"), max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_frames(spark):
    got = {r.id: r.fp for r in simhash.fingerprints(docs(spark, TEXTS, True)).collect()}
    assert {k: v & (2**64 - 1) for k, v in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def components(values, radius=2):
    n, label = len(values), list(range(len(values)))
    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize(("shard_rows", "tree_rows"), [(3, 2), (3, 32_768), (4096, 32_768)])
def test_links_against_brute_force(spark, shard_rows, tree_rows):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    values = set(base) | {0, 2**64 - 1}
    for b in base:
        for _ in range(25):
            flips = rng.choice(64, size=int(rng.integers(1, 4)), replace=False)
            values.add(b ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_rows=shard_rows, tree_rows=tree_rows).collect()
    at = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = values[at[r.a]], values[at[r.b]]
        assert (a ^ b).bit_count() <= 2
        parent[find(at[r.a])] = find(at[r.b])
    want = components(values)
    pairs = {}
    for i in range(len(values)):
        assert pairs.setdefault(want[i], find(i)) == find(i)
    assert len(set(pairs.values())) == len(pairs)


def test_simhash_groups(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(4, "a b c", None, None, None), (None, "A B C", None, None, None), (None, "q r s t u", None, None, None)]
    got = simhash.simhash_groups(frame(spark, rows, True)).collect()
    assert len(got) == len(rows)
    label = components([plain_fingerprint(r[1]) for r in rows])
    least = {k: min((r[0] for r, x in zip(rows, label, strict=True) if x == k and r[0] is not None), default=None) for k in set(label)}
    want = sorted(((r[0], least[k]) for r, k in zip(rows, label, strict=True)), key=repr)
    assert sorted(((r.id, r.component_id) for r in got), key=repr) == want
    kept = simhash.keep_rows(frame(spark, rows, True))
    assert kept.columns == frame(spark, rows, True).columns and kept.count() == len(set(label))
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert simhash.keep_rows(frame(spark, [])).count() == 0
