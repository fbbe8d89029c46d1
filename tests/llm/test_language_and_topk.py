"""Operators 3 and 4: held-out accuracy, marginal sums and full scans."""

import math
import zlib

import numpy as np
import pytest

from readloom.llm import langid, topk
from readloom.llm.queries import QUERIES


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(rows[d.doc_id].held_out == (d in held) for d in docs)
    assert all(0 <= r.score <= 1 for r in rows.values())
    right = sum(rows[d.doc_id].lang_pred == d.lang for d in held)
    assert right >= 0.98 * len(held)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    p = rng.random((len(pieces), 2)) / 10
    lattice = langid.Lattice(pieces)

    def total(word, k):
        if not word:
            return 1.0
        out = total(word[1:], k) * langid._FLOOR
        for i, x in enumerate(pieces):
            if word.startswith(x):
                out += p[i, k] * total(word[len(x) :], k)
        return out

    for word in ("▁", "▁abab", "▁axb", "▁bbbb"):
        for scores in (langid.short_scores, langid.long_scores, langid.word_scores):
            got = scores(lattice, p, [word])[0]
            assert np.allclose(got, [math.log(total(word, k)) for k in range(2)])


def test_long_words_are_summed_over_all_segmentations():
    rng = np.random.default_rng(2)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "ab" * 12]
    p = rng.random((len(pieces), 3)) / 3
    lattice = langid.Lattice(pieces)
    words = ["▁" + "".join(rng.choice(list("abx"), n)) for n in (47, 48, 49, 100, 100, 3000)] + ["▁" + "ab" * 200]

    def log_total(word, k):
        alpha, scale = [1.0], 0.0
        for end in range(1, len(word) + 1):
            now = alpha[-1] * langid._FLOOR + sum(alpha[end - len(x)] * p[i, k] for i, x in enumerate(pieces) if word.endswith(x, 0, end) and len(x) <= end)
            alpha.append(now)
            top = max(alpha[-30:])
            alpha, scale = [x / top for x in alpha], scale + math.log(top)
        return math.log(alpha[-1]) + scale

    want = [[log_total(w, k) for k in range(3)] for w in words]
    assert np.allclose(langid.word_scores(lattice, p, words), want)
    assert np.allclose(langid.long_scores(lattice, p, words), want)


def test_language_of_odd_rows(spark):
    import public_tokenizers as tokenizers

    path = tokenizers.path("piece_bpe_32k.model")
    train = [(i, t, x) for i in range(40) for t, x in (("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("???", None))]
    model = langid.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string"), path)
    assert model[1] == ["en", "fr"]
    odd = [(1, None, 1), (2, "", 1), (3, "123 ... !", 1), (4, "the dog", 1), (5, "LE CHIEN " * 50_000, 1), (5, "le chat", 1), (None, "語" * 300, 1)]
    got = langid.predict(spark.createDataFrame(odd, "doc_id bigint, text string, lang int"), model).collect()
    assert [r.lid_lang for r in got[:6]] == ["und", "und", "und", "en", "fr", "fr"]
    assert got[6].lid_lang in ("en", "fr") and all(0 <= r.lid_score <= 1 for r in got)
    unlabelled = spark.createDataFrame([(1, "the dog", None)], "doc_id bigint, text string, lang string")
    nothing = langid.train(unlabelled, path)
    assert [(r.lid_lang, r.lid_score) for r in langid.predict(unlabelled, nothing).collect()] == [("und", 0.0)]
    assert langid.predict(unlabelled.where("false"), model).count() == 0


def full_scan(rows, k):
    vectors = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(1024 * float(x)) for x in v]
        vectors[i] = min(v, vectors.get(i, v))
    out = []
    for q in sorted(i for i in vectors if i % 100 == 0):
        near = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = topk.quantised(df)
    found = topk.search(vectors.where("vec_id % 100 = 0"), vectors, 10, **options)
    return sorted(tuple(r) for r in found.collect())


def test_topk_of_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op4_topk"](spark, sf).collect()) == full_scan(rows, 10)


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_with_ties_and_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(400)]
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, []), (None, [1.0] * 8)]
    rows += [(1000, [0.5, 0.25]), (1100, [0.1, 0.1]), (1, rows[1][1]), (2, [9.0] * 8)]
    assert run(spark, rows, block_cells=800, query_rows=2) == full_scan(rows, 10)
    assert run(spark, rows[:3]) == full_scan(rows[:3], 10)
    assert run(spark, []) == []


def test_topk_keeps_every_finite_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(250)]
    # Sizes over 2^26 and over 2^53, as candidates and as queries; -1e12 by 1e12 fits no long but is no hit.
    for i, x in ((3, 65536.0), (4, -70000.0), (100, 2.5e5), (5, 1e3), (200, 1e12), (6, -1e12)):
        rows[i] = (i, [x] + [0.0] * 7)
    rows[0] = (0, [0.0, 0.5, -0.5, 0.25, 0.5, 0.0, 0.25, 0.5])
    rows[7][1][3], rows[8][1][3] = 1e12, 3e12
    rows[200][1][0], rows[200][1][1] = 0.0, 1e12
    rows[6] = (6, [0.0, -1e12] + [0.0] * 6)
    exact = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert {3, 7, 8} <= {i for _, _, i, _ in want}
    for block_cells in (80, 1 << 20):
        assert run(spark, rows, block_cells=block_cells) == want
    with pytest.raises(Exception, match="fit 64 bits"):
        run(spark, [(100, [1e12, 0.0]), (1, [1e12, 0.0])])
    with pytest.raises(Exception, match="fit 64 bits"):
        run(spark, [(100, [1e12, 0.0]), (1, [-1e12, 0.0])])


def test_scan_stops_early_only_on_proof():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-20, 20, (3000, 16))
    vectors[:12, :3] += 900
    ids = np.arange(3000)
    index = topk.ImpactIndex(ids, vectors)
    for i in (0, 5, 77):
        rows, scores = index.search(vectors[i], i, 10)
        exact = vectors @ vectors[i]
        want = [j for j in np.lexsort((ids, -exact)) if j != i][:10]
        assert rows.tolist() == want and scores.tolist() == exact[want].tolist()
