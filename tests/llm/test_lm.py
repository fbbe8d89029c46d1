"""Operator 10: the base against brute force, the model's gradients and causality."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import attention, lm
from readloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def base(rows):
    tokens = [(i, WORD.findall((t or "").translate(UPPER)) + [None]) for i, t in rows]
    drawn = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in tokens]
    count = Counter(x for (_, w), d in zip(tokens, drawn) if not d for x in w)
    n, v = sum(count.values()), len(count)
    return [(i, d, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for (i, w), d in zip(tokens, drawn)]


def agrees(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert tuple(g)[:5] == w[:5] and abs(g.base_score - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert math.isfinite(g.score) and g.score < 0


def test_scores_of_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op10_lm_score"](spark, sf).collect()
    agrees(got, base(docs))


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


@pytest.mark.parametrize("bound", [8_000_000, 10])
def test_scores_of_odd_rows(spark, vocabulary, bound):
    rows = [(1, "The cat, the dog"), (2, None), (3, ""), (4, " \n"), (5, "x" * 3000 + " é 語 " + "the " * 2000), (5, "the cat"), (5, "the cat"), (None, "no id"), (7, "cat DOG cat"), (8, "a\x1cb \x00")]
    rows += [(100 + i, f"word{i % 7} cat {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "'h' as held_out")
    agrees(lm.score(df, *vocabulary, bound=bound, part=1, rounds=1).collect(), base(rows))


def test_score_uses_every_count_at_every_bound(spark, vocabulary):
    rows = [(i, " ".join(f"w{k}" for k in range(40) if i % (k + 1) == 0) + f" only{i} the the") for i in range(200)] + [(7, "repeated w1"), (7, "repeated w1"), (None, "w3 w4")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole, cut = (sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.score(df, *vocabulary, bound=bound, part=1, rounds=1).collect()) for bound in (8_000_000, 10))
    assert len(whole) == len(cut) == len(rows)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and abs(a[3] - b[3]) < 1e-4 for a, b in zip(whole, cut))


def test_no_training_documents(spark, vocabulary):
    drawn = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(drawn, "some words")], "doc_id bigint, text string")
    row = lm.score(df, *vocabulary).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)
    assert lm.score(df.where("false"), *vocabulary).count() == 0


def small_model(symbols=60, size=500, dtype=np.float32):
    v = attention.Vocabulary({7 * i: 1000 - 9 * i for i in range(symbols)}, 50, size)
    rng = np.random.default_rng(0)
    weights = {k: (x + rng.normal(0, 0.2, x.shape)).astype(dtype) for k, x in attention.start(v).items()}
    model = attention.Model(v, weights)
    model.project()
    return v, model


def test_gradients(monkeypatch):
    v, model = small_model(dtype=np.float64)
    rng = np.random.default_rng(1)
    rows, target = attention.windows(rng.integers(0, v.symbols, 70).astype(np.int32), np.array([37, 0, 33]), v)
    keep = rng.random(target.shape) < 0.9

    def loss():
        model.project()
        total, g = model.gradients(rows, np.where(keep, target, -1))
        return total / ((target >= 0) & keep).sum(), g

    _, g = loss()
    for k, x in model.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in x.shape)
            if k in ("E", "P"):
                at = (int(rows[1, attention.HALF + 1]), at[1])
            x[at] += 1e-2
            up = loss()[0]
            x[at] -= 2e-2
            down = loss()[0]
            x[at] += 1e-2
            assert abs(g[k][at] - (up - down) / 2e-2) < 2e-4 + 2e-2 * abs(g[k][at]), k


def plain_log_p(v, w, symbols):
    """Each symbol's probability after those before it, place by place."""
    out, seq, half = [], [v.end, *symbols], attention.HALF
    for i, t in enumerate(symbols):
        first = max(0, (i // half - 1) * half)
        seen = seq[first : i + 1]
        h = w["E"][seq[i]] + w["P"][seq[i - 1] if i else v.pad]
        parts = []
        for k in range(attention.HEADS):
            cut = slice(k * attention.HEAD, (k + 1) * attention.HEAD)
            q = (w["E"][seq[i]] @ w["Q"])[cut] / math.sqrt(attention.HEAD)
            s = np.array([q @ (w["E"][x] @ w["K"])[cut] + w["D"][k, len(seen) - 1 - j] for j, x in enumerate(seen)])
            a = np.exp(s - s.max())
            parts.append((a / a.sum()) @ np.array([(w["E"][x] @ w["V"])[cut] for x in seen]))
        h = h + np.concatenate(parts) @ w["O"]
        c = int(v.class_of[t])
        a, b = v.bounds[c], v.bounds[c + 1]
        top, inner = h @ w["C"] + w["c"], w["W"][a:b] @ h + w["w"][a:b]
        p = np.log(np.exp(top - top.max()) / np.exp(top - top.max()).sum())[c] + np.log(np.exp(inner - inner.max()) / np.exp(inner - inner.max()).sum())[t - a]
        out.append(p + (v.log_other if t == v.other else 0))
    return out


def test_model_equals_a_plain_one_and_scores_each_id_once():
    v, model = small_model()
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, v.symbols, n).astype(np.int32) for n in (1, 15, 16, 17, 70, 33)]
    got = model.log_probability(np.concatenate(texts), np.array([len(x) for x in texts]))
    assert np.allclose(got, np.concatenate([plain_log_p(v, model.w, x.tolist()) for x in texts]), atol=2e-4)
    # All symbols together have probability 1 after any context.
    start = texts[4][:40]
    total = sum(math.exp(model.log_probability(np.append(start, np.int32(s)), np.array([41]))[-1] - (v.log_other if s == v.other else 0)) for s in range(v.symbols))
    assert abs(total - 1) < 1e-3


def test_every_id_sees_the_17_ids_before_it():
    v, model = small_model()
    symbols = np.random.default_rng(2).integers(0, 50, 100).astype(np.int32)
    whole = model.log_probability(symbols, np.array([100]))
    for place in range(40, 60):
        other = symbols.copy()
        other[place - 17] = (other[place - 17] + 1) % 50
        assert model.log_probability(other, np.array([100]))[place] != whole[place]


def test_score_does_not_depend_on_partitions(spark, vocabulary):
    rows = [(i, f"some words {i % 7} and then more of them number {i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = (sorted((r.doc_id, r.score) for r in lm.score(df.repartition(n), *vocabulary, part=1, rounds=2, group_tokens=500).collect()) for n in (1, 7))
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-4 for x, y in zip(a, b))


def test_mean_of_many_groups(spark):
    rows = [(g, c, float(g + 1), np.array([g * 1.0, c]).astype("<f8").tobytes()) for g in range(130) for c in (0, 1)]
    got = lm._mean_of(spark.createDataFrame([(g, c, n, (np.frombuffer(x) * n).tobytes()) for g, c, n, x in rows], "g bigint, chunk int, n double, x binary"), 130)
    want = sum(g * (g + 1) for g in range(130)) / sum(g + 1 for g in range(130))
    assert all(np.allclose(got[c], [want, c]) for c in (0, 1))


def test_model_alone_beats_the_base_on_held_out_texts():
    """On documents of sf0.1 that training has not seen, by log10 probability per token."""
    import public_tokenizers as tokenizers
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    ids, texts = table["doc_id"].to_pylist(), table["text"].combine_chunks()
    crc = np.array([zlib.crc32(str(i).encode()) for i in ids])
    held, part = np.flatnonzero(crc % 10 == 0)[:200], np.flatnonzero((crc % 10 != 0) & (crc // 10 % 16 == 0))
    speller = lm.Speller(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    size = speller.own.vocabulary.size
    # Counts are of all training documents, weights of one part of them, as in the operator.
    every = lm.split_words(texts.filter(pa.array(crc % 10 != 0)))
    counts = Counter(dict(zip(every[0].to_pylist(), np.bincount(every[1]).tolist())))
    n_train = len(every[2])
    n, kinds = counts.total() + n_train, len(counts) + 1
    all_ids, _ = speller.sequences(every, size)
    used = np.bincount(all_ids, minlength=size + 1)
    v = attention.Vocabulary({int(i): int(used[i]) for i in np.flatnonzero(used[:size])}, n_train, size)
    model = attention.Model(v, attention.start(v))
    ids_, text_ids = speller.sequences(lm.split_words(texts.take(pa.array(part))), size)
    attention.train(model, *attention.windows(v.of_id[ids_], text_ids, v), 0.02, 0)
    model.project()
    split = lm.split_words(texts.take(pa.array(held)))
    ids_, text_ids = speller.sequences(split, size)
    score = model.log_probability(v.of_id[ids_], text_ids).sum() / math.log(10)
    c = np.array([counts[w] for w in split[0].to_pylist()])[split[1]]
    base_ = np.log10((c + 0.1) / (n + 0.1 * (kinds + 1))).sum() + len(split[2]) * math.log10((n_train + 0.1) / (n + 0.1 * (kinds + 1)))
    assert score > base_


def test_words_and_ids_of_texts(vocabulary):
    texts = pa.array(["A b\x0bb", None, "", "  lone  "])
    distinct, at, n = lm.split_words(texts)
    assert n.tolist() == [3, 0, 0, 1] and [distinct[i].as_py() for i in at] == ["a", "b", "b", "lone"]
    speller = lm.Speller(*vocabulary)
    ids, text_ids = speller.sequences((distinct, at, n), speller.own.vocabulary.size)
    assert text_ids.sum() == len(ids) and text_ids[1:3].tolist() == [1, 1]
    assert (ids == speller.own.vocabulary.size).sum() == 4


def test_every_training_document_trains_the_weights(spark, vocabulary):
    """The order of one document's words alone is in no count; it moves the scores through the weights only."""
    rows = {i: " ".join(f"word{(7 * i + k**3) % 23}" for k in range(1, 30)) for i in range(60)}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 10 != 0]

    def scores(texts):
        got = lm.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1), *vocabulary).collect()
        return {r.doc_id: r.score for r in got}, {r.doc_id: r.base_score for r in got}

    whole, base_ = scores(rows)
    for i in (train[0], train[len(train) // 2], train[-1]):
        model, same = scores(rows | {i: " ".join(reversed(rows[i].split()))})
        assert all(abs(base_[k] - same[k]) < 1e-9 for k in rows)
        assert max(abs(whole[k] - model[k]) for k in rows if k != i) > 1e-5, i


def test_fewer_rounds_than_parts_raise(spark, vocabulary):
    with pytest.raises(ValueError, match="left out"):
        lm.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), *vocabulary, part=3, rounds=2)


@pytest.mark.parametrize("n", [300, 70_000])
def test_packed_symbols(n):
    v = attention.Vocabulary({i: n - i for i in range(n)}, 1, n)
    symbols, sizes = np.random.default_rng(0).integers(0, v.symbols, 50).astype(np.int32), np.array([20, 0, 1, 29])
    low, high = lm.pack_symbols(symbols, sizes, v)
    got = lm.unpack_symbols(low.slice(1), high.slice(1), v)
    assert got[0].tolist() == symbols[20:].tolist() and got[1].tolist() == [0, 1, 29]


def test_spelt_words_give_the_same_ids(vocabulary):
    split = lm.split_words(pa.array(["the cat, sat", None, "zzyzx the the"]))
    plain = lm.Speller(*vocabulary)
    ids, sizes = lm.packed_ids(pa.array(plain.ids(["the", "cat,"]), pa.binary()))
    place = np.array([{"the": 0, "cat,": 1}.get(w, -1) for w in split[0].to_pylist()])
    end = plain.own.vocabulary.size
    got, want = lm.Speller(*vocabulary, (ids, np.concatenate([[0], np.cumsum(sizes)]))).sequences(split, end, place), plain.sequences(split, end)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_the_word_table_holds_as_many_frequent_words_as_it_may(spark):
    counts = spark.createDataFrame([(c,) for c in [500, 40, 40, 9, 9, 9, 2, 1, 1, 1, 1]], "c bigint")
    n = 614
    # By arithmetic alone a table of 7 words would take those of 614 / 7 tokens or more, one word.
    assert [lm.hot_floor(counts, bound, n) for bound in (1, 2, 3, 5, 6, 7, 10, 11, 614)] == [500, 307, 40, 40, 9, 2, 2, 1, 1]
    for bound in (1, 3, 7, 11):
        assert counts.where(f"c >= {lm.hot_floor(counts, bound, n)}").count() <= bound
    assert lm.hot_floor(counts.where("false"), 5, 0) == 1


def test_a_training_step_projects_its_own_symbols_only(monkeypatch):
    v, model = small_model(symbols=70)
    symbols = np.random.default_rng(3).integers(0, 40, 2000).astype(np.int32)
    rows, target = attention.windows(symbols, np.array([1200, 800]), v)
    other = attention.Model(v, {k: x.copy() for k, x in model.w.items()})
    # The same steps with all symbols at hand.
    best, every = attention.Adam(other.w), np.arange(v.symbols + 1)
    order = np.random.default_rng(5).permutation(len(rows))
    steps = -(-len(rows) // 64)
    for i in range(steps):
        own = order[i * 64 : (i + 1) * 64]
        other.project()
        best.step(other.gradients(rows[own].astype(np.intp), target[own], with_loss=False)[1], 0.02 * min(1.0, (i + 1) / 20) * (1 - 0.9 * i / steps), every)
    seen, project = [], attention.Model.project
    monkeypatch.setattr(attention.Model, "project", lambda self: (seen.append(len(self.w["E"])), project(self))[1])
    before = {k: x.copy() for k, x in model.w.items()}
    assert attention.train(model, rows, target, 0.02, 5) == 2000
    assert len(seen) == steps and max(seen) <= 42
    assert all(np.allclose(model.w[k], x, atol=1e-4) for k, x in other.w.items())
    assert any(np.abs(model.w[k] - before[k]).max() > 1e-3 for k in ("E", "P", "W"))
    # Symbols that no window holds stay as they are.
    assert np.array_equal(model.w["E"][40:70], before["E"][40:70])


def test_sums_of_rows():
    rng = np.random.default_rng(4)
    index = rng.integers(0, 9, 200)
    for dtype in (np.float32, np.float64):
        x, y = rng.normal(size=(200, 6)).astype(dtype), rng.normal(size=(200, 3)).astype(dtype)
        want = np.zeros((11, 9))
        np.add.at(want, index, np.hstack([x, y]))
        assert np.allclose(attention._sum_rows(index, [x, y], 11), want, atol=1e-4)
