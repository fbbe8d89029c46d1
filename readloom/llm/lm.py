"""Language-model scores: a causal self-attention model on subword ids.

A text is its lower-cased words, each written as the public vocabulary's ids of
`` word``, then an end. The model (``attention``) reads the ids in windows that
overlap by half and scores each id once, from the 17 to 32 ids before it. The
score of a text is the sum over its ids; nothing else enters it. The base is the
sum of the words' smoothed shares of the training words.

Everything is learnt from every training document: the counts of words, through
them the counts of ids, their order, classes and first shares, and the weights.
These are learnt by Adam in ``rounds`` rounds. Each takes one of ``part`` parts
of the training documents, dealt by a hash of id and text, so that rows without
an id spread too; ``rounds`` may not be fewer, so no document is left out. In a
round the part's documents are dealt by another such hash into groups of about
``group_tokens`` tokens; a group trains from the round's first weights, in an
order that its rows alone decide, and the weights are averaged. So scores do not depend on how rows lie in files,
partitions or tasks.

Words are counted and looked up by 64-bit hashes. The most frequent words, at
most ``bound`` of them, go to the executors by broadcast, with their ids: those
of a least count that few enough words reach. All others are spelt where they
stand, and joined, distributed, for the base. Texts are spelt once: training and
scoring read the model's symbols from a saved table.

Defined results: a null or wordless text is the end alone; with no training
document N and V are 0, every base probability is 1 and the model has its first
weights; ids that no training text has are one symbol, which shares out its
probability alike; a null id counts as the empty text in the draw; repeated rows
get repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import attention, words
from readloom.llm.arrow import SMALL, by_bytes, map_batches, release, sizes_of, text_bytes, tidy
from readloom.llm.bpe import encoder
from readloom.session import saved, ship

_KEPT_WORDS = 150_000
_CHUNK = 1 << 16
_FAN_IN = 64


def held_out(id_col, n: int = 10):
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n) == 0


def split_words(texts: pa.Array):
    """(distinct words, place of each word among them, words of each text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    n = np.asarray(pc.list_value_length(split), dtype=np.int64)
    # White space at the ends leaves empty strings.
    full = np.asarray(pc.not_equal(flat, ""))
    if not full.all():
        doc = np.repeat(np.arange(len(n)), n)[full]
        n = np.bincount(doc, minlength=len(n))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), n


def word_hashes(distinct: pa.Array) -> np.ndarray:
    data, sizes = text_bytes(distinct)
    return words.mix(words.WordText(data, sizes, words.NOT_BLANK).hash) if len(distinct) else np.zeros(0, dtype=np.uint64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents; tasks sum before they send."""
    ship(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    @tidy
    def run(batches):
        held: list[tuple[pa.Array, np.ndarray]] = []

        def summed():
            coded = pa.chunked_array([w for w, _ in held], pa.string()).combine_chunks().dictionary_encode()
            n = np.bincount(np.asarray(coded.indices), weights=np.concatenate([c for _, c in held]), minlength=len(coded.dictionary))
            return coded.dictionary, n.astype(np.int64)

        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column("text")), 2 * SMALL):
                distinct, at, _ = split_words(batch.column("text").slice(a, b - a))
                held.append((distinct, np.bincount(at, minlength=len(distinct))))
                if sum(len(w) for w, _ in held) > 600_000:
                    held = [summed()]
                    if len(held[0][0]) > 300_000:
                        yield pa.RecordBatch.from_arrays([held[0][0], pa.array(held[0][1])], schema=schema)
                        held = []
        if held:
            words_, n = summed()
            yield pa.RecordBatch.from_arrays([words_, pa.array(n)], schema=schema)

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def hot_floor(counts: DataFrame, bound: int, n: int) -> int:
    """The least count for which at most ``bound`` words, of ``n`` tokens in all, have it or more."""
    # A count for which that holds by arithmetic; only lower ones, which are few, need to be told apart.
    least, total = max(1, math.ceil(n / bound)), 0
    rows = counts.groupBy(F.least("c", F.lit(least)).alias("c")).agg(F.count(F.lit(1)).alias("words")).collect()
    for c, words_ in sorted(((r["c"], r["words"]) for r in rows), reverse=True):
        total += words_
        if total > bound:
            break
        least = c
    return least


def spell_counts(counts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(c, h, ids) of each (word, c): the word's hash and its packed ids."""

    def make():
        speller = Speller(path, pattern)
        return lambda b: [b.column("c"), pa.array(word_hashes(b.column("word")).view(np.int64)), pa.array(speller.ids(b.column("word").to_pylist()), pa.binary())]

    return map_batches(counts, "c bigint, h bigint, ids binary", "word", make)


def count_ids(counts: DataFrame, size: int) -> dict[int, int]:
    """How often each id is used in all training words, of (c, ids)."""
    ship(counts.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    @tidy
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            data, sizes = packed_ids(batch.column("ids"))
            np.add.at(total, data, np.repeat(np.asarray(batch.column("c")), sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=schema)

    # A row for each id of the vocabulary at most.
    rows = counts.select("c", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def packed_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """All ids of packed rows in a row, and how many each row has."""
    n = np.asarray(pc.binary_length(column), dtype=np.int64) // 4
    return np.frombuffer(_flat(column, n * 4), dtype="<u4"), n


def _flat(column: pa.Array, sizes: np.ndarray):
    """The bytes of a binary column without nulls."""
    if not len(column):
        return b""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    first = int(np.frombuffer(ends, dtype=np.int64)[column.offset])
    return data.slice(first, int(sizes.sum())) if data is not None else b""


def pack_symbols(symbols: np.ndarray, text_ids: np.ndarray, v: attention.Vocabulary) -> list[pa.Array]:
    """Symbols of each text as two columns, low bytes and the rest: frequent symbols are small, so the rest packs well."""
    ends = np.concatenate([[0], np.cumsum(text_ids)])
    columns = []
    for x in (symbols.astype(np.uint8), (symbols >> 8).astype(_rest(v))):
        offsets = (ends * x.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(text_ids), [None, pa.py_buffer(offsets), pa.py_buffer(x)]))
    return columns


def unpack_symbols(low: pa.Array, high: pa.Array, v: attention.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, how many each text has)."""
    n = np.asarray(pc.binary_length(low), dtype=np.int64)
    rest = np.dtype(_rest(v))
    out = np.frombuffer(_flat(high, n * rest.itemsize), dtype=rest).astype(np.int32) << 8
    out |= np.frombuffer(_flat(low, n), dtype=np.uint8)
    return out, n


def _rest(v: attention.Vocabulary) -> str:
    return "u1" if v.symbols <= 1 << 16 else "<u4"


class Speller:
    """Ids of words, kept up to a bound, and the texts' id sequences.

    ``spelt`` has words' ids laid end to end, and where each word's begin and end.
    """

    def __init__(self, path: str, pattern: str, spelt: tuple[np.ndarray, np.ndarray] | None = None):
        self.own = encoder(path, pattern)
        self.spelt = spelt if spelt is not None else (np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))
        self.known: dict[str, bytes] = {}
        self.missed = 0

    def ids(self, distinct: list[str]) -> list[bytes]:
        get = self.known.get
        out = [get(w) for w in distinct]
        new = [w for w, x in zip(distinct, out) if x is None]
        if new:
            # A word of letters alone is one piece of the pattern.
            plain = [w for w in new if w.isalpha()]
            other = [w for w in new if not w.isalpha()]
            fresh = dict(zip(plain, self.own.of_pieces([" " + w for w in plain])))
            fresh.update(zip(other, self.own.encode_all([" " + w for w in other])))
            self.missed += len(new)
            if self.missed > 8 * _KEPT_WORDS:
                self.known, self.missed = {}, 0
            if len(self.known) + len(new) <= _KEPT_WORDS:
                self.known.update(fresh)
            out = [fresh[w] if x is None else x for w, x in zip(distinct, out)]
        return out

    def sequences(self, split, end: int, place: np.ndarray | None = None):
        """All ids of texts that split_words() has split, an end after each, and how many ids each text has.

        ``place`` is where each distinct word stands in ``spelt``, -1 for nowhere.
        """
        distinct, at, n = split
        if place is None:
            place = np.full(len(distinct), -1, dtype=np.int64)
        there, ends = self.spelt
        new = np.flatnonzero(place < 0)
        coded = self.ids(distinct.take(pa.array(new)).to_pylist())
        coded.append(np.array([end], dtype="<u4").tobytes())
        fresh = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        flat = np.concatenate([there, np.frombuffer(b"".join(coded), dtype="<u4")]).astype(np.int32)
        length, begin = np.empty(len(distinct) + 1, dtype=np.int64), np.empty(len(distinct) + 1, dtype=np.int64)
        length[:-1], begin[:-1] = ends[place + 1] - ends[place], ends[place]
        own = np.append(new, len(distinct))
        length[own], begin[own] = fresh, len(there) + np.cumsum(fresh) - fresh
        order = np.insert(at, np.cumsum(n), len(distinct))
        per_word = length[order]
        stop = np.cumsum(per_word)
        total = int(stop[-1]) if len(stop) else 0
        ids = flat[np.repeat(begin[order] - stop + per_word, per_word) + np.arange(total)]
        return ids, np.diff(stop[np.cumsum(n + 1) - 1], prepend=0)


def _mean_of(rows: DataFrame, n_groups: int) -> dict[int, np.ndarray]:
    """Weighted means of the groups' chunks; a task meets ``_FAN_IN`` of them at a time."""

    def added(_, table):
        table = table.sort_by("g")
        x = sum(np.frombuffer(v.as_py(), dtype="<f8") for v in table.column("x"))
        return pa.table({"g": table.column("to")[:1].cast(pa.int64()), "chunk": table.column("chunk")[:1], "n": [pc.sum(table.column("n")).as_py()], "x": [x.tobytes()]})

    while n_groups > 1:
        n_groups = -(-n_groups // _FAN_IN)
        rows = rows.withColumn("to", F.floor(F.col("g") / _FAN_IN)).groupBy("to", "chunk").applyInArrow(added, "g bigint, chunk int, n double, x binary")
    return {r["chunk"]: np.frombuffer(r["x"], dtype="<f8") / r["n"] for r in rows.collect()}


def _train_round(read: DataFrame, n_groups: int, sent, number: int, rate: float) -> dict[str, np.ndarray]:
    """Each group trains from the same weights; gives their average, weighted by ids."""
    ship(read.sparkSession)

    def run(key, table):
        v, first = sent.value
        w = {k: x.copy() for k, x in first.items()}
        model, g = attention.Model(v, w), key[0].as_py()
        table = table.sort_by([("place", "ascending"), ("low", "ascending"), ("high", "ascending")])
        rows, targets = [], []
        for batch in table.select(["low", "high"]).to_batches(max_chunksize=1024):
            for a, b in by_bytes(sizes_of(batch.column("low"))):
                own = attention.windows(*unpack_symbols(batch.column("low").slice(a, b - a), batch.column("high").slice(a, b - a), v), v)
                rows.append(own[0].astype(np.uint16 if v.symbols < 1 << 16 else np.int32))
                targets.append(own[1])
        del table
        rows = np.concatenate(rows)
        targets = np.concatenate(targets)
        seen = attention.train(model, rows, targets, rate, 1000 * number + g % 1000)
        flat = np.concatenate([w[k].ravel() for k, _ in attention.shapes(v)]).astype("<f8") * seen
        cuts = range(0, len(flat), _CHUNK)
        del rows, targets
        release()
        return pa.table({"g": pa.array([g] * len(cuts), pa.int64()), "chunk": pa.array(range(len(cuts)), pa.int32()), "n": [float(seen)] * len(cuts), "x": [flat[a : a + _CHUNK].tobytes() for a in cuts]})

    dealt = read.select("low", "high", F.xxhash64("doc_id", "low", "high", F.lit(17)).alias("place")).withColumn("g", F.pmod("place", F.lit(n_groups)))
    trained = dealt.repartition(n_groups, "g").groupBy("g").applyInArrow(run, "g bigint, chunk int, n double, x binary")
    means = _mean_of(saved(trained, "lm-weights"), n_groups)
    v, first = sent.value
    if not means:
        return first
    flat, out, at = np.concatenate([means[k] for k in sorted(means)]), {}, 0
    for k, shape in attention.shapes(v):
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def train_model(read: DataFrame, v: attention.Vocabulary, tokens: int, part: int = 2, rounds: int = 2, group_tokens: int = 4_000_000) -> dict[str, np.ndarray]:
    """The weights, learnt from all training documents (doc_id, low, high)."""
    if rounds < part:
        raise ValueError("with fewer rounds than parts, documents would be left out of the training")
    weights = attention.start(v)
    n_groups = max(1, round(tokens / part / group_tokens))
    for k in range(rounds):
        chosen = read.where(F.pmod(F.xxhash64("doc_id", "low", "high", F.lit(11)), F.lit(part)) == k % part)
        sent = read.sparkSession.sparkContext.broadcast((v, weights))
        weights = _train_round(chosen, n_groups, sent, k, 0.02 / (1 + k))
    return weights


def score_symbols(model: attention.Model, symbols: np.ndarray, text_ids: np.ndarray) -> np.ndarray:
    """log10 probabilities of texts by the model, whose tables project() has filled."""
    log_p = model.log_probability(symbols, text_ids).astype(np.float64)
    return np.add.reduceat(log_p, np.cumsum(text_ids) - text_ids) / math.log(10) if len(text_ids) else np.zeros(0)


_READ = "row bigint, doc_id bigint, n_tokens bigint, hot_log double, hot_known bigint, n_cold bigint, cold array<struct<h:bigint,n:bigint>>, low binary, high binary"
_SCORED = "row bigint, doc_id bigint, n_tokens bigint, hot_log double, hot_known bigint, n_cold bigint, score double"


def score(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", bound: int = 500_000, part: int = 2, rounds: int = 2, group_tokens: int = 4_000_000
) -> DataFrame:
    """One row per document with its base and model scores."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    train = rows.where(~held_out(F.col("doc_id")))
    n_train = train.select("doc_id").count()
    counts = saved(spell_counts(count_words(train), path, pattern), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total) + n_train, int(distinct) + (n_train > 0)
    scale = n + 0.1 * (v + 1)
    floor = hot_floor(counts, bound, n)
    hot = counts.where(F.col("c") >= floor).select("h", "c", "ids").toArrow()
    h = hot.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    spelt, lengths = packed_ids(hot.column("ids").take(pa.array(order)).combine_chunks())
    table = h[order], hot.column("c").to_numpy().astype(np.int64)[order], (spelt, np.concatenate([[0], np.cumsum(lengths)]))

    size = encoder(path, pattern).vocabulary.size
    symbols = attention.Vocabulary(count_ids(counts, size), n_train, size)
    hot_sent, symbols_sent = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(symbols)

    @tidy
    def run(batches):
        """For each document its symbols, what is known of its base, and its words that are to be joined."""
        known, known_c, spelt = hot_sent.value
        speller, v = Speller(path, pattern, spelt), symbols_sent.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column("text")), 2 * SMALL):
                split = split_words(batch.column("text").slice(a, b - a))
                own, at, n_words = split
                docs_ = len(n_words)
                hashes = word_hashes(own)
                place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                is_hot = known[place] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                gain = np.where(is_hot, np.log10(known_c[place] + 0.1), 0.0) if len(known) else np.zeros(len(hashes))
                doc = np.repeat(np.arange(docs_), n_words)
                hot_known = np.bincount(doc, weights=is_hot[at], minlength=docs_).astype(np.int64)
                cold = ~is_hot[at]
                key, times = np.unique(doc[cold] * max(1, len(own)) + at[cold], return_counts=True)
                d, w = key // max(1, len(own)), key % max(1, len(own))
                ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=docs_))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(hashes[w].view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "n"])
                ids, text_ids = speller.sequences(split, v.size, np.where(is_hot, place, -1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(docs_)), batch.column("doc_id").slice(a, b - a), pa.array(n_words + 1),
                        pa.array(np.bincount(doc, weights=gain[at], minlength=docs_)), pa.array(hot_known), pa.array(n_words - hot_known),
                        pa.ListArray.from_arrays(pa.array(ends), pairs), *pack_symbols(v.of_id[ids], text_ids, v),
                    ],
                    names=["row", "doc_id", "n_tokens", "hot_log", "hot_known", "n_cold", "cold", "low", "high"],
                )
                number += docs_

    read = saved(rows.mapInArrow(run, _READ), "lm-read")
    weights = train_model(read.where(~held_out(F.col("doc_id"))), symbols, n, part, rounds, group_tokens)
    model_sent = spark.sparkContext.broadcast((symbols, weights))

    @tidy
    def run_model(batches):
        v, w = model_sent.value
        model = attention.Model(v, w)
        model.project()
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column("low"))):
                part_ = batch.slice(a, b - a)
                score = score_symbols(model, *unpack_symbols(part_.column("low"), part_.column("high"), v))
                yield pa.RecordBatch.from_arrays([*part_.columns[:-2], pa.array(score, pa.float64())], names=[*part_.schema.names[:-2], "score"])

    scored = read.drop("cold").mapInArrow(run_model, _SCORED)
    # Words that training has not seen find no partner: theirs is the share of no count.
    cold = read.select("row", F.explode("cold").alias("x")).select("row", "x.h", "x.n")
    rare = counts.where(F.col("c") < floor).select(F.col("h").alias("c_h"), (F.log10(F.col("c") + F.lit(0.1)) + 1).alias("gain"))
    found = cold.join(rare, F.col("h") == F.col("c_h")).groupBy(F.col("row").alias("f_row")).agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.col("gain")).alias("gain"))
    both = scored.join(found, F.col("row") == F.col("f_row"), "left")
    log_c = F.col("hot_log") - F.col("n_cold") + F.coalesce("gain", F.lit(0.0)) + F.lit(math.log10(n_train + 0.1))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0)) + F.lit(int(n_train > 0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (log_c - F.col("n_tokens") * F.lit(math.log10(scale))).alias("base_score"), "score",
    )
