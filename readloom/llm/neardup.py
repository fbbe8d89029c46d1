"""Near-duplicate detection by MinHash with tensored banding, exact links.

Documents are linked if the Jaccard similarity of their sets of word shingles
is at least a threshold; components of links are the groups.

1. Equal sets are one node from here on (the smallest id among them).
2. Support filter, exact: a linked document shares all but a bounded part of
   its shingles with its partner. Counting a fixed share of the hash space
   over the whole corpus shows documents with too many shingles that no other
   has; these cannot be linked to anything and leave.
3. Tensored banding: two collections of m hashes, each of r minima, stand for
   m * m tables whose keys are pairs (one hash of each collection), for 2*m*r
   minima in place of 2*r*m*m. Rows are dealt by the first half of the key; the
   second half is compared where they meet.
4. Leaders: each node meets the smallest node of each of its half-key buckets.
   Pairs that pass two exact bounds (sizes; a histogram of hashes that bounds
   the intersection from above) are verified on the full texts, and the links
   give first components. No bucket of any size is expanded for this.
5. Rest: in buckets that still hold several components, pairs between
   different components that share a whole key are tested by the same bounds,
   in numpy blocks of bounded size, and verified. Pairs within a component are
   never formed.

A pair at the threshold of 0.8 is missed by the tables with probability
2 * 0.36^m (m = 12: 1e-5); pairs above it are missed less.

Defined results: a null or wordless text has an empty set and links with
nothing; fewer words than the shingle size are one shingle; rows of one
id and different texts get components of their own, in which the id stands for
its least text; a null id is never linked to others except by an
equal set, whose smallest id it takes; an empty table gives no rows; extra
columns are ignored by ``group`` and stay in ``deduplicate``, whatever their
names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import words
from readloom.llm.arrow import by_bytes, map_batches, sizes_of, text_bytes, tidy
from readloom.llm.graph import components
from readloom.session import saved, ship

M, R = 12, 2
BINS = 256
_SHARE = 0.375
_BLOCK = 1024
_SEEDS = words.mix(np.arange(1, 2 * M * R + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _shingled(batch, size: int):
    data, sizes = text_bytes(batch.column("text"))
    return words.shingles(words.WordText(data, sizes, words.NOT_BLANK), size)


def _text_hash(text):
    return F.xxhash64(text)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, text_hash, n, key, sig, bins): set size, digest of the set, minima, histogram."""

    def make():
        def work(batch):
            doc, h = _shingled(batch, size)
            rows = len(batch.column("text"))
            n = np.bincount(doc, minlength=rows)
            starts = np.searchsorted(doc, np.arange(rows))
            keys = [hashlib.blake2b(h[a : a + k].tobytes(), digest_size=16).digest() if k else None for a, k in zip(starts.tolist(), n.tolist())]
            full = np.flatnonzero(n)
            sig = np.zeros((rows, 2 * M), dtype="<u4")
            if len(full):
                for k in range(2 * M):
                    low = [np.minimum.reduceat(words.mix(h * _SEEDS[k * R + j]), starts[full]) for j in range(R)]
                    own = low[0]
                    for x in low[1:]:
                        own = words.mix(own + x)
                    sig[full, k] = own >> np.uint64(32)
            bins = np.bincount(doc * BINS + (h >> np.uint64(56)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
            small = (bins < 255).all(axis=1)
            packed = bins.astype(np.uint8)
            return [
                batch.column("id"),
                batch.column("text_hash"),
                pa.array(n, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([s.tobytes() for s in sig], pa.binary()),
                pa.array([b.tobytes() if s else None for b, s in zip(packed, small.tolist())], pa.binary()),
            ]

        return work

    return map_batches(docs, "id bigint, text_hash bigint, n bigint, key binary, sig binary, bins binary", "text", make)


def _postings(docs: DataFrame, size: int) -> DataFrame:
    """(id, h) of the shingles in the counted share of the hash space."""
    ship(docs.sparkSession)
    top = np.uint64(int(_SHARE * 2**64))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64())])

    @tidy
    def run(batches):
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column("text"))):
                part = batch.slice(a, b - a)
                doc, h = _shingled(part, size)
                # The low bits choose, as the high ones make the histogram.
                own = words.mix(h) < top
                ids = part.column("id").take(pa.array(doc[own]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h[own].view(np.int64))], schema=schema)

    return docs.select("id", "text").mapInArrow(run, "id bigint, h bigint")


def _fits(percent: int, a: str, b: str):
    """Exact bound by sizes: percent * max <= 100 * min."""
    return F.lit(percent) * F.greatest(a, b) <= F.lit(100) * F.least(a, b)


def _may_link(na, nb, overlap, percent: int):
    """Whether an intersection of ``overlap`` at most can reach the threshold."""
    return 100 * overlap >= percent * (na + nb - overlap)


def _leader_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose histograms allow a link."""
    ship(pairs.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @tidy
    def run(batches):
        for batch in batches:
            left, right = batch.column("bins_a"), batch.column("bins_b")
            known = np.asarray(left.is_valid()) & np.asarray(right.is_valid())
            keep = ~known
            rows = np.flatnonzero(known)
            if len(rows):
                take = pa.array(rows)
                x, y = (np.frombuffer(b"".join(c.take(take).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in (left, right))
                overlap = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                na, nb = (np.asarray(batch.column(c))[rows] for c in ("n_a", "n_b"))
                keep[rows] = _may_link(na, nb, overlap, percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], schema=schema)

    return pairs.select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInArrow(run, "a bigint, b bigint")


def _maybe_in(docs: DataFrame, ids: DataFrame, id_col, flag: str) -> DataFrame:
    """The documents with a flag: false only where the id is surely not among ``ids`` (id).

    The ids are sent as a bitmap of hashes of 2^25 bits (4 MB) whatever their
    number, which bounds the broadcast; where it fills up, more flags are true.
    """
    bit_of = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(1 << 25))
    bit, bucket, bits = (f"{n}_{uuid.uuid4().hex}" for n in ("bit", "bucket", "bits"))
    maps = ids.select(bit_of(F.col("id")).alias(bit)).groupBy(F.bitmap_bucket_number(bit).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bits))
    byte = F.substring(bits, (F.bitmap_bit_position(bit) / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.bitmap_bit_position(bit) % 8).cast("int")) == 1
    found = docs.withColumn(bit, bit_of(id_col)).join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col(bucket), "left")
    return found.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(bit, bucket, bits)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``ids``, and maybe of a few others; few texts are moved."""
    return _maybe_in(docs, ids, F.col("id"), "near").where("near").groupBy("id").agg(F.min("text").alias("text"))


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets of both texts link."""
    ship(pairs.sparkSession)
    pairs = saved(pairs, "neardup")
    texts = _texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    left = texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))

    @tidy
    def run(batches):
        last, last_set = None, set()
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if last != b:
                    last, last_set = b, words.shingle_set(text_b.as_py(), size)
                own = words.shingle_set(text_a.as_py(), size)
                both = len(own & last_set)
                keep.append(both > 0 and 100 * both >= percent * (len(own) + len(last_set) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], schema=schema)

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _half_keys(nodes: DataFrame, hashes: int) -> DataFrame:
    """(id, n, half): one row for each of the first ``hashes`` hashes."""
    halves = F.array(*[F.concat(F.lit(bytes([i])), F.substring("sig", 4 * i + 1, 4)) for i in range(hashes)])
    return nodes.select("id", "n", F.explode(halves).alias("half"))


def _rest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a key, in bounded blocks.

    rows: (half, block, side, id, n, comp, sig, bins), sorted by (half, block).
    """
    ship(rows.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(half: bytes, own, other):
        """own, other: (ids, n, comp, sig, bins, has_bins); the same object if a block meets itself."""
        i = half[0]
        ids, n, comp, sig, bins, has = own
        ids2, n2, comp2, sig2, bins2, has2 = other
        ok = (comp[:, None] != comp2[None, :]) & (percent * np.maximum(n[:, None], n2) <= 100 * np.minimum(n[:, None], n2))
        if own is other:
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
        x, y = np.nonzero(ok)
        out = []
        for s in range(0, len(x), 1 << 16):
            p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
            second = (sig[p, M:] == sig2[q, M:]).any(axis=1)
            # A pair that meets under several first halves is taken under the first.
            earlier = (sig[p, :i] == sig2[q, :i]).any(axis=1)
            keep = second & ~earlier
            p, q = p[keep], q[keep]
            overlap = np.minimum(bins[p], bins2[q]).sum(axis=1, dtype=np.int64)
            keep = _may_link(n[p], n2[q], overlap, percent) | ~has[p] | ~has2[q]
            out.append((ids[p[keep]], ids2[q[keep]]))
        return out

    def block_of(batch, those):
        part = batch.take(pa.array(those))
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype="<u4").reshape(-1, 2 * M)
        raw = part.column("bins").to_pylist()
        bins = np.frombuffer(b"".join(x if x is not None else bytes(BINS) for x in raw), dtype=np.uint8).reshape(-1, BINS)
        has = np.array([x is not None for x in raw], dtype=bool)
        return tuple(np.asarray(part.column(c)) for c in ("id", "n", "comp")) + (sig, bins, has)

    def finish(batch):
        side = np.asarray(batch.column("side"))
        half = batch.column("half")[0].as_py()
        sides = [block_of(batch, np.flatnonzero(side == k)) for k in (0, 1) if (side == k).any()]
        pairs = test(half, sides[0], sides[0]) if len(sides) == 1 and side[0] == 0 else test(half, sides[0], sides[1]) if len(sides) == 2 else []
        return pairs

    @tidy
    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            key = whole.column("group").to_pylist()
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            found = []
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                found += finish(whole.slice(a, b - a))
            held = pa.concat_batches([whole.slice(cuts[-2])])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=schema)
        if held is not None and (found := finish(held)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=schema)

    return rows.mapInArrow(run, "a bigint, b bigint")


def _rest(nodes: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Unverified pairs (a, b) between components that share a key."""
    at = comp.select(F.col("node").alias("c_node"), F.col("component").alias("c_comp"))
    own = nodes.join(at, F.col("id") == F.col("c_node"), "left").withColumn("comp", F.coalesce("c_comp", "id")).drop("c_node", "c_comp")
    keyed = _half_keys(own.select("id", "n", "sig"), M).join(own.select(F.col("id").alias("o_id"), "comp"), F.col("id") == F.col("o_id")).drop("o_id")
    mixed = keyed.groupBy(F.col("half").alias("m_half")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi")
    mixed = mixed.select("m_half", F.ceil(F.col("members") / _BLOCK).cast("int").alias("nb"))
    rows = keyed.join(mixed, F.col("half") == F.col("m_half")).select("id", "half", "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("blk"))
    # Each pair of blocks of a bucket is a group; a group holds two blocks at most.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    low, high = F.least("blk", "other"), F.greatest("blk", "other")
    rows = rows.select("id", "half", (low * F.col("nb") + high).cast("bigint").alias("block"), F.when(F.col("blk") == low, 0).otherwise(1).alias("side"))
    full = rows.join(own.select(F.col("id").alias("o_id"), "n", "comp", "sig", "bins"), F.col("id") == F.col("o_id")).drop("o_id")
    full = full.withColumn("group", F.concat("half", F.encode(F.col("block").cast("string"), "utf-8")))
    return _rest_pairs(full.repartition("group").sortWithinPartitions("group"), percent).distinct()


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, component) of each row: set size, smallest id of its group."""
    return _grouped(docs, id_col, text_col, size, percent).select("id", "n", "component")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, text_hash, n, component) of each row."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.withColumn("text_hash", _text_hash(F.col("text")))
    every = saved(signatures(plain, size), "neardup")
    sets = every.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "sig", "bins"), "id").alias("first"))
    reps = sets.where(F.col("rep").isNotNull()).select("key", "rep", "first")
    firsts = reps.select(F.col("rep").alias("id"), "first.*")

    # Support: shingles of the counted share that only one set has.
    post = _postings(plain, size)
    alone = post.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo = hi")
    lonely = alone.groupBy(F.col("lo").alias("l_id")).agg(F.count(F.lit(1)).alias("u"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100.0)
    nodes = firsts.join(lonely, F.col("id") == F.col("l_id"), "left").where(F.coalesce("u", F.lit(0)) <= most)
    nodes = saved(nodes.select("id", "n", "sig", "bins"), "neardup")
    keys = _half_keys(nodes, 2 * M)
    leader = keys.groupBy(F.col("half").alias("l_half")).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pairs = keys.join(leader, F.col("half") == F.col("l_half")).where("a < id").select("a", F.col("id").alias("b"), F.col("n").alias("n_b")).distinct()
    bins = nodes.select("id", "n", "bins")
    pairs = pairs.join(bins.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("bins").alias("bins_a")), F.col("a") == F.col("id_a"))
    pairs = pairs.where(_fits(percent, "n_a", "n_b"))
    pairs = pairs.join(bins.select(F.col("id").alias("id_b"), F.col("bins").alias("bins_b")), F.col("b") == F.col("id_b"))
    links = saved(_verify(_leader_filter(pairs, percent).select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), plain, size, percent), "neardup")
    comp = saved(components(links), "neardup")
    more = saved(_verify(_rest(nodes, comp, percent), plain, size, percent), "neardup")
    comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a > b").union(more.select("a", "b")))

    label = every.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep")).where(F.col("rep").isNotNull())
    label = label.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("s_key"), F.coalesce("component", "rep").alias("s_comp"))
    rows = every.select("id", "text_hash", "n", "key").join(label, F.col("key") == F.col("s_key"), "left")
    return rows.select("id", "text_hash", "n", F.coalesce("s_comp", "id").alias("component"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are not the first of their group.

    Rows leave by id and text: of rows that share an id, each stays or goes by its own text.
    """
    found = saved(_grouped(docs, id_col, text_col, size, percent).where("id <> component").select("id", "text_hash").distinct(), "neardup")
    tag = uuid.uuid4().hex
    own_id, flag = F.col(id_col).cast("bigint"), f"flag_{tag}"
    gone = found.toDF(f"gone_id_{tag}", f"gone_hash_{tag}")
    same = (own_id == F.col(f"gone_id_{tag}")) & (_text_hash(F.col(text_col).cast("string")) == F.col(f"gone_hash_{tag}"))
    # Only documents that may have to go are joined; the others stay where they are.
    flagged = _maybe_in(docs, found, own_id, flag)
    stay, asked = flagged.where(~F.col(flag)), flagged.where(F.col(flag)).join(gone, same, "left_anti")
    return stay.select(*docs.columns).unionAll(asked.select(*docs.columns))
