import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from readloom.operators import ordering, overlap, pairing, ranking, reads, split


def test_ranks_with_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 200)}", i) for i in range(3000)] + [(None, 5000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(7)
    got = {(r.g, r.o): r.rn for r in ranking.ranked(df, [F.col("o")], ["g"], "rn").collect()}
    seen = {}
    for g, o in sorted(rows, key=lambda x: x[1]):
        seen[g] = seen.get(g, 0) + 1
        assert got[g, o] == seen[g]
    every = {r.o: r.rank for r in ranking.ranked(df, [F.col("o")]).collect()}
    assert all(every[o] == i for i, o in enumerate(sorted(o for _, o in rows), 1))
    sums = {r.o: r.s for r in ranking.running_sum(df, [F.col("o")], F.col("o") % 3, "s").collect()}
    total = 0
    for o in sorted(sums):
        total += o % 3
        assert sums[o] == total


def test_pairs_like_a_sequential_reader(spark):
    rnd = random.Random(2)
    rows = [(i, f"n{rnd.randint(0, 60)}", 0) for i in range(200)]
    pending, emitted, pairs, most = {}, [], 0, 0
    for o, n, _ in rows:
        if n in pending:
            most, pairs = max(most, len(pending)), pairs + 1
            emitted += [pending.pop(n), o]
        else:
            pending[n] = o
    emitted += [pending[n] for n in sorted(pending)]
    df = spark.createDataFrame(rows, "ord bigint, qname string, flag int").repartition(5)
    ranked = pairing.emission_rank(pairing.pair_by_name(df)).orderBy("emit_rank").collect()
    assert [r.ord for r in ranked] == emitted and [r.emit_rank for r in ranked] == list(range(1, 201))
    assert tuple(pairing.pair_statistics(df).first()) == (pairs, len(pending), most)
    none = df.where("false")
    assert tuple(pairing.pair_statistics(none).first()) == (0, 0, 0)


X = {"A": (1000, 5000), "B": (4000, 8000), "C": (400, 3000), "D": (800, 6000), "E": (3000, 4200)}
Y = {"a": (15, 22), "b": (7, 10), "c": (14, 24), "d": (4, 9), "e": (24, 31), "f": (16, 20), "g": (18, 21), "h": (5, 11), "i": (25, 27), "j": (0, 4)}
HITS = [("Y", 0, 50, "jdhbcafgei"), ("Y", 1, 50000, "jdhbcafgei"), ("Y", 8, 19, "dhbcafg"), ("Y", 12, 20, "cafg"), ("Y", 19, 24, "cafg"), ("X", 3999, 5000, "DAEB"), ("X", 1, 50000, "CDAEB"), ("Z", 0, 9, "")]


@pytest.mark.parametrize("bucket", [4, 1000, 1 << 17])
def test_overlap_cases(spark, bucket):
    features = spark.createDataFrame([(n, f, *i) for n, m in (("X", X), ("Y", Y)) for f, i in m.items()], "name string, f string, zstart bigint, zlimit bigint")
    queries = spark.createDataFrame([(i, *q[:3]) for i, q in enumerate(HITS)], "q int, name string, zstart bigint, zlimit bigint")
    rows = overlap.overlap_join(queries, features, bucket=bucket).orderBy("q", "r_zstart").collect()
    for i, q in enumerate(HITS):
        assert "".join(r.r_f for r in rows if r.q == i) == q[3]


@pytest.mark.parametrize("seed,bucket,widest", [(1, 8, 2), (2, 64, 4), (3, 1 << 17, 64)])
def test_overlap_equals_plain_join(spark, seed, bucket, widest):
    rnd = random.Random(seed)

    def some(n):
        out = []
        for i in range(n):
            a = rnd.randint(0, 2000)
            out.append((rnd.choice(["p", "p", "p", "q"]), i, a, rnd.choice([a, a, a + rnd.randint(0, 30), a + rnd.randint(0, 1500), 2147483647])))
        return spark.createDataFrame(out, "name string, i int, zstart bigint, zlimit bigint")

    left, right = some(150), some(150)
    fast, plain = overlap.overlap_join(left, right, bucket=bucket, widest=widest), overlap.overlap_join_plain(left, right)
    assert sorted((r.i, r.r_i) for r in fast.collect()) == sorted((r.i, r.r_i) for r in plain.collect())


def test_orders(spark):
    rows = [(i, r, z, q, f) for i, (r, z, q, f) in enumerate([(0, 5, "b", 0), (-1, -1, "a", 0), (0, 5, "a", 128), (0, 5, "a", 64), (2, 1, "c", 0), (0, 4, "z", 0)])]
    df = spark.createDataFrame(rows, "ord int, rindex int, zpos bigint, qname string, flag int")
    want = [5, 3, 2, 0, 4, 1]
    assert [r.ord for r in ordering.sort_reads(df).collect()] == want
    assert [r.ord for r in ordering.sort_rank(df, "location", "ord").orderBy("rank").collect()] == want
    assert tuple(ordering.check_sorted(df).first()) == (6, 3)
    done = ordering.sort_rank(df, "location", "ord").withColumn("ord", F.col("rank"))
    assert tuple(ordering.check_sorted(done).first()) == (6, 0)
    ordering.register_order("mapq", "quality", lambda: [F.col("zpos").desc()])
    assert {"location", "mapq", "qname"} <= set(ordering.orders())
    with pytest.raises(ValueError):
        ordering.sort_keys("none")


def test_lookups_raise(spark):
    refs = spark.createDataFrame([(0, "one")], "rindex int, name string")
    df = spark.createDataFrame([(0,), (-1,)], "rindex int")
    assert sorted(r.rname for r in reads.lookup_reference(df, refs).collect()) == ["*", "one"]
    with pytest.raises(PySparkException):
        reads.lookup_reference(spark.createDataFrame([(7,)], "rindex int"), refs).collect()
    with pytest.raises(PySparkException):
        reads.lookup_index(spark.createDataFrame([("x",)], "rname string"), refs).collect()
    assert reads.lookup_index(spark.createDataFrame([("x",)], "rname string"), refs, allow_undeclared=True).first().rindex == -1
    groups = spark.createDataFrame([("g", "lib")], "id string, lb string")
    for rg in ("h", None):
        with pytest.raises(PySparkException):
            reads.lookup_group(spark.createDataFrame([(rg,)], "rg string"), groups).collect()


def test_templates():
    fields = {"ID": "g1", "LB": "a/%#"}
    assert split.expand_template("%*-%ID.%.", fields, 3, "/d/run.1.bam", "sam") == "run-g1.sam"
    assert split.expand_template("%%%LB%#", fields, 3, "-", "sam") == "%a/%#3"
    assert split.base_name("-") == "stdin"
    for bad in ("%", "a%", "%ZZ", "%I"):
        with pytest.raises(ValueError):
            split.expand_template(bad, fields, 1, "x", "sam")


def test_plans_stay_native(spark, sf):
    from readloom.plans import catalog

    plan = catalog.QUERIES["flag_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "o_totalprice" not in schema and "o_orderdate" not in schema


def test_narrow_intervals_meet_only_in_narrow_buckets(spark):
    """Candidates by key of 2,000 narrow rows a side on one sequence, and the pairs found."""
    rows = [(i, 1, i * 100_000, i * 100_000 + 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, rindex int, zstart bigint, zlimit bigint")
    joined = overlap.overlap_join(df, df, "rindex")
    assert joined.count() == 2000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "level_a" in plan and "r_level_a" in plan
    wide = spark.createDataFrame([(0, 1, 0, 200_000_000), (1, 1, 5, 5), (2, 1, 100, 300_000_000)], df.schema)
    want = sorted((a[0], b[0]) for a in rows for b in [(0, 1, 0, 200_000_000), (1, 1, 5, 5), (2, 1, 100, 300_000_000)] if a[2] < b[3] and b[2] < a[3])
    assert sorted((r.id, r.r_id) for r in overlap.overlap_join(df, wide, "rindex").collect()) == want
    assert sorted((r.r_id, r.id) for r in overlap.overlap_join(wide, df, "rindex").collect()) == want
