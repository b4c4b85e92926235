"""What holds at any size: lookups by measure, tries by name, selection at a rank, retrieval by bounds."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from foretrace.operators import joins, memory, prep, ranks, sequence, splits, trie
from foretrace.sources.scratch import new_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ lookups


def cases(spark, n=20_000):
    """Six rows in ten share a key; some have none."""
    key = F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 == 9, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
    return spark.range(n).repartition(8).select(F.col("id").alias("case_id"), key.alias("prev"))


def test_a_small_model_leaves_the_cases_where_they_are(spark):
    model = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(50))], "prev string, v int")
    out = joins.lookup(spark.read.parquet(written(cases(spark))), model, {"prev": "prev"})
    text = plan(out)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
    assert out.columns == ["case_id", "prev", "v"] and out.count() == 20_000 and out.filter("prev IS NULL AND v IS NOT NULL").isEmpty()


def written(df):
    path = new_path(df.sparkSession, "test")
    df.write.parquet(path)
    return path


def test_a_large_model_splits_hot_keys(spark):
    model = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(50))], "prev string, v int")
    rows = spark.read.parquet(written(cases(spark)))
    out = joins.lookup(rows, model, {"prev": "prev"}, broadcast_bytes=0, hot_rows=200)
    expected = joins.lookup(rows, model, {"prev": "prev"})
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = joins.lookup(rows.filter("prev IS NOT NULL"), model, {"prev": "prev"}, broadcast_bytes=0, hot_rows=200)
        sizes = [r["count"] for r in again.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 1.6 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("order", [1, 5])
def test_backoff_is_the_same_by_broadcast_and_in_one_shuffle(spark, order):
    rnd = random.Random(1)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(1, 9))],) for _ in range(200)]
    model = sequence.packed(sequence.markov_model(sequence.variants(spark.createDataFrame(rows, "trace array<string>")), order, 2), "context")
    asked = [([rnd.choice("abcdx") for _ in range(rnd.randint(0, 7))],) for _ in range(150)] + [(["a", "b"],)] * 3
    prefixes = spark.createDataFrame(asked, "prefix array<string>")
    small = sequence.markov_backoff(prefixes, model, order)
    large = sequence.markov_backoff(prefixes, model, order, broadcast_bytes=0)
    key = lambda r: (tuple(r.prefix), tuple(sorted((r.markov or {}).items())))
    assert sorted(map(key, small.collect())) == sorted(map(key, large.collect()))
    assert "Exchange hashpartitioning" not in plan(small) and any(r.markov for r in small.collect())


# ------------------------------------------------------------------ tries


def names_of(trace):
    out = [md5(b"").hexdigest()]
    for a in trace:
        out.append(md5((out[-1] + a).encode()).hexdigest())
    return out


def test_node_names_and_a_trace_of_ten_thousand(spark):
    long = [f"a{i % 300}" for i in range(10_000)]
    rows = [(["a", "b"], 2), (["a", "c"], 1), (long, 3), (["x"] * 64, 1), (["x"] * 65, 4)]
    df = spark.createDataFrame(rows, "trace array<string>, w bigint")
    for r in df.select("trace", trie.path("trace").alias("p"), trie.node("trace").alias("n")).collect():
        assert r.p == names_of(r.trace) and r.n == r.p[-1]
    counts = Counter()
    for trace, w in rows:
        for name, a in zip(names_of(trace), trace):
            counts[name, a] += w
    got = sequence.prefix_nodes(df)
    assert {(r.node, r.next): r.c for r in got.collect()} == counts
    # A row has names, not prefixes: bytes are linear in the trace.
    assert joins.stored_bytes(got.select("node", "next", "c")) < 150 * len(counts)
    few = sequence.prefix_counts(df, longest=3).collect()
    assert {(tuple(r.prefix), r.next): r.c for r in few if r.prefix[:1] != ["x"]} == {((), "a"): 3, (("a",), "b"): 2, (("a",), "c"): 1, ((), "a0"): 3, (("a0",), "a1"): 3, (("a0", "a1"), "a2"): 3, (("a0", "a1", "a2"), "a3"): 3, ((), "x"): 5}
    wanted = spark.createDataFrame([(["a"],), (["q"],)], "prefix array<string>")
    assert {(tuple(r.prefix), r.next, r.c) for r in sequence.prefix_counts(df, wanted).collect()} == {(("a",), "b", 2), (("a",), "c", 1)}


# ------------------------------------------------------------------ ranks


@pytest.mark.parametrize("few", [2048, 3])
def test_order_statistics_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "PARTS", 7)
    rnd = random.Random(few)
    kinds = {
        "double": [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e9), 5.0, -5.0, 1e-300, 1e308, -1e308]) for _ in range(900)] + [math.inf, -math.inf, -math.inf, math.nan, None],
        "bigint": [rnd.choice([rnd.randrange(-100, 100), rnd.randrange(-(1 << 63), 1 << 63), (1 << 60) + rnd.randrange(50)]) for _ in range(900)] + [None, -(1 << 63), (1 << 63) - 1],
    }
    for kind, values in kinds.items():
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)
        ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        asked = [0, 1, 2, 17, 450, 451, len(ordered) - 2, len(ordered) - 1, len(ordered), -1]
        got = ranks.order_statistics(df, F.col("v"), asked)
        for r in asked:
            expected = ordered[r] if 0 <= r < len(ordered) else None
            assert got[r] == expected or math.isnan(got[r]) and math.isnan(expected), (kind, r)
    assert ranks.order_statistics(df.filter("v > 0 AND v < 0"), F.col("v"), [0]) == {0: None}


def test_percentiles_equal_the_aggregate(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(rnd.choice([rnd.random() * 100, 3.5, None]),) for _ in range(3001)], "v double")
    shares = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    exact = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
    assert ranks.percentiles(df, "v", shares) == pytest.approx(exact, abs=1e-12)
    assert ranks.percentiles(df.limit(0), "v", [0.5]) == [None]


@pytest.mark.parametrize("n", [-1, 0, 1, 60, 299, 300, 301])
def test_split_at_a_rank(spark, n):
    rows = [(i % 40, i, f"r{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b bigint, c string").repartition(6)
    first, rest = ranks.split_at(df, n, F.col("a"), F.col("b"))
    expected = sorted(rows)
    assert sorted(map(tuple, first.collect())) == expected[: max(n, 0)] and sorted(map(tuple, rest.collect())) == expected[max(n, 0) :]
    first, rest = ranks.split_at(df, n, F.lit(1))  # all tie
    assert sorted([*map(tuple, first.collect()), *map(tuple, rest.collect())]) == expected and first.count() == min(max(n, 0), 300)


def test_several_cuts_within_ties(spark):
    rows = [(v, i) for i, v in enumerate([None] * 10 + [1] * 30 + [2] * 5 + [3] * 30)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r))
    for places in ([5, 15, 15, 25, 60], [10, 40], [0, 75], [45, 20, 99], []):
        parts = ranks.cut_at(df, places, F.col("a"), F.col("b"))
        at = 0
        assert len(parts) == len(places) + 1
        for part, p in zip(parts, [*places, 75]):
            p = min(max(p, at), 75)
            assert sorted(map(str, map(tuple, part.collect()))) == sorted(map(str, ordered[at:p]))
            at = p


def test_cuts_by_selection_equal_ordered_limits(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("row_ord"), (F.col("id") * 7 % 11).cast("string").alias("ds_labels"))
    small = [prep.head(df, 77), prep.sampled(df, 50, "row_ord"), prep.sampled(df, 20, "row_ord", 3, "ds_labels", "4")]
    small = [sorted(map(tuple, x.collect())) for x in small]
    monkeypatch.setattr(prep, "SMALL_CUT", 0)
    large = [prep.head(df, 77), prep.sampled(df, 50, "row_ord"), prep.sampled(df, 20, "row_ord", 3, "ds_labels", "4")]
    assert [sorted(map(tuple, x.collect())) for x in large] == small and [len(x) for x in small] == [77, 50, 20]
    assert "Limit" not in plan(large[1]) and "SinglePartition" not in plan(large[1])


# ------------------------------------------------------------------ retrieval


def similarity(q, e):
    common = next((i for i, (a, b) in enumerate(zip(q, e)) if a != b), min(len(q), len(e)))
    a, b = set(q), set(e)
    return 0.7 * common / max(len(q), len(e)) + 0.3 * (len(a & b) / len(a | b))


@pytest.mark.parametrize("shapes,words,longest", [(512, 5, 8), (4, 5, 8), (3, 30, 12), (1, 200, 6)])
@pytest.mark.parametrize("models", [True, False])
def test_retrieval_equals_brute_force(spark, monkeypatch, shapes, words, longest, models):
    monkeypatch.setattr(memory, "NODE_SHAPES", shapes)
    rnd = random.Random(shapes * words)
    # A third of the prefixes begin alike, as traces with a start activity do; some are repeated often.
    some = lambda i: ["s"] * (i % 3 > 0) + [f"a{min(rnd.randrange(words), rnd.randrange(words))}" for _ in range(rnd.randint(1, longest))]
    examples = [(i, some(i), rnd.choice([None, "m1", "m2", "m3"])) for i in range(300)]
    examples += [(300 + i, examples[i % 7][1], examples[i % 7][2]) for i in range(60)] + [(999, [], "m1")]
    asked = [(f"c{i}", some(i) if i % 4 else rnd.choice(examples)[1], rnd.choice([None, "m1", "m2", "m9"])) for i in range(100)] + [("empty", [], "m1")]
    held = spark.createDataFrame(examples, "ex_id bigint, prefix array<string>, model_id string")
    queries = spark.createDataFrame(asked, "case_id string, prefix array<string>, model_id string")
    got = defaultdict(list)
    for r in memory.top_examples(queries if models else queries.drop("model_id"), held, 3).collect():
        got[r.case_id].append((r.place, r.ex_id, round(r.score, 9)))
    for c, q, m in asked:
        scored = sorted((-(similarity(q, e) + (0.05 if models and m is not None and m == n else 0)), i) for i, e, n in examples if q and e)
        assert sorted(got[c]) == [(k + 1, i, round(-x, 9)) for k, (x, i) in enumerate([y for y in scored if y[0] < 0][:3])], (c, q)


def test_no_key_of_the_retrieval_holds_most_rows(spark, monkeypatch):
    """3,000 random prefixes of 1,000 activities on both sides: met by all pairs, they gave 9 million rows of one key."""
    rnd = random.Random(11)
    some = lambda: [f"a{rnd.randrange(1000)}" for _ in range(rnd.randint(2, 12))]
    rows = lambda: spark.createDataFrame([(trie.ROOT, i, some()) for i in range(3000)], "root string, ex_id bigint, prefix array<string>")
    seen = []
    original = memory.stored
    monkeypatch.setattr(memory, "stored", lambda df, name: seen.append((name, original(df, name))) or seen[-1][1])
    found = memory.nearest(rows(), rows(), 3)
    assert found.select("qid").distinct().count() > 2900
    tables = dict(seen)
    probes = tables["probes"].groupBy("node", "act", "part").agg(F.count("*").alias("asked"))
    met = probes.join(tables["posting-sizes"], ["node", "act"]).select((F.col("asked") * F.col("n")).alias("pairs"))
    assert "posting-sizes" in tables and not tables["crowded-nodes"].isEmpty()
    total, most = met.agg(F.sum("pairs"), F.max("pairs")).first()
    assert total < 400_000 and most < 0.02 * total


# ------------------------------------------------------------------ saved splits


def test_split_is_replaced_at_once(spark):
    path = new_path(spark, "split")
    ids = lambda name: spark.createDataFrame([(f"g{i}", name) for i in range(9)], "group_id string, split string")
    splits.save(ids("one"), path)
    with pytest.raises(FileExistsError):
        splits.save(ids("two"), path)
    reading = splits.load(spark, path)  # planned, not yet run
    splits.save(ids("two"), path, overwrite=True)
    assert {r.split for r in reading.collect()} == {"one"} and {r.split for r in splits.load(spark, path).collect()} == {"two"}
    broken = ids("three").withColumn("split", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        splits.save(broken, path, overwrite=True)
    assert {r.split for r in splits.load(spark, path).collect()} == {"two"}
    splits.save(ids("four"), path, overwrite=True)
    assert splits.load(spark, path).count() == 9 and {r.split for r in splits.load(spark, path).collect()} == {"four"}
    plain = written(ids("plain"))
    assert splits.load(spark, plain).count() == 9
