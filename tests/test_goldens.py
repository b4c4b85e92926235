"""Small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foretrace.functions import parsing, text
from foretrace.operators import fusion, graph, guard, memory, metrics, prep, priors, sequence, splits
from foretrace.operators.graph import RerankConfig
from foretrace.operators.guard import GuardConfig
from foretrace.operators.priors import PriorConfig
from foretrace.operators.sequence import EnsembleConfig

VARIANTS = [list("ABC")] * 3 + [list("ABD")] * 2 + [list("BC"), list("BE")]


def traced(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "trace array<string>")


def ranking(spark, rows, prefix, k, **config):
    model = sequence.fit(traced(spark, rows), EnsembleConfig(top_k=k, **config))
    one = spark.createDataFrame([(prefix,)], "prefix array<string>")
    return [(c.activity, round(c.score, 9)) for c in model.candidates(one).first().cands]


def cands(spark, *pairs, **more):
    """One row with candidates, and other columns given as (type, value)."""
    schema = ["cands array<struct<activity:string,score:double>>"] + [f"{k} {t}" for k, (t, _) in more.items()]
    return spark.createDataFrame([(list(pairs), *[v for _, v in more.values()])], ", ".join(schema))


def scores(row):
    return [(c.activity, round(c.score, 9)) for c in row]


@pytest.mark.parametrize(
    "rows, prefix, k, config, expected",
    [
        ([list("ABC"), list("ABD"), list("AE")], ["A"], 3, {}, [("B", 0.666666667), ("E", 0.333333333)]),
        ([list("ABC"), list("ABD"), list("AE")], ["A", "B"], 3, {}, [("C", 0.5), ("D", 0.5)]),
        (VARIANTS, ["B"], 1, {}, [("C", 1.0)]),
        (VARIANTS, ["B"], 2, {}, [("C", 0.625), ("E", 0.375)]),
        (VARIANTS, ["B"], 3, {}, [("C", 0.535714286), ("E", 0.321428571), ("D", 0.142857143)]),
        (VARIANTS, ["X", "B"], 3, {}, [("C", 0.571428571), ("D", 0.285714286), ("E", 0.142857143)]),
        (VARIANTS, [], 3, {}, [("A", 0.714285714), ("B", 0.285714286)]),
        (VARIANTS, [], 3, {"alpha": 1.0}, [("A", 0.714285714), ("B", 0.285714286)]),
        (VARIANTS, ["Q"], 3, {}, []),
        ([], ["A"], 3, {}, []),
    ],
)
def test_ensemble(spark, rows, prefix, k, config, expected):
    assert ranking(spark, rows, prefix, k, **config) == expected


def test_config_is_checked():
    with pytest.raises(ValueError):
        EnsembleConfig(alpha=1.5)
    with pytest.raises(ValueError):
        EnsembleConfig(markov_order=0)


def test_markov_keeps_the_unpruned_total(spark):
    model = sequence.markov_model(sequence.variants(traced(spark, VARIANTS)), 1, 2).filter(F.col("context") == F.array(F.lit("B")))
    assert {r.next: round(r.prob, 9) for r in model.collect()} == {"C": 0.571428571, "D": 0.285714286}


def test_dfg_ratio(spark):
    rows = graph.edges(sequence.variants(traced(spark, VARIANTS)), min_ratio=0.2).collect()
    assert {(r.src, r.dst): round(r.prob, 9) for r in rows} == {("A", "B"): 1.0, ("B", "C"): 0.571428571, ("B", "D"): 0.285714286}


def test_rerank(spark):
    row = cands(spark, ("D", 0.9), ("C", 0.1), out=("map<string,double>", {"C": 1.0}))
    assert scores(row.select(graph.rerank("cands", "out", RerankConfig(False, 1.0))[0]).first()[0]) == [("C", 1.1), ("D", 0.9)]
    moved, dropped, _ = graph.rerank("cands", "out", RerankConfig(True, 1.0, 0.1))
    got = row.select(moved.alias("m"), dropped.alias("d")).first()
    assert scores(got.m) == [("C", 1.1)] and got.d == ["D"]
    assert row.select(graph.rerank("cands", "out", RerankConfig(True, 1.0, 0.0))[1].alias("d")).first().d == []


def test_reweight_with_all_dropped(spark):
    row = cands(spark, ("Y", 0.6), ("Z", 0.4), out=("map<string,double>", {"C": 1.0}), prev=("string", "B"))
    moved, dropped, triggered = graph.prior_reweight("cands", "out", "prev")
    got = row.select(moved.alias("m"), dropped.alias("d"), triggered.alias("t")).first()
    assert scores(got.m) == [("Y", 0.6), ("Z", 0.4)] and got.d == ["Y", "Z"] and got.t


def test_prior_mix(spark):
    row = cands(spark, ("C", 1.1), ("D", 0.9), dests=("map<string,double>", {"C": 0.9}))
    assert scores(row.select(priors.mix("cands", PriorConfig(), pairs="dests")).first()[0]) == [("C", 0.53460404), ("D", 0.46539596)]


def test_pair_prior(spark):
    rows = spark.createDataFrame([(["A"], "B")] * 3 + [(["A"], "C"), (["Z", "A"], "B"), ([], "A")], "prefix array<string>, next string")
    assert [tuple(r) for r in priors.pair_prior(rows, 2).collect()] == [("A", "B", 4, 1.0)]


def test_guard(spark):
    rows = spark.createDataFrame([("A", "B", "True"), ("A", "B", "yes"), ("A", "B", "no"), ("A", "C", "0"), ("A", "C", "")], "prev string, next string, label string")
    valid = guard.allowed(guard.labelled_pairs(rows))
    assert [(r.prev, r.next, round(r.score, 6), r.prev_total) for r in valid.collect()] == [("A", "B", 0.666667, 5)]
    row = cands(spark, ("C", 0.6), ("B", 0.4), prefix=("array<string>", ["A"]), f=("array<string>", ["B"]))
    for mode, unseen, expected, blocked in (("soft", False, [("B", 0.4), ("C", 0.3)], ["C"]), ("hard", False, [("B", 0.4)], ["C"]), ("soft", True, [("C", 0.6), ("B", 0.4)], []), ("odd", False, [("C", 0.6), ("B", 0.4)], ["C"])):
        moved, out = guard.apply("cands", "f", "prefix", GuardConfig(mode=mode, keep_unseen=unseen))
        got = row.select(moved.alias("m"), out.alias("b")).first()
        assert scores(got.m) == expected and got.b == blocked


def test_fusion(spark):
    row = cands(spark, ("B", 0.4), ("C", 0.3), norm=("map<string,double>", {"B": 0.0, "C": 1.0}))
    label, final = fusion.fused("cands", "norm", 0.5)
    got = row.select(label.alias("l"), final.alias("s")).first()
    assert got.l == "C" and got.s == [0.4, 0.8]
    assert row.select(fusion.fused("cands", "norm", 0.0)[0].alias("l")).first().l == "B"


def test_similarity(spark):
    row = spark.createDataFrame([(list("ABC"), list("ABD"), [])], "q array<string>, e array<string>, n array<string>")
    assert round(row.select(memory.similarity("q", "e")).first()[0], 9) == 0.616666667
    assert row.select(memory.similarity("q", "n")).first()[0] == 0.0


def test_retrieval_by_model_alone(spark):
    held = spark.createDataFrame([(1, "i", "o", ["Z"], "m"), (2, "i", "o", ["Y"], "n")], "ex_id bigint, instruction string, output string, prefix array<string>, model_id string")
    asked = spark.createDataFrame([("c", ["A"], "m"), ("d", [], "m")], "case_id string, prefix array<string>, model_id string")
    assert [tuple(r) for r in memory.top_examples(asked, held).collect()] == [("c", 1, 1, 0.05)]


def test_parse_lists(spark):
    cells = {"['A', \"b's\"]": ["A", "b's"], "a, b,,c": ["a", "b", "c"], " ": [], "(1, None)": ["1", "None"], "[A, B]": ["[A", "B]"], None: [], "{'a': 1}": ["{'a': 1}"]}
    rows = spark.createDataFrame([(c,) for c in cells], "cell string").select("cell", parsing.parse_list("cell").alias("items"))
    assert {r.cell: r["items"] for r in rows.collect()} == cells


def test_parse_prefix_and_hash(spark):
    row = spark.createDataFrame([("A; B;;C", [" B", "A", "", "A"], list("CAB"))], "p string, a array<string>, b array<string>")
    got = row.select(parsing.parse_prefix("p"), parsing.activity_hash("a"), parsing.activity_hash("b")).first()
    assert tuple(got) == (["A", "B", "C"], "685d9b3124", "3ff3f27598")


def test_split_sizes(spark):
    ids = splits.split_ids(spark.range(25).select(F.col("id").alias("group_id")))
    assert {r.split: r["count"] for r in ids.groupBy("split").count().collect()} == {"train": 18, "val": 2, "test": 5}


def test_buckets(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 5, 8, 11, 3, 6, 9, 4)], "n int")
    got = {r.n: tuple(r)[1:] for r in sizes.select("n", parsing.bucket(F.col("n"), parsing.PROCESS_SIZE), parsing.bucket(F.col("n"), parsing.PREFIX_LENGTH), parsing.bucket(F.col("n"), parsing.TRACE_LENGTH)).collect()}
    assert [got[n][0] for n in (1, 2, 5, 8, 11)] == ["≤1", "2–4", "5–7", "8–10", "≥11"]
    assert [got[n][1] for n in (2, 3, 6, 9)] == ["≤2", "3–5", "6–8", "≥9"]
    assert [got[n][2] for n in (3, 4, 8, 11)] == ["≤3", "4–7", "8–10", "≥11"]


def test_metrics(spark):
    rows = spark.createDataFrame([("A", "A", ["A", "B"]), ("A", "B", ["B", "A"]), ("B", "B", ["B"]), ("C", "A", ["A", "B"])], "y_true string, y_pred string, ranked array<string>")
    got = rows.agg(metrics.accuracy().alias("a"), metrics.mrr().alias("m"), metrics.ndcg(5).alias("n")).first()
    assert (got.a, got.m, round(got.n, 9)) == (0.5, 0.625, 0.657732438)
    assert {r.label: round(r.f1, 9) for r in metrics.f1_by_label(rows).collect()} == {"A": 0.5, "B": 0.666666667, "C": 0.0}
    assert round(metrics.macro_f1(rows).first()[0], 9) == 0.388888889
    lost = spark.createDataFrame([("A", None, [])], "y_true string, y_pred string, ranked array<string>")
    assert metrics.macro_f1(lost).first()[0] == 0.0


def test_latency(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "latency_ms double")
    assert [round(x, 9) for x in metrics.latency_stats(rows).first()] == [2.5, 2.5, 3.7, 3.85]


def test_token_overlap(spark):
    rows = spark.createDataFrame([("the order was paid", "the order was paid because it ships"), ("x", None), ("", "y")], "explanation_text string, gold_explanation string")
    assert [round(x, 9) for x in metrics.token_overlap(rows).first()] == [1.0, 0.571428571, 0.727272727]


def test_texts(spark):
    row = spark.createDataFrame([("Explanation: Câu 1 rất dài. Câu 2 cũng được. Câu 3 nên bị cắt.", "prompt", 'Answer: "Pay Order".', ["Ship", "Pay Order"])], "raw string, prompt string, out string, cands array<string>")
    got = row.select(text.normalized_explanation("raw", "prompt"), text.parsed_label("out", "cands")).first()
    assert tuple(got) == ("Câu 1 rất dài. Câu 2 cũng được.", "Pay Order")
    prompts = row.select(text.prediction_prompt("cands", "cands").alias("p"), text.explanation_prompt(F.array().cast("array<string>"), "cands", "out").alias("e")).first()
    assert "{ Ship, Pay Order }" in prompts.p and "<EMPTY_PREFIX>" in prompts.e and "{" + "candidates}" not in prompts.e


def test_first_rows_and_copies(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "row_ord bigint, k string, v string")
    assert sorted(tuple(r) for r in prep.dedup_first(rows, ["k"]).collect()) == [(1, "a", "y"), (2, "b", "z")]
    assert prep.oversampled(rows, "k", "a", 2).count() == 7
    assert prep.oversampled(rows, "k", "a", 0).count() == 3
    first, rest = prep.positional_split(rows, 0.8)
    assert {r.row_ord for r in first.collect()} == {1, 2} and {r.row_ord for r in rest.collect()} == {3}
    assert prep.sampled(rows, 10, "row_ord").count() == 3


@pytest.mark.parametrize("parts", [1, 16])
def test_partitions_do_not_matter(spark, parts):
    rows = traced(spark, VARIANTS).repartition(parts)
    got = sequence.markov_model(sequence.variants(rows)).selectExpr("array_join(context, ' ') AS k", "next", "c").collect()
    assert sorted((r.k, r.next, r.c) for r in got) == [("A", "B", 5), ("A B", "C", 3), ("A B", "D", 2), ("B", "C", 4), ("B", "D", 2), ("B", "E", 1)]


def test_loaders_columns_and_records(spark, tmp_path):
    from foretrace.sources import tables

    path = str(tmp_path / "rows.csv")
    with open(path, "w") as out:
        out.write("model_id,revision_id,prefix,next,unique_activities,instruction,output\nm1,r1,\"['A', 'B']\",C,\"['A', 'B', 'C', 'A']\",say,C\n")
    assert tables.load_data(spark, path, tables.INSTRUCTIONS).first().unique_activities == ["A", "B", "C", "A"]
    with pytest.raises(ValueError):
        tables.load_data(spark, path, "other")
    parsed = spark.createDataFrame([(["A", "A"], ["A"], 5, "x")], "unique_activities array<string>, prefix array<string>, instruction int, output string")
    row = tables.preprocess(parsed, tables.INSTRUCTIONS).first()
    assert (row.unique_activities, row.prefix, row.trace, row.instruction) == (["A"], ["A"], [], "5")
    assert prep.has_columns(parsed, ["prefix", "output"]) and not prep.has_columns(parsed, ["gone"])
    assert prep.column_values(parsed, "output").first()[0] == "x"
    with pytest.raises(ValueError):
        prep.column_values(parsed, "gone")
    record = spark.createDataFrame([(0.5, 3)], "accuracy double, n bigint")
    tables.write_record(record, f"file://{tmp_path}/record")
    assert tuple(spark.read.json(f"file://{tmp_path}/record").first()) == (0.5, 3)
