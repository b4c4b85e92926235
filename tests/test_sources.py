"""List cells against Python's own literals, CSV reading, and providers that fail."""

import ast
import random
import warnings

import pytest
from pyspark.sql import functions as F

from foretrace.functions import parsing
from foretrace.operators import priors
from foretrace.plans import queries
from foretrace.sources import tables
from foretrace.sources.scratch import new_path

CELLS = ["[]", "()", "[ ]", "['a', 'b']", "('a',)", "('a')", "(1)", "[1, -2, 0, True, None]", "[1.5]", "['it\\'s']", '["it\'s", "b"]', "['a' 'b']", "['a',,'b']", "[,]", "(,)", "['a',]"]
CELLS += ["[['a','b'],['c']]", "[007]", "['a'", "['a')", "[abc]", "[a, b]", "[b'x']", "[+1]", "[-0]", "['é', '漢\U0001f600']", "[\n'a',\n 'b'\t]", "['a\nb']", "  ['x'] ", "[1_0]", "[12abc]"]
CELLS += ["[TrueFalse]", "plain, text", "", None, "[{1:2}]", "['x']['y']", "[('a','b'), ('c',), ('d','e','f'), 'g->h', 'i,j', 'k', ['l', 2]]", "(('a','b'))", "(('a','b'),)", "(('a','b'),('c','d'))"]
CELLS += ["[('a')]", "[('a','b',)]", "[(,)]", "[('a' 'b','c')]", "[((1,2),3)]", "('x->y',)", "('x->y')", "[('a','b']", "[(1,2))]", "[[],()]", "['a -> b -> c']", "[' a , b ']", "a->b, c -> d, x", "['p,q->r']"]
CELLS += ["[" + ", ".join(f"'act{i}'" for i in range(5000)) + "]"]
PARTS = ["'a'", '"b"', ",", ", ", "[", "(", "]", ")", "1", "0", " ", "'x->y'", "None", "\\", "'"]


def literal(cell):
    text = cell.strip() if cell is not None else ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval(text) if text[:1] in ("[", "(") else None
    except Exception:
        return None
    return value if isinstance(value, (list, tuple)) else None


def separated(cell):
    return [p.strip() for p in (cell or "").split(",") if p.strip()]


def items_of(cell):
    value = literal(cell)
    return separated(cell) if value is None else [str(x) for x in value]


def pairs_of(cell):
    value = literal(cell)
    if value is None:
        return [tuple(x.strip() for x in p.split("->", 1)) for p in separated(cell) if "->" in p]
    out = []
    for item in value:
        if isinstance(item, (list, tuple)):
            parts = [str(x) for x in item] if len(item) == 2 else []
        else:
            mark = next((m for m in ("->", ",") if m in str(item)), None)
            parts = [x.strip() for x in str(item).split(mark, 1)] if mark else []
        out += [tuple(parts)] if parts else []
    return out


def test_list_cells_equal_python_literals(spark):
    rnd = random.Random(5)
    cells = CELLS + [rnd.choice("[(") + "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 9))) + rnd.choice("])") for _ in range(2500)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    rows = df.select("c", parsing.parse_list("c").alias("l"), parsing.parse_pairs("c").alias("p"), parsing.refused("c").alias("r")).collect()
    for r in rows:
        assert r.l == items_of(r.c) and [tuple(x) for x in r.p] == pairs_of(r.c), r.c
    plain = [r for r in rows if r.c in CELLS and not r.r]
    assert len(plain) > 20 and not next(r for r in rows if r.c == CELLS[-1]).r


def test_loading_flat_lists_needs_no_python(spark, sf_dir):
    rows = tables.load_snap(spark, queries.as_csv(queries.raw_samples(spark, sf_dir), "snap"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() > 0
    odd = spark.createDataFrame([("['a', 1.5]",)], "c string")
    assert "Python" in parsing.with_lists(odd, "c")._jdf.queryExecution().executedPlan().toString() and parsing.with_lists(odd, "c").first().c == ["a", "1.5"]


def write(spark, name, files):
    folder = new_path(spark, name).removeprefix("file://")
    import os

    os.makedirs(folder)
    for file, text in files.items():
        with open(f"{folder}/{file}", "w") as out:
            out.write(text)
    return f"file://{folder}"


def test_csv_rows_are_numbered_by_file_and_place(spark):
    lines = {f"part-{k}.csv": "a,b\n" + "".join(f"{k},{i}\n" for i in range(n)) for k, n in ((2, 900), (0, 5), (1, 3000))}
    path = write(spark, "csv", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert not tables.spans_lines(spark, path)
        rows = tables.read_csv(spark, path)
        got = rows.orderBy("row_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [(str(k), str(i)) for k, n in ((0, 5), (1, 3000), (2, 900)) for i in range(n)]
    assert [(r.a, r.b) for r in got] == expected and [r.row_ord for r in got] == list(range(len(expected)))


def test_csv_cells_with_line_breaks(spark):
    path = write(spark, "csv", {"x.csv": 'a,b\n"one\ntwo, ""three""",1\nfour,2\n'})
    assert tables.spans_lines(spark, path)
    assert [(r.a, r.b, r.row_ord) for r in tables.read_csv(spark, path).orderBy("row_ord").collect()] == [('one\ntwo, "three"', "1", 0), ("four", "2", 1)]


def test_provider_errors_are_rows_without_an_answer(spark):
    def weights(prefix):
        return {"a": {"x": 2}, "text": {"x": "many"}, "none": None, "nan": {"x": float("nan")}, "list": [1]}[prefix[0]]

    df = spark.createDataFrame([(["a"],), (["text"],), (["none"],), (["nan"],), (["list"],), (["unknown"],), ([],), (None,)], "prefix array<string>")
    got = [r.w for r in df.select(priors.provider(weights)("prefix").alias("w")).collect()]
    assert got == [{"x": 2.0}] + [None] * 7


def test_a_prior_map_that_is_too_large_is_looked_up(spark):
    cands = [(["p"], [("a", 0.6), ("b", 0.3)]), (["q"], [("c", 1.0)]), (["r"], [])]
    cases = spark.createDataFrame(cands, "prefix array<string>, cands array<struct<activity:string,score:double>>")
    prior = spark.createDataFrame([("a", 0.5), ("c", 0.2), ("z", 0.3)], "activity string, w double")
    mixed = lambda limit: sorted((r.prefix, r.m) for r in priors.with_activity_map(cases, prior, limit).select("prefix", priors.mix("cands", priors.PriorConfig("activity"), activities="acts").alias("m")).collect())
    assert mixed(0) == mixed(None) and priors.with_activity_map(cases, prior, 0).filter(F.map_contains_key("acts", F.lit("z"))).isEmpty()


@pytest.mark.parametrize("accuracy", [None, 10_000])
def test_latency_opt_in(spark, accuracy):
    from foretrace.operators import metrics

    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("latency_ms"))
    r = metrics.latency_stats(df, accuracy=accuracy).first()
    assert r.avg_ms == 500.5 and (r.p50_ms, r.p90_ms, r.p95_ms) == (pytest.approx((500.5, 900.1, 950.05), abs=1.01 if accuracy else 1e-9))


def test_stored_tables_can_be_cleared(spark, monkeypatch):
    from foretrace.sources import scratch

    monkeypatch.setattr(scratch, "_own_folder", lambda session, f=scratch._own_folder: f(session) + "-test")
    held = scratch.stored(spark.range(5), "numbers")
    assert held.count() == 5 and held.inputFiles()
    folder = scratch._own_folder(spark).removeprefix("file://")
    scratch.clear(spark)
    import os

    assert not os.path.exists(folder)
