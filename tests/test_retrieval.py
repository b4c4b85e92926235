"""Retrieval over whole tables against brute force, on the smallest tables."""

import hashlib

import pytest

import __spark_entry__ as driver
from foretrace.plans import queries


def similarity(q, e):
    common = next((i for i, (a, b) in enumerate(zip(q, e, strict=False)) if a != b), min(len(q), len(e)))
    a, b = set(q), set(e)
    return 0.7 * common / max(len(q), len(e)) + 0.3 * (len(a & b) / len(a | b))


@pytest.fixture(scope="module")
def brute(spark, sf_dir):
    """The three best (place, ex_id, score) of every sample (case_id, pos), and the examples' texts."""
    held = queries._memory(spark, sf_dir).collect()
    best, seen = {}, {}
    for s in queries.samples(spark, sf_dir).collect():
        q = tuple(s.prefix)
        if q not in seen:
            seen[q] = [similarity(q, m.prefix) for m in held]
        scored = ((x + (0.05 if m.model_id == str(s.case_id) else 0.0), m.ex_id) for x, m in zip(seen[q], held, strict=True))
        ordered = sorted((-x, e) for x, e in scored if x > 0)[:3]
        best[s.case_id, s.pos] = [(k + 1, e, round(-x, 7)) for k, (x, e) in enumerate(ordered)]
    return best, {m.ex_id: m for m in held}


def test_fewshot_topk_of_all_samples(spark, sf_dir, brute):
    got = {key: [] for key in brute[0]}
    for r in driver.queries()["fewshot_topk"](spark, sf_dir).collect():
        got[r.case_id, r.pos].append((r.place, r.ex_id, round(r.score, 7)))
    assert {k: sorted(v) for k, v in got.items()} == brute[0]
    assert any(len(brute[1][e].prefix) > 6 for v in brute[0].values() for _, e, _ in v)


def test_fewshot_prompts_of_all_samples(spark, sf_dir, brute):
    from foretrace.functions import text

    rows = driver.queries()["fewshot_prompts"](spark, sf_dir).collect()
    assert sorted((r.case_id, r.pos) for r in rows) == sorted(brute[0])
    plain = queries.samples(spark, sf_dir).select("case_id", "pos", text.prediction_prompt("prefix", queries.F.array_sort(queries.F.array_distinct("prefix"))).alias("prompt"))
    plain = {(r.case_id, r.pos): r.prompt for r in plain.collect()}
    for r in rows:
        shots = [brute[1][e] for _, e, _ in brute[0][r.case_id, r.pos][:2]]
        block = "\n\n".join(f"Example {k + 1}:\n{m.instruction}\nCorrect answer: {m.output}" for k, m in enumerate(shots))
        prompt = (text.FEWSHOT_INTRO + block + text.FEWSHOT_OUTRO if shots else "") + plain[r.case_id, r.pos]
        assert (r.prompt_md5, r.length) == (hashlib.md5(prompt.encode()).hexdigest(), len(prompt))
