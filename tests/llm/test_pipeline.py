"""The corpus pipeline against brute-force versions of its stages."""

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_groups, brute_hits, pii_spans

import corpus_pipeline
from foretrace.llm import bpe, quality
from foretrace.llm.common import stored


def test_stages(spark, sf_dir):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.RANKS), special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        before = {r.doc_id: r for r in docs.collect()}
        rows = out.collect()
        if name == "quality":
            assert {r.doc_id for r in rows} == {r.doc_id for r in quality.scored(docs, labels).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            order = sorted(before)
            groups = brute_groups([before[i].text for i in order], 5, 80)
            assert sorted(r.doc_id for r in rows) == [order[g[0]] for g in groups if g[3]]
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if brute_hits(r.text, items, 10)[1] == 0}
        elif name == "personal_data":
            assert len(rows) == len(before)
            for r in rows:
                assert not [s for s in pii_spans(r.text)] and r.n_chars == len(r.text or "")
                assert (r.text == before[r.doc_id].text) or pii_spans(before[r.doc_id].text)
        else:
            assert all(r["ids"] == reference.encode_ordinary(before[r.doc_id].text or "") and r.round_trip and r.n_tokens == len(r["ids"]) for r in rows)
            ids = {r.doc_id for r in rows}
            continue
        assert out.columns == columns
        docs = stored(out, f"test-{name}")
    assert ids and ids == {r.doc_id for r in docs.collect()}


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out


def test_nulls_and_repeats(spark, sf_dir):
    row = (1, "some plain words that are kept for now by every stage of the work", "en", "s", 3)
    docs = spark.createDataFrame([row, row, (None, None, None, None, None), (2, "", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs.coalesce(1), sf_dir)
    assert docs.filter(F.col("doc_id") == 1).count() == 1 and docs.count() == 3
