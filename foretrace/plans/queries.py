"""The registered queries of the next-activity library, over the driver's tables as process logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions import parsing, text
from foretrace.operators import fusion, graph, guard, memory, metrics, prep, priors, sequence, splits, trie
from foretrace.operators.graph import RerankConfig
from foretrace.operators.guard import GuardConfig
from foretrace.operators.priors import PriorConfig
from foretrace.plans import hybrid
from foretrace.sources import logs, tables
from foretrace.sources.scratch import new_path, stored

SEP = " > "
REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def joined(column: Column | str) -> Column:
    return F.array_join(column, SEP)


def rounded(column: Column | str) -> Column:
    return F.round(parsing.col(column), 9)


# ------------------------------------------------------------------ inputs made from the tables


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.traces(logs.orders_customer(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str, traced: DataFrame | None = None) -> DataFrame:
    return logs.samples(traces(spark, sf_dir) if traced is None else traced)


def list_text(items: str) -> Column:
    """A Python list literal of the items."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))


def raw_samples(spark: SparkSession, sf_dir: str, traced: DataFrame | None = None) -> DataFrame:
    """Samples as text cells, with end tokens and invalid sets mixed in."""
    rows = samples(spark, sf_dir, traced).withColumn("row_ord", F.col("case_id").cast("bigint") * 1000 + F.col("pos"))
    label = F.when(F.col("pos") % 7 == 0, "[END]").when(F.col("pos") % 11 == 0, "END").otherwise(F.col("next"))
    sets = F.when(F.col("row_ord") % 13 == 0, F.concat("unique_activities", F.array(F.lit("None")))).otherwise(F.col("unique_activities"))
    rows = rows.withColumns({"label_text": label, "sets": sets})
    acts = F.when(F.col("pos") % 2 == 0, list_text("sets")).otherwise(F.array_join("sets", ", "))
    return rows.select("row_ord", F.col("case_id").alias("process_id"), F.col("pos").cast("string").alias("rev_id"), acts.alias("activities"), list_text("prefix").alias("partial_trace"), F.col("label_text").alias("next_activity"))


def raw_instructions(spark: SparkSession, sf_dir: str, traced: DataFrame | None = None) -> DataFrame:
    rows = raw_samples(spark, sf_dir, traced)
    return rows.withColumn("instruction", F.concat(F.lit("What follows "), F.col("partial_trace"), F.lit("?"))).withColumn("output", F.when(F.col("row_ord") % 5 != 0, F.col("next_activity")))


def as_csv(rows: DataFrame, name: str) -> str:
    path = new_path(rows.sparkSession, name)
    tables.write_csv(rows, path)
    return path


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.variants(traces(spark, sf_dir))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("prefix").distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prefix, prev, cands) of every distinct prefix."""
    model = sequence.fit(traces(spark, sf_dir))
    return model.candidates(prefixes(spark, sf_dir)).withColumn("prev", parsing.last("prefix"))


def guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, prev, next, key, price) of neighbouring orders."""
    orders = logs.table(spark, sf_dir, "orders")
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice")))
    per_case = orders.groupBy(F.col("o_custkey").cast("string").alias("case_id")).agg(ordered.alias("t"))
    n = F.size("t")
    pairs = F.zip_with(F.slice("t", 1, n - 1), F.slice("t", 2, n - 1), lambda a, b: F.struct(a["o_orderpriority"].alias("prev"), b["o_orderpriority"].alias("next"), b["o_orderkey"].alias("key"), b["o_totalprice"].alias("price")))
    return per_case.filter(n > 1).select("case_id", F.inline(pairs))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = guard_rows(spark, sf_dir).agg(F.avg("price").alias("m"))
    rows = guard_rows(spark, sf_dir).crossJoin(F.broadcast(mean))
    return rows.select("case_id", "prev", "next", F.when(F.col("price") > F.col("m"), "Yes").otherwise("0").alias("label"))


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("key") % 3 == 0, "neg_inv").when(F.col("key") % 3 == 1, "pos_inv").otherwise("question")
    return guard_rows(spark, sf_dir).select(F.concat(F.lit("('"), F.col("prev"), F.lit("', '"), F.col("next"), F.lit("')")).alias("eventually_follows"), kind.alias("instruction_type"), (F.col("key") % 5 != 0).alias("is_valid"))


STRICT = GuardConfig(keep_unseen=False)


def exploded(rows: DataFrame, cands: str = "cands", *more: str) -> DataFrame:
    """A row per candidate: prefix, rank, activity, score."""
    return rows.select(joined("prefix").alias("prefix"), *more, F.posexplode(cands).alias("rank", "c")).select("prefix", *more, (F.col("rank") + 1).alias("rank"), F.col("c.activity").alias("activity"), rounded("c.score").alias("score"))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, question, answer): user turns with the assistant turn that follows."""
    turns = logs.table(spark, sf_dir, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return users.join(answers, ["conv_id", "turn"]).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), "conv_id", "turn", "question", "answer")


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue(spark, sf_dir).withColumn("explanation_text", text.normalized_explanation(F.concat(F.lit("Explanation: "), F.col("answer")), "question"))
    score = F.when(F.col("turn") % 3 == 0, (F.col("conv_id") % 5 + 1).cast("int"))
    return rows.withColumns({"reason_pass_local": text.reason_pass("answer"), "human_score": score, "gold_explanation": F.when(F.col("conv_id") % 4 != 0, F.col("question"))})


def fitted(spark: SparkSession, sf_dir: str) -> tuple:
    """The hybrid model of the train cases, and the samples of the test cases."""
    traced = traces(spark, sf_dir)
    ids = splits.split_ids(traced.select(F.col("case_id").alias("group_id")))
    cases = stored(splits.split_rows(traced, ids, "case_id"), "cases")
    train = cases.filter("split = 'train'").drop("split")
    test = logs.samples(cases.filter("split = 'test'").drop("split"))
    pairs = guard.labelled_pairs(splits.subset(labelled(spark, sf_dir), ids, "train", "case_id"))
    config = hybrid.HybridConfig(guard=STRICT)
    model = hybrid.fit(train, logs.samples(train, 1), pairs, config, wanted=test)
    return model, test


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = fitted(spark, sf_dir)
    return model.predict(test.withColumnRenamed("next", "y_true")).withColumn("latency_ms", 1 + F.col("pos") * 0.25)


# ------------------------------------------------------------------ sources and parsing


@query
def load_snap(spark, sf_dir):
    rows = tables.load_snap(spark, as_csv(raw_samples(spark, sf_dir), "snap"))
    return rows.select("row_ord", "model_id", "revision_id", joined("unique_activities").alias("activities"), joined("prefix").alias("prefix"), "next")


@query
def load_instructions(spark, sf_dir):
    rows = tables.load_instructions(spark, as_csv(raw_instructions(spark, sf_dir), "instructions"))
    return rows.select("row_ord", joined("unique_activities").alias("activities"), "instruction", "output")


@query
def load_task(spark, sf_dir):
    path, saved = as_csv(raw_samples(spark, sf_dir), "task"), new_path(spark, "split")
    splits.save(splits.split_ids(tables.load_snap(spark, path).select(F.concat_ws("_", "model_id", "revision_id").alias("group_id"))), saved)
    rows = tables.load_task(spark, "next_activity", path, min_activities=4, split_path=saved)
    return rows.select("row_ord", joined("unique_activities").alias("activities"), joined("prefix").alias("prefix"), "next", "split")


@query
def load_data(spark, sf_dir):
    """Both kinds of tables through the loader that is chosen by name."""
    snap = tables.load_data(spark, as_csv(raw_samples(spark, sf_dir), "snap"), tables.SNAP)
    instructions = tables.load_data(spark, as_csv(raw_instructions(spark, sf_dir), "instructions"), tables.INSTRUCTIONS)
    part = lambda rows, kind: rows.select("row_ord", F.lit(kind).alias("kind"), joined("unique_activities").alias("activities"))
    return part(snap, "snap").unionByName(part(instructions, "instructions"))


@query
def split_saved_twice(spark, sf_dir):
    """A split table that is replaced while the first is still to be read."""
    traced, path = traces(spark, sf_dir), new_path(spark, "split")
    splits.save(splits.split_ids(traced, group="case_id"), path)
    first = splits.load(spark, path)
    splits.save(splits.split_ids(traced, 0.2, 0.3, group="case_id"), path, overwrite=True)
    return first.join(splits.load(spark, path).withColumnRenamed("split", "second"), "group_id")


@query
def metric_record(spark, sf_dir):
    path = new_path(spark, "record")
    tables.write_record(metrics.latency_stats(logs.table(spark, sf_dir, "orders"), "o_totalprice"), path)
    return _record(spark.read.json(path))


@query
def required_columns(spark, sf_dir):
    """Rows of the tables that have what is asked for."""
    rows = _labelled_rows(spark, sf_dir)
    asked = {"both": ("next", "prefix"), "missing": ("next", "verdict"), "none": ()}
    kept = [rows.select("row_ord", F.lit(name).alias("asked")) for name, columns in asked.items() if prep.has_columns(rows, columns)]
    return kept[0].unionByName(kept[1])


@query
def column_values(spark, sf_dir):
    return prep.column_values(_labelled_rows(spark, sf_dir), "next").groupBy("next").agg(F.count("*").alias("n"))


@query
def preprocess(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("row_ord", F.split(F.regexp_replace("activities", r"[\[\]']", ""), ", ").alias("unique_activities"), F.col("next_activity").alias("next"))
    out = tables.preprocess(rows)
    return out.select("row_ord", joined("unique_activities").alias("activities"), "next", F.size("prefix").alias("prefix_len"), F.size("trace").alias("trace_len"))


@query
def eval_samples(spark, sf_dir):
    rows = samples(spark, sf_dir).select(F.concat_ws("-", "case_id", F.col("pos").cast("string")).alias("id"), F.concat(F.array_join("prefix", "; "), F.lit(" ;;")).alias("steps"), F.col("next").alias("gold"))
    out = tables.load_eval_samples(spark, as_csv(rows, "eval"), "id", "steps", "gold")
    return out.select("case_id", joined("prefix").alias("prefix"), "y_true")


@query
def prior_json_roundtrip(spark, sf_dir):
    path = new_path(spark, "prior")
    priors.write_json(priors.pair_prior(samples(spark, sf_dir)), path)
    return priors.read_json(spark, path).select("prev", "next", rounded("w").alias("w"))


@query
def parse_list(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).withColumn("cell", F.when(F.col("row_ord") % 3 == 0, F.col("activities")).when(F.col("row_ord") % 3 == 1, F.regexp_replace("partial_trace", "'", "")).otherwise(F.concat(F.lit(" "), F.regexp_replace(F.col("partial_trace"), "[\\[\\]']", ""), F.lit(", ,"))))
    return rows.select("row_ord", joined(parsing.parse_list("cell")).alias("items"))


@query
def parse_pairs(spark, sf_dir):
    rows = guard_rows(spark, sf_dir)
    arrow = F.concat(F.col("prev"), F.lit(" -> "), F.col("next"), F.lit(", "), F.col("next"), F.lit("->"), F.col("prev"), F.lit(", x"))
    tuples = F.concat(F.lit("[('"), F.col("prev"), F.lit("', '"), F.col("next"), F.lit("'), ('"), F.col("prev"), F.lit("',)]"))
    rows = rows.withColumn("cell", F.when(F.col("key") % 2 == 0, arrow).otherwise(tuples))
    return rows.select("key", joined(F.transform(parsing.parse_pairs("cell"), lambda p: F.concat(p["src"], F.lit("/"), p["dst"]))).alias("pairs"))


@query
def parse_prefix(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("cell", F.concat(F.lit(" "), F.array_join("prefix", " ;"), F.lit(";; ")))
    return rows.select("case_id", "pos", joined(parsing.parse_prefix("cell")).alias("prefix"))


@query
def drop_end_tokens(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("items", F.transform("prefix", lambda t, i: F.when(i % 3 == 1, " [END] ").when(i % 5 == 2, "").otherwise(t)))
    return rows.select("case_id", "pos", joined(parsing.drop_end_tokens("items")).alias("prefix"))


@query
def resolve_columns(spark, sf_dir):
    rows = parsing.resolve_columns(raw_samples(spark, sf_dir), "unique_activities", "prefix", "next", "model_id", "revision_id", "label")
    return rows.select("row_ord", "model_id", "revision_id", "prefix", "next")


@query
def activity_hash(spark, sf_dir):
    return samples(spark, sf_dir).select("case_id", "pos", parsing.activity_hash(F.concat("prefix", F.array(F.lit(" "), F.col("next")))).alias("hash"))


@query
def ensure_model_id(spark, sf_dir):
    named, bare = raw_samples(spark, sf_dir), samples(spark, sf_dir)
    first = named.select(F.col("row_ord"), parsing.model_id(named).alias("model_id"))
    second = bare.select((-F.col("case_id").cast("bigint") * 1000 - F.col("pos")).alias("row_ord"), parsing.model_id(bare).alias("model_id"))
    return first.unionByName(second)


@query
def group_id(spark, sf_dir):
    rows = parsing.resolve_columns(raw_samples(spark, sf_dir), "model_id", "revision_id")
    both, one, none = rows, rows.drop("revision_id"), rows.drop("model_id", "revision_id")
    parts = [x.select("row_ord", F.lit(i).alias("form"), parsing.group_id(x).alias("group_id")) for i, x in enumerate((both, one, none))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def standardize(spark, sf_dir):
    rows = samples(spark, sf_dir).select("case_id", "pos", F.concat("prefix", "prefix").alias("unique_activities"), F.when(F.col("pos") % 2 == 0, F.col("prefix")).alias("prefix"))
    out = prep.standardized(rows)
    return out.select("case_id", "pos", joined("unique_activities").alias("activities"), joined("prefix").alias("prefix"), F.size("trace").alias("trace_len"))


@query
def pseudo_traces(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("prefix", F.when(F.col("pos") % 4 != 0, F.col("prefix")))
    return rows.select("case_id", "pos", joined(parsing.pseudo_trace("prefix", "next")).alias("trace"))


@query
def eval_case_rows(spark, sf_dir):
    rows = dialogue(spark, sf_dir).withColumn("output", F.when(F.col("turn") % 4 == 0, " NaN ").when(F.col("turn") % 6 == 2, "  ").otherwise(F.concat(F.lit(" "), F.col("answer"))))
    return rows.select("case_id", tables.gold_explanation("output").alias("gold_explanation"))


# ------------------------------------------------------------------ text


@query
def tokenize(spark, sf_dir):
    return logs.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.tokens("text"), " ").alias("tokens"))


@query
def split_sentences(spark, sf_dir):
    return logs.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.sentences("text"), "|").alias("sentences"))


@query
def normalize_explanation(spark, sf_dir):
    lead = F.when(F.col("turn") % 4 == 0, F.concat(F.col("question"), F.lit(" Answer: "))).when(F.col("turn") % 4 == 2, F.concat(F.lit("so, "), F.col("question"), F.lit("\nGiải thích: "))).otherwise("EXPLANATION:")
    rows = dialogue(spark, sf_dir).withColumn("raw", F.concat(lead, F.col("answer"), F.lit(" ")))
    return rows.select("case_id", text.normalized_explanation("raw", "question").alias("explanation"))


@query
def reason_pass(spark, sf_dir):
    return logs.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.reason_pass("text").alias("reason_pass"))


@query
def prediction_prompts(spark, sf_dir):
    return samples(spark, sf_dir).select("case_id", "pos", text.prediction_prompt("prefix", "unique_activities").alias("prompt"))


@query
def explanation_prompts(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("prefix", F.when(F.col("pos") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("prefix")))
    return rows.select("case_id", "pos", text.explanation_prompt("prefix", "unique_activities", "next").alias("prompt"))


@query
def parse_label(spark, sf_dir):
    raw = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("\nAnswer: "), F.lower("next"), F.lit(" .,\nmore"))).when(F.col("pos") % 4 == 1, F.concat(F.lit("I think "), F.col("next"), F.lit(" comes next."))).when(F.col("pos") % 4 == 2, " ").otherwise("Next activity: unknown")
    rows = samples(spark, sf_dir).withColumn("raw", raw)
    return rows.select("case_id", "pos", text.parsed_label("raw", "unique_activities").alias("label"))


@query
def synthetic_reverse(spark, sf_dir):
    return prep.synthetic(samples(spark, sf_dir), prep.reversed_prefix).select("case_id", "pos", joined("prefix").alias("prefix"))


@query
def prompt_catalog(spark, sf_dir):
    templates = text.catalog(spark)
    chosen = text.first_template(templates, "snap_predict").unionByName(text.first_template(templates, variant_group="snap_explain"))
    rows = samples(spark, sf_dir).select("case_id", "pos", F.when(F.col("pos") % 2 == 0, "snap_predict").otherwise("snap_explain").alias("task"))
    return rows.join(F.broadcast(chosen), "task").select("case_id", "pos", "id", F.length("template").alias("length"))


# ------------------------------------------------------------------ filters, limits, sampling


def _labelled_rows(spark, sf_dir):
    return parsing.resolve_columns(raw_samples(spark, sf_dir), "next", "prefix", "unique_activities")


@query
def drop_end_labels(spark, sf_dir):
    return prep.drop_end_labels(_labelled_rows(spark, sf_dir)).select("row_ord", "next")


@query
def drop_invalid_sets(spark, sf_dir):
    rows = _labelled_rows(spark, sf_dir).withColumn("unique_activities", F.split(F.regexp_replace("unique_activities", r"[\[\]']", ""), ", "))
    return prep.drop_invalid_sets(rows).select("row_ord", joined("unique_activities").alias("activities"))


@query
def invert_labels(spark, sf_dir):
    return logs.table(spark, sf_dir, "labels").select("doc_id", prep.inverted(F.col("quality")).alias("label"))


@query
def head_limit(spark, sf_dir):
    return prep.head(_labelled_rows(spark, sf_dir), 500).select("row_ord", "next")


@query
def positional_split(spark, sf_dir):
    first, rest = prep.positional_split(_labelled_rows(spark, sf_dir), 0.8)
    part = lambda rows, name: rows.select("row_ord", F.lit(name).alias("part"))
    return part(first, "first").unionByName(part(rest, "rest"))


@query
def dedup_first(spark, sf_dir):
    return prep.dedup_first(_labelled_rows(spark, sf_dir).select("row_ord", "prefix", "next"), ["prefix"]).select("row_ord", "prefix", "next")


@query
def activity_vocab(spark, sf_dir):
    return sequence.vocabulary(traces(spark, sf_dir))


def _anomalies(spark, sf_dir):
    return traces(spark, sf_dir).select(F.col("case_id").cast("bigint").alias("id"), "trace", F.when(F.size("trace") > 10, "False").otherwise("True").alias("ds_labels"))


@query
def oversample_label(spark, sf_dir):
    return prep.oversampled(_anomalies(spark, sf_dir), factor=2).select("id", joined("trace").alias("trace"), "ds_labels")


@query
def sample_label(spark, sf_dir):
    return prep.sampled(_anomalies(spark, sf_dir), 200, "id", label="ds_labels").select("id", "ds_labels")


@query
def column_stats(spark, sf_dir):
    out = prep.column_stats(logs.table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# ------------------------------------------------------------------ splits


def _daily_samples(spark, sf_dir):
    return logs.samples(logs.traces(logs.events_daily(spark, sf_dir))).withColumnRenamed("case_id", "group_id")


@query
def group_split_ids(spark, sf_dir):
    return splits.split_ids(_daily_samples(spark, sf_dir))


@query
def group_split_rows(spark, sf_dir):
    rows = _daily_samples(spark, sf_dir)
    return splits.split_rows(rows, splits.split_ids(rows)).select("group_id", "pos", "next", "split")


@query
def bucket_report(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumnRenamed("case_id", "group_id")
    return splits.bucket_report(splits.split_rows(rows, splits.split_ids(rows)))


@query
def trace_length_report(spark, sf_dir):
    traced = traces(spark, sf_dir).select(F.col("case_id").alias("group_id"), "trace", F.array_distinct("trace").alias("unique_activities"))
    return splits.bucket_report(splits.split_rows(traced, splits.split_ids(traced)), "trace_anomaly")


# ------------------------------------------------------------------ models


@query
def markov_model(spark, sf_dir):
    return sequence.markov_model(weighted(spark, sf_dir), min_count=2).select(joined("context").alias("context"), "next", "c", rounded("prob").alias("prob"))


@query
def prefix_tree_counts(spark, sf_dir):
    return sequence.prefix_counts(weighted(spark, sf_dir)).select(joined("prefix").alias("prefix"), "next", "c")


@query
def prefix_tree_topk(spark, sf_dir):
    variants = weighted(spark, sf_dir)
    tops = trie.named(sequence.prefix_topk(sequence.prefix_nodes(variants), 3), variants)
    return tops.select(joined("prefix").alias("prefix"), "next", "c", rounded("prob").alias("prob"))


@query
def markov_backoff(spark, sf_dir):
    model = sequence.packed(sequence.markov_model(weighted(spark, sf_dir), min_count=3), "context")
    out = sequence.markov_backoff(prefixes(spark, sf_dir), model)
    return out.select(joined("prefix").alias("prefix"), F.explode("markov").alias("next", "p")).select("prefix", "next", rounded("p").alias("prob"))


@query
def markov_backoff_5(spark, sf_dir):
    """Five suffix lengths at once: names dealt out and folded back, as for a model that is too large to broadcast."""
    model = sequence.packed(sequence.markov_model(weighted(spark, sf_dir), order=5, min_count=3), "context")
    out = sequence.markov_backoff(prefixes(spark, sf_dir), model, order=5, broadcast_bytes=0)
    return out.select(joined("prefix").alias("prefix"), F.explode("markov").alias("next", "p")).select("prefix", "next", rounded("p").alias("prob"))


@query
def dfg_edges(spark, sf_dir):
    return graph.edges(weighted(spark, sf_dir), 2, 0.05).select("src", "dst", "cnt", rounded("prob").alias("prob"))


@query
def dfg_lookup(spark, sf_dir):
    found = graph.edges(weighted(spark, sf_dir), min_ratio=0.2)
    asked = samples(spark, sf_dir).select("case_id", "pos", F.when(F.col("pos") % 6 != 0, parsing.last("prefix")).alias("a"), F.col("next").alias("b"))
    return graph.edge_lookup(asked, found).select("case_id", "pos", rounded("prob").alias("prob"), "allowed")


@query
def dfg_outgoing(spark, sf_dir):
    packed = graph.outgoing(graph.edges(weighted(spark, sf_dir)))
    return packed.select("src", F.explode("out").alias("dst", "p")).select("src", "dst", rounded("p").alias("prob"))


@query
def activity_prior(spark, sf_dir):
    return priors.activity_prior(samples(spark, sf_dir)).select("activity", rounded("w").alias("w"))


@query
def pair_prior(spark, sf_dir):
    return priors.pair_prior(samples(spark, sf_dir), 3).select("prev", "next", "c", rounded("w").alias("w"))


@query
def guard_pairs_labelled(spark, sf_dir):
    return guard.labelled_pairs(labelled(spark, sf_dir))


@query
def guard_pairs_invariants(spark, sf_dir):
    return guard.pairs_of(invariants(spark, sf_dir))


@query
def guard_allowed_pairs(spark, sf_dir):
    config = GuardConfig(min_count=2, min_ratio=0.1, threshold=0.45)
    return guard.allowed(guard.labelled_pairs(labelled(spark, sf_dir)), config).select("prev", "next", rounded("score").alias("score"), "prev_total")


@query
def guard_check(spark, sf_dir):
    valid = guard.allowed(guard.labelled_pairs(labelled(spark, sf_dir)))
    asked = samples(spark, sf_dir).select("case_id", "pos", F.when(F.col("pos") % 6 != 0, parsing.last("prefix")).alias("prev"), F.col("next").alias("cand"))
    return guard.check(asked, valid, keep_unseen=False).select("case_id", "pos", "ok")


# ------------------------------------------------------------------ retrieval


def _memory(spark, sf_dir, traced=None):
    rows = parsing.resolve_columns(raw_instructions(spark, sf_dir, traced), "unique_activities", "prefix", "next", "model_id", "revision_id")
    rows = parsing.with_lists(rows.withColumn("ex_id", F.col("row_ord")), "prefix", "unique_activities")
    return memory.example_memory(rows, min_prefix_len=2)


@query
def example_memory(spark, sf_dir):
    return _memory(spark, sf_dir).select("ex_id", "instruction", "output", joined("prefix").alias("prefix"), "next", joined("unique_activities").alias("activities"), "model_id", "revision_id")


@query
def prefix_similarity(spark, sf_dir):
    """The prefixes of the cases whose id is divisible by 50, of any length, with all prefixes."""
    asked = samples(spark, sf_dir).filter(F.col("case_id").cast("bigint") % 50 == 0).select("prefix").distinct()
    return memory.prefix_pairs(asked, prefixes(spark, sf_dir), joined, 9)


def _asked(spark, sf_dir, traced=None):
    """Every sample; case_id names the case and the place in it."""
    return samples(spark, sf_dir, traced).select(F.concat_ws(":", "case_id", "pos").alias("case_id"), "prefix", F.col("case_id").alias("model_id"))


def _case_and_pos():
    return F.substring_index("case_id", ":", 1).alias("case_id"), F.substring_index("case_id", ":", -1).cast("int").alias("pos")


@query
def fewshot_topk(spark, sf_dir):
    traced = stored(traces(spark, sf_dir), "traces")
    tops = memory.top_examples(_asked(spark, sf_dir, traced), _memory(spark, sf_dir, traced))
    return tops.select(*_case_and_pos(), "place", "ex_id", rounded("score").alias("score"))


@query
def fewshot_prompts(spark, sf_dir):
    traced = stored(traces(spark, sf_dir), "traces")
    rows = memory.shots(_asked(spark, sf_dir, traced), _memory(spark, sf_dir, traced), 2)
    rows = rows.withColumn("prompt", text.prediction_prompt("prefix", F.array_sort(F.array_distinct("prefix"))))
    return rows.select(*_case_and_pos(), F.md5(text.fewshot_prompt("prompt", "shots")).alias("prompt_md5"), F.length(text.fewshot_prompt("prompt", "shots")).alias("length"))


@query
def example_memory_sample(spark, sf_dir):
    """The memory cut to a number of examples, as its users may ask."""
    rows = parsing.resolve_columns(raw_instructions(spark, sf_dir), "unique_activities", "prefix", "next", "model_id", "revision_id")
    rows = parsing.with_lists(rows.withColumn("ex_id", F.col("row_ord")), "prefix", "unique_activities")
    return memory.example_memory(rows, min_prefix_len=2, max_examples=200).select("ex_id", "next", joined("prefix").alias("prefix"))


# ------------------------------------------------------------------ scoring


@query
def ensemble_topk(spark, sf_dir):
    return exploded(candidates(spark, sf_dir))


def _reranked(spark, sf_dir, config):
    found = graph.outgoing(graph.edges(weighted(spark, sf_dir)))
    rows = graph.with_outgoing(candidates(spark, sf_dir), found)
    moved, dropped, _ = graph.rerank("cands", "out", config)
    return rows.select("prefix", F.size(dropped).alias("n_dropped"), moved.alias("cands"))


@query
def dfg_rerank_soft(spark, sf_dir):
    return exploded(_reranked(spark, sf_dir, RerankConfig()), "cands", "n_dropped")


@query
def dfg_rerank_hard(spark, sf_dir):
    return exploded(_reranked(spark, sf_dir, RerankConfig(True, 1.0, 0.2)), "cands", "n_dropped")


@query
def graph_priors_reweight(spark, sf_dir):
    found = graph.outgoing(graph.edges(weighted(spark, sf_dir), min_ratio=0.2))
    rows = graph.with_outgoing(candidates(spark, sf_dir), found)
    moved, _, triggered = graph.prior_reweight("cands", "out", "prev")
    return exploded(rows.select("prefix", triggered.alias("triggered"), moved.alias("cands")), "cands", "triggered")


def _mixed(spark, sf_dir, config, provided=None):
    rows = priors.with_pairs(candidates(spark, sf_dir), priors.packed_pairs(priors.pair_prior(samples(spark, sf_dir))))
    rows = priors.with_activity_map(rows, priors.activity_prior(samples(spark, sf_dir)))
    if provided is not None:
        rows, provided = rows.withColumn("given", provided), "given"
    return exploded(rows.select("prefix", priors.mix("cands", config, "dests", "acts", provided).alias("cands")))


WIDE = {"floor": 0.0, "lambda_mix": 0.4, "default_weight": 0.1}


@query
def prior_mix_pair(spark, sf_dir):
    return _mixed(spark, sf_dir, PriorConfig("pair", **WIDE))


@query
def prior_mix_activity(spark, sf_dir):
    return _mixed(spark, sf_dir, PriorConfig("activity", **WIDE))


@query
def prior_mix_hybrid(spark, sf_dir):
    return _mixed(spark, sf_dir, PriorConfig("hybrid", **WIDE))


def _length_weights(prefix: list[str]) -> dict[str, float]:
    """A user's provider: odd prefixes weigh their own activities by how often they occur."""
    return {a: float(prefix.count(a)) for a in prefix} if len(prefix) % 2 else {}


@query
def prior_mix_provider(spark, sf_dir):
    return _mixed(spark, sf_dir, PriorConfig("pair", **WIDE), priors.provider(_length_weights)("prefix"))


def _failing_weights(prefix: list[str]) -> dict[str, float]:
    """As above, but it raises for prefixes of a length divisible by 3 and gives no number for those of 5."""
    if len(prefix) % 3 == 0:
        raise RuntimeError("no answer")
    return {a: "unknown" for a in prefix} if len(prefix) % 5 == 0 else _length_weights(prefix)


@query
def prior_mix_failing_provider(spark, sf_dir):
    return _mixed(spark, sf_dir, PriorConfig("pair", **WIDE), priors.provider(_failing_weights)("prefix"))


def _guarded(spark, sf_dir, config):
    packed = guard.packed(guard.allowed(guard.labelled_pairs(labelled(spark, sf_dir)), config))
    rows = guard.with_followers(candidates(spark, sf_dir), packed)
    moved, blocked = guard.apply("cands", "followers", "prefix", config)
    return exploded(rows.select("prefix", F.size(blocked).alias("n_blocked"), moved.alias("cands")), "cands", "n_blocked")


@query
def guard_soft(spark, sf_dir):
    return _guarded(spark, sf_dir, STRICT)


@query
def guard_hard(spark, sf_dir):
    return _guarded(spark, sf_dir, GuardConfig(mode="hard", keep_unseen=False))


@query
def logprob_fusion(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("case_id", joined("prefix"))
    logprobs = rows.select("case_id", F.posexplode("cands").alias("rank", "c")).select("case_id", "rank", F.col("c.activity").alias("candidate"), (-F.pmod(F.length("case_id") * (F.col("rank") + 3), F.lit(17)) / 4).alias("logprob"))
    label, scores = fusion.fused("cands", "norm", 0.3)
    out = rows.join(fusion.logprob_maps(logprobs), "case_id", "left")
    return out.select(F.col("case_id").alias("prefix"), label.alias("label"), "best", rounded(F.array_max(scores)).alias("score"))


@query
def hybrid_predict(spark, sf_dir):
    out = predictions(spark, sf_dir)
    return out.select("case_id", "pos", "y_true", "y_pred", joined("ranked").alias("ranked"), rounded(F.get("cands", F.lit(0))["score"]).alias("top_score"), F.size("guard_blocked").alias("n_blocked"))


# ------------------------------------------------------------------ evaluation


def _record(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def eval_accuracy(spark, sf_dir):
    return _record(predictions(spark, sf_dir).agg(metrics.accuracy().alias("accuracy")))


@query
def eval_f1_by_label(spark, sf_dir):
    return _record(metrics.f1_by_label(predictions(spark, sf_dir)))


@query
def eval_macro_f1(spark, sf_dir):
    return _record(metrics.macro_f1(predictions(spark, sf_dir)))


@query
def eval_mrr_ndcg(spark, sf_dir):
    return _record(predictions(spark, sf_dir).agg(metrics.mrr().alias("mrr"), metrics.ndcg(5).alias("ndcg")))


@query
def eval_at_k(spark, sf_dir):
    return _record(metrics.at_k(predictions(spark, sf_dir), (1, 3, 5)))


@query
def latency_stats(spark, sf_dir):
    return _record(metrics.latency_stats(logs.table(spark, sf_dir, "orders"), "o_totalprice"))


@query
def cpr(spark, sf_dir):
    orders = logs.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("metric"), *metrics.latency_columns("o_totalprice"))
    return _record(orders.select(F.col("o_orderpriority").alias("model"), metrics.cost_performance(F.col("metric"), F.col("avg_ms")).alias("cpr")))


@query
def cpr_by_model(spark, sf_dir):
    orders = logs.table(spark, sf_dir, "orders")
    costs = orders.groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("latency"), F.count("*").cast("double").alias("memory"))
    scores = orders.filter("o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("performance"))
    return _record(metrics.cpr_by_model(costs, scores))


@query
def token_overlap(spark, sf_dir):
    return _record(metrics.token_overlap(explanations(spark, sf_dir)))


def _double_predictions(spark, sf_dir):
    return logs.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.col("quality").cast("string").alias("y_pred_no_explain"), F.col("toxic").cast("string").alias("y_pred_with_explain"))


@query
def consistency(spark, sf_dir):
    return _record(metrics.consistency(_double_predictions(spark, sf_dir)))


@query
def explain_summary(spark, sf_dir):
    return _record(metrics.explain_summary(explanations(spark, sf_dir), _double_predictions(spark, sf_dir)))


@query
def eval_report(spark, sf_dir):
    return _record(metrics.report(predictions(spark, sf_dir)))
