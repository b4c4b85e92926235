"""Prompts, and post-processing of generated text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions.parsing import col, strip

# The prompt texts, lead words and limits.
PREDICTION_TEMPLATE = (
    "You are an advanced AI system specialized in solving process mining tasks.\n"
    "We have a partial execution trace of activities from a business process.\n"
    "From the provided CANDIDATE list, which single activity should come next?\n\n"
    "Candidate next activities (top-k): {candidates}\n"
    "So far executed (prefix): {prefix}\n\n"
    "Answer with exactly ONE activity name from the CANDIDATE list and nothing else.\n"
    "Answer:"
)
EXPLANATION_TEMPLATE = (
    "You are an advanced AI system specialized in solving process mining tasks.\n"
    "A model has predicted the next activity for an ongoing process execution.\n\n"
    "Candidate next activities (top-k): {candidates}\n"
    "So far executed (prefix): {prefix}\n"
    "Predicted next activity: {chosen_label}\n\n"
    "In at most 2 sentences, explain concisely why this prediction is reasonable "
    "given the process and the observed trace.\n"
    "Answer:"
)
FEWSHOT_INTRO = (
    "You are an advanced AI system specialized in solving process mining tasks.\n"
    "Below are some previously solved examples of predicting the next activity.\n\n"
)
FEWSHOT_OUTRO = "\nNow, given a NEW case, answer the question below.\n\n"
TEMPLATES = (
    ("snap_predict_strict_v1", "snap_predict", "snap_predict", PREDICTION_TEMPLATE),
    ("snap_explain_reasonable_v1", "snap_explain", "snap_explain", EXPLANATION_TEMPLATE),
)
EXPLANATION_LEADS = "answer|explanation|giải thích|giai thich"
LABEL_LEADS = "answer|next activity"
MAX_SENTENCES, MAX_CHARACTERS, MAX_REASONS = 2, 600, 3


def catalog(spark: SparkSession) -> DataFrame:
    """The prompt templates (id, task, variant_group, template) in order."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "place int, id string, task string, variant_group string, template string")


def first_template(templates: DataFrame, task: str | None = None, variant_group: str | None = None) -> DataFrame:
    """The first template of a task and group."""
    for name, value in (("task", task), ("variant_group", variant_group)):
        templates = templates if value is None else templates.filter(F.col(name) == value)
    return templates.orderBy("place").limit(1)


def tokens(text: Column | str) -> Column:
    """Lower-case Unicode words."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?U)(\w+)"), F.lit(1))


def sentences(text: Column | str) -> Column:
    """Parts after . ? ! and white space; none for an empty text."""
    text = col(text)
    return F.when(F.length(text) > 0, F.split(text, r"(?<=[.?!])\s+")).otherwise(F.array().cast("array<string>"))


def reason_pass(text: Column | str) -> Column:
    """Whether the text has one to three sentences."""
    count = F.size(F.filter(sentences(F.coalesce(col(text), F.lit(""))), lambda s: F.length(strip(s)) > 0))
    return count.between(1, MAX_REASONS)


def normalized_explanation(raw: Column | str, prompt: Column | str) -> Column:
    """The explanation in a raw output: without the echoed prompt and lead word, cut to two sentences."""
    raw, prompt = strip(F.coalesce(col(raw), F.lit(""))), col(prompt)
    bare = strip(F.when(raw.startswith(prompt), F.substring(raw, F.length(prompt) + 1, F.length(raw))).when(raw.contains(prompt), F.call_function("substring_index", raw, prompt, F.lit(-1))).otherwise(raw))
    led = strip(F.regexp_replace(bare, f"(?iu)^({EXPLANATION_LEADS}):", ""))
    kept = F.filter(F.transform(F.slice(sentences(led), 1, MAX_SENTENCES), strip), lambda s: F.length(s) > 0)
    return strip(F.substring(F.array_join(kept, " "), 1, MAX_CHARACTERS))


def parsed_label(raw: Column | str, candidates: Column | str) -> Column:
    """The candidate that a generated text names; the first candidate when it names none."""
    raw, candidates = strip(F.coalesce(col(raw), F.lit(""))), col(candidates)
    line = strip(F.regexp_replace(strip(F.split(raw, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")[0]), f"(?i)^({LABEL_LEADS}):", ""))
    clean = F.regexp_replace(F.regexp_replace(line, "^[ '\"]+|[ '\"]+$", ""), r"[.,;:\s]*[.,;:]\s*$", "")
    equal = F.filter(candidates, lambda c: F.lower(c) == F.lower(clean))
    inside = F.filter(candidates, lambda c: line.contains(c))
    named = F.when(F.length(clean) > 0, F.coalesce(F.get(equal, F.lit(0)), F.get(inside, F.lit(0))))
    return F.coalesce(named, F.get(candidates, F.lit(0)))


def _braces(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("{ "), F.array_join(items, ", "), F.lit(" }"))).otherwise("{ }")


def _path(prefix: Column) -> Column:
    return F.when(F.size(prefix) > 0, F.array_join(prefix, " -> ")).otherwise("<EMPTY_PREFIX>")


def rendered(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def prediction_prompt(prefix: Column | str, candidates: Column | str) -> Column:
    return rendered(PREDICTION_TEMPLATE, candidates=F.concat(F.lit("{ "), F.array_join(col(candidates), ", "), F.lit(" }")), prefix=_path(col(prefix)))


def explanation_prompt(prefix: Column | str, candidates: Column | str, chosen: Column | str) -> Column:
    return rendered(EXPLANATION_TEMPLATE, candidates=_braces(col(candidates)), prefix=_path(col(prefix)), chosen_label=col(chosen))


def fewshot_block(shots: Column | str) -> Column:
    """Numbered examples of an array<struct<instruction, output>>, blank ones skipped but counted."""
    numbered = F.transform(col(shots), lambda s, i: F.struct((i + 1).alias("i"), strip(s["instruction"]).alias("instruction"), strip(s["output"]).alias("output")))
    full = F.filter(numbered, lambda s: (F.length(s["instruction"]) > 0) & (F.length(s["output"]) > 0))
    return strip(F.array_join(F.transform(full, lambda s: F.concat(F.lit("Example "), s["i"].cast("string"), F.lit(":\n"), s["instruction"], F.lit("\nCorrect answer: "), s["output"], F.lit("\n"))), "\n"))


def fewshot_prompt(prompt: Column | str, shots: Column | str) -> Column:
    shots = F.coalesce(col(shots), F.array().cast("array<struct<instruction:string,output:string>>"))
    return F.when(F.size(shots) > 0, F.concat(F.lit(FEWSHOT_INTRO), fewshot_block(shots), F.lit(FEWSHOT_OUTRO), col(prompt))).otherwise(col(prompt))
