"""Personal data by regular expressions and bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test (see PATTERNS).
They seed the bootstrap:

1. Base spans are instances of known kind. Open instances are all other tokens with a digit or an "@" of
   ``LEAST`` characters or more, and runs of digits with separators (see OPEN), whatever identifier they may be.
2. An instance has up to three lexical patterns: the word before it on its line, the two words before it, and the
   words before and after it; case folded, digits as 0, from ``CONTEXT`` characters on each side.
3. Spark scores the pattern-instance graph in rounds. A pattern needs at least ``SUPPORT`` different base values of a
   kind; its confidence for the kind is the share of known values among all its instances, open ones included, where
   a base value counts in full and one found earlier by the confidence it was found with. Patterns of ``FLOOR`` or
   more are evidence: an open value's confidence combines theirs as independent, 1 - product of (1 - c), so that no
   number of weak patterns makes a value known. Values of at least ``ACCEPT`` become known, of their best kind, and
   keep that confidence. Rounds go on until no value becomes known any more: known values only grow, so they end.
4. Open instances of known values that stand in a pattern of confidence ``ACCEPT`` or more for their kind become spans.

So a pattern bounds what it finds by what else stands in it: "call me at" followed by other tokens as often as by
numbers finds nothing. Instances are summed by (pattern, value) before the shuffle and joined by pattern and by value;
nothing is collected but a count a round, and no text takes part in the rounds. A base span is never changed,
and an added span never overlaps one.

Offsets count code points, ends are exclusive. Edge cases: null and empty texts have no spans; repeated rows
get equal spans and count as evidence as often as they occur; empty tables give no rows; input columns named
like an added one are replaced by ``find``, and kept by ``redacted``, which adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import column, discard, fresh, stored, without

KINDS = ("email", "ip", "card", "phone")
#: Forms of the patterns that need no backtracking, with the same matches that pass: after each repeated class
#: comes a character outside it, so giving back can never help; no match starts within a run that an earlier
#: start has failed on; a card's run of digits starts where no digit (and separator) precedes, and is taken whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Runs of digits with separators, or tokens with a digit or "@", between white space, quotes, brackets and marks.
_EDGE, _INSIDE = r"""(?<![^\s"'(<\[{=:;,|])""", r"""[^\s"'(<\[{=:;,|)>\]}]"""
OPEN = rf"""{_EDGE}(?:\+?+[0-9]++(?:[\x20().-]{{1,2}}+[0-9]++)++(?![\p{{L}}\p{{N}}@])|(?={_INSIDE}*[0-9@]){_INSIDE}*[\p{{L}}\p{{N}}])"""
LEAST, CONTEXT = 4, 80
SUPPORT, ACCEPT, FLOOR = 5, 0.9, 0.5
#: Long arrays grow by runs of so many, and texts are cut within windows of so many characters, so that the work is
#: not square in matches or characters.
RUN, WINDOW = 64, 1 << 16
BROADCAST_ROWS = 100_000
_ADDED = ("base_spans", "all_spans")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = F.aggregate(
        places,
        F.lit(0),
        lambda total, i: total + F.transform(F.array(F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)), lambda d: F.when(d > 9, d - 9).otherwise(d))[0],
    )
    return value % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(match)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


_SPAN = "start:int,end:int,value:string,before:string,after:string"
_FIRST_WORD = r"^[\x20\t]*+([^\s]++)"
_LAST_WORDS = r"(?<![^\s])((?:[^\s]++[\x20\t]++)?[^\s]++)[\x20\t]*+$"


def _gather(values: Column, state: dict[str, Column], element: str, step, finish=lambda s, out: out) -> Column:
    """Fold ``values`` in order with a state; step(state, value) gives (new state, an element or null)."""
    empty = F.array().cast(f"array<{element}>")
    start = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<array<{element}>>").alias("done"), empty.alias("run"))

    def merge(s: Column, value: Column) -> Column:
        new, item = step(s, value)
        run = F.when(item.isNull(), s["run"]).otherwise(F.concat(s["run"], F.array(item)))
        full = F.size(s["run"]) >= RUN
        return F.struct(*[new[k].alias(k) for k in state], F.when(full, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]).alias("done"), F.when(full, F.filter(F.array(item), lambda x: x.isNotNull())).otherwise(run).alias("run"))

    return F.aggregate(values, start, merge, lambda s: finish(s, F.flatten(F.concat(s["done"], F.array(s["run"])))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost non-overlapping matches, in order.

    What lies between matches is what splitting by the pattern leaves, so places are running sums of lengths. before and
    after are the two last words of the text between a match and the one ahead of it, and the first word of that
    to the next.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    gaps = F.zip_with(between, F.slice(between, 2, 1 << 30), lambda gap, after: F.struct(F.length(gap).alias("gap"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after")))
    pieces = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), g["after"].alias("after"), m.alias("m"))), lambda p: p["m"].isNotNull())

    def step(s: Column, p: Column) -> tuple[dict[str, Column], Column]:
        start = s["at"] + p["gap"]
        end = start + F.length(p["m"])
        return {"at": end}, F.struct(start.alias("start"), end.alias("end"), p["m"].alias("value"), F.regexp_extract(p["before"], _LAST_WORDS, 1).alias("before"), F.regexp_extract(p["after"], _FIRST_WORD, 1).alias("after"))

    return _gather(pieces, {"at": F.lit(0)}, f"struct<{_SPAN}>", step)


_RANKED = "array<struct<start:int,rank:int,end:int,value:string,before:string,after:string>>"


def _ranked(spans: Column, rank: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))


def base_spans(text: Column) -> Column:
    """All base spans with value and words around them, by start and then by kind as listed."""
    parts = []
    for rank, kind in enumerate(KINDS):
        good = F.filter(matches(text, PATTERNS[kind]), lambda s: passes(kind, s["value"]))
        parts.append(F.when(text.rlike(NEEDS[kind]), _ranked(good, F.lit(rank))).otherwise(F.array().cast(_RANKED)))
    return F.array_sort(F.concat(*parts))


def open_instances(text: Column, base: Column) -> Column:
    """Tokens that may be identifiers and overlap no base span, in the form of ``base_spans``, without a rank."""
    long = F.filter(matches(text, OPEN), lambda s: s["end"] - s["start"] >= LEAST)
    free = F.filter(_ranked(long, F.lit(None).cast("int")), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(text.rlike("[0-9@]"), free).otherwise(F.array().cast(_RANKED))


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of an instance between these words."""
    fold = lambda words: F.regexp_replace(F.lower(words), "[0-9]", "0")
    last = F.substring_index(F.regexp_replace(before, r"[\x20\t]+", " "), " ", -1)
    two = F.when(before.rlike(r"[\x20\t]"), F.concat(F.lit("2 "), fold(F.regexp_replace(before, r"[\x20\t]+", " "))))
    around = F.when(after != "", F.concat(F.lit("3 "), fold(last), F.lit(" "), fold(after)))
    return F.when(before != "", F.array_compact(F.array(F.concat(F.lit("1 "), fold(last)), two, around))).otherwise(F.array().cast("array<string>"))


def discovered(instances: DataFrame, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """The open instances that the bootstrap accepts: (rid, start, rank, end).

    instances: rid, start, rank (null for an open one), end, value, before, after.
    """
    named = instances.withColumns({"value": F.xxhash64("value"), "patterns": patterns(F.col("before"), F.col("after"))}).drop("before", "after")
    edges = named.select("rank", "value", F.explode("patterns").alias("pattern"))
    graph = stored(edges.groupBy("pattern", "rank", "value").agg(F.count("*").alias("weight")).withColumns({"base": F.col("rank").isNotNull(), "c": F.when(F.col("rank").isNotNull(), 1.0)}), "pii-graph")

    def confidence() -> DataFrame:
        """(pattern, kind, confidence) of the patterns with enough support."""
        total = graph.groupBy("pattern").agg(F.sum("weight").alias("total"), *[F.sum(F.when(F.col("rank") == k, F.col("weight") * F.col("c")).otherwise(0.0)).alias(f"w{k}") for k in range(len(KINDS))], *[F.count_if((F.col("rank") == k) & F.col("base")).alias(f"s{k}") for k in range(len(KINDS))])
        each = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"w{k}") / F.col("total")).alias("confidence"), F.col(f"s{k}").alias("support")) for k in range(len(KINDS))]), lambda x: x["support"] >= support)
        return total.select("pattern", F.inline(each)).select("pattern", "kind", "confidence")

    while True:
        evidence = confidence().filter(F.col("confidence") >= FLOOR)
        open_values = graph.filter("rank IS NULL").join(evidence, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("c")).filter(F.col("c") >= accept)
        best = open_values.groupBy("value").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"))).alias("best")).select("value", (-F.col("best.k")).alias("found"), F.col("best.c").alias("sure"))
        best = stored(best, "pii-found")
        if best.isEmpty():
            break
        last, graph = graph, stored(graph.join(best, "value", "left").select("pattern", F.coalesce("rank", "found").alias("rank"), "value", "weight", "base", F.coalesce("c", "sure").alias("c")), "pii-graph")
        discard(last)
        discard(best)
    sure = graph.filter("rank IS NOT NULL AND NOT base").join(confidence().filter(F.col("confidence") >= accept), "pattern").filter("rank = kind").select("value", "pattern", F.col("rank").alias("kind"))
    asked = named.filter("rank IS NULL").select("rid", "start", "end", "value", F.explode("patterns").alias("pattern"))
    return asked.join(sure, ["value", "pattern"]).select("rid", "start", F.col("kind").alias("rank"), "end").distinct()


_BARE = "array<struct<start:int,rank:int,end:int>>"


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with base_spans and all_spans: array<struct<start, rank, end>> where
    rank counts in KINDS; by start, then by rank."""
    kept = without(docs.select(*map(column, docs.columns if keep is None else keep)), _ADDED).columns
    return _found(docs, text, kept, *_ADDED)


def _found(docs: DataFrame, text: str, kept: list[str], base_name: str, all_name: str) -> DataFrame:
    own = fresh(docs.select(*map(column, kept)).withColumns({base_name: F.lit(0), all_name: F.lit(0)}), "rid", "text", "base", "open", "id", "added")
    value = F.coalesce(column(text).cast("string"), F.lit(""))
    source = docs.select(*map(column, kept), value.alias(own["text"])).withColumn(own["base"], base_spans(F.col(own["text"])))
    source = source.withColumn(own["open"], open_instances(F.col(own["text"]), F.col(own["base"])))
    marked = stored(source.drop(own["text"]).withColumn(own["rid"], F.monotonically_increasing_id()), "pii-spans")
    exploded = lambda spans: marked.select(F.col(own["rid"]).alias("rid"), F.inline(spans))
    added = discovered(exploded(own["base"]).unionByName(exploded(own["open"])))
    added = stored(added.groupBy(F.col("rid").alias(own["id"])).agg(F.collect_list(F.struct("start", "rank", "end")).alias(own["added"])), "pii-added")
    if added.count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    base = F.transform(own["base"], lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    out = marked.join(added, F.col(own["rid"]) == F.col(own["id"]), "left").withColumn(base_name, base)
    return out.withColumn(all_name, F.array_sort(F.concat(base_name, F.coalesce(own["added"], F.array().cast(_BARE))))).select(*map(column, kept), base_name, all_name)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    own = fresh(docs, "base", "spans")
    found = _found(docs, text, docs.columns, own["base"], own["spans"])
    whole, spans = column(text), F.col(own["spans"])

    def step(s: Column, span: Column) -> tuple[dict[str, Column], Column]:
        """State: end of the spans so far, and a window of the text from ``from`` on."""
        name = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), span["rank"] + 1)
        inside = span["end"] - s["from"] <= WINDOW
        between = F.when(inside, F.substring(s["window"], s["at"] - s["from"] + 1, span["start"] - s["at"])).otherwise(F.substring(whole, s["at"] + 1, span["start"] - s["at"]))
        end = F.greatest(s["at"], span["end"])
        state = {"at": end, "from": F.when(inside, s["from"]).otherwise(end), "window": F.when(inside, s["window"]).otherwise(F.substring(whole, end + 1, F.lit(WINDOW)))}
        return state, F.when(span["start"] >= s["at"], F.concat(between, name))

    state = {"at": F.lit(0), "from": F.lit(0), "window": F.substring(whole, 1, WINDOW)}
    fixed = _gather(spans, state, "string", step, lambda s, out: F.concat(F.array_join(out, ""), F.substring(whole, s["at"] + 1, F.length(whole))))
    return found.withColumn(text, F.when(F.size(spans) > 0, fixed).otherwise(whole)).select(*map(column, docs.columns))


def _joined(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    found = find(documents, keep=["doc_id"])
    counts = [F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))
