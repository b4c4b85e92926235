"""Parsing of list-like text cells, end tokens, ids and buckets, as Column functions.

Literals of plain elements (texts without escapes, whole numbers, True, False, None) are scanned by column functions.
Only what these refuse needs Python: ``literal_lists`` and ``literal_pairs`` are Arrow UDFs that no other cell reaches.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that mark the end of a trace, and the accepted names of each logical column.
END_TOKENS = ("[END]", "END", "<END>", "None", "")
COLUMN_SYNONYMS = {
    "unique_activities": ("unique_activities", "activities", "set_of_activities", "activity_set"),
    "activities": ("activities", "unique_activities", "set_of_activities", "activity_set"),
    "prefix": ("prefix", "partial_trace", "sequence", "seq", "history"),
    "next": ("next", "gold_answer", "next_activity", "target", "label_next"),
    "trace": ("trace", "execution", "full_trace"),
    "label": ("label", "ds_labels", "y", "is_anomaly", "valid"),
    "act1": ("act1", "a1", "src", "from", "first_activity"),
    "act2": ("act2", "a2", "dst", "to", "second_activity"),
    "pairs": ("pairs", "dfg_pairs", "directly_follows", "direct_pairs", "eventually_follows"),
    "model_id": ("model_id", "process_id", "domain_id"),
    "revision_id": ("revision_id", "rev_id", "split_rev"),
    "instruction": ("instruction",),
    "output": ("output",),
}
_WHITE = r"(?U)^\s+|\s+$"


def col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends; most texts have none there and are left as they are."""
    text = col(text)
    white = F.substring(text, 1, 1).rlike(r"(?U)\s") | F.substring(text, -1, 1).rlike(r"(?U)\s")
    return F.when(white, F.regexp_replace(text, _WHITE, "")).otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_lists(text: pd.Series) -> pd.Series:
    """Elements of a Python list or tuple literal as text; null where the cell is none."""

    def parse(cell: str | None):
        try:
            value = ast.literal_eval(cell) if cell is not None else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [str(x) for x in value] if isinstance(value, (list, tuple)) else None

    return text.map(parse)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])))
def literal_pairs(text: pd.Series) -> pd.Series:
    """Pairs of a Python literal: 2-tuples and 2-lists, 'a->b' and 'a,b' texts; other elements are dropped."""

    def parse(cell: str | None):
        try:
            value = ast.literal_eval(cell) if cell is not None else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if not isinstance(value, (list, tuple)):
            return None
        out = []
        for item in value:
            if isinstance(item, (list, tuple)):
                parts = [str(x) for x in item] if len(item) == 2 else []
            else:
                mark = next((m for m in ("->", ",") if m in str(item)), None)
                parts = [p.strip() for p in str(item).split(mark, 1)] if mark else []
            if parts:
                out.append({"src": parts[0], "dst": parts[1]})
        return out

    return text.map(parse)


def split_list(text: Column | str, separator: str = ",") -> Column:
    """Trimmed non-blank parts; an empty array for null."""
    quoted = "\\Q" + separator + "\\E"
    return F.coalesce(F.filter(F.transform(F.split(col(text), quoted), strip), lambda t: F.length(t) > 0), F.array().cast("array<string>"))


def _is_literal(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(r"^[\[(]"), F.lit(False))


#: A literal's tokens: quoted texts without escapes or line breaks, whole numbers, names, marks, blanks, any other sign.
_TOKEN = r"""(?s)'[^'\\\n\r\x00]*'|"[^"\\\n\r\x00]*"|-?[1-9][0-9]*|0|True|False|None|[\[\](),]|[ \t\n]+|."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scanned(text: Column) -> Column:
    """The tokens of a cell without blanks; signs that no plain literal has are tokens of one character."""
    return F.filter(F.regexp_extract_all(strip(text), F.lit(_TOKEN), 0), lambda t: ~F.substring(t, 1, 1).isin(" ", "\t", "\n"))


def _element(token: Column) -> Column:
    return (F.length(token) > 1) | token.between("0", "9")


def _named(token: Column) -> Column:
    return F.when(F.substring(token, 1, 1).isin("'", '"'), F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def _closed(tokens: Column) -> Column:
    first, last_one = F.get(tokens, F.lit(0)), F.element_at(tokens, -1)
    return (F.size(tokens) >= 2) & (((first == "[") & (last_one == "]")) | ((first == "(") & (last_one == ")") & ((F.size(tokens) != 3) | (F.get(tokens, F.lit(1)) == ","))))


def flat_list(text: Column | str) -> Column:
    """The elements of a list or tuple literal of plain elements; null for anything else."""

    def read(tokens: Column) -> Column:
        inner = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
        in_turn = F.transform(inner, lambda t, i: F.when(i % 2 == 0, _element(t)).otherwise(t == ","))
        return F.when(_closed(tokens) & F.forall(in_turn, lambda x: x), F.transform(F.filter(inner, lambda t, i: i % 2 == 0), _named))

    return _let(col(text), lambda cell: _let(_scanned(F.when(_is_literal(cell), cell)), read))


_PAIR = "struct<src:string,dst:string>"


def _cut_pair(item: Column) -> Column:
    """(src, dst) of 'a->b', else of 'a,b'; null for other texts."""
    halves = lambda mark: F.transform(F.split(item, mark, 2), strip)
    pair = lambda p: F.struct(p[0].alias("src"), p[1].alias("dst"))
    return F.when(item.contains("->"), pair(halves("->"))).when(item.contains(","), pair(halves(","))).cast(_PAIR)


def flat_pairs(text: Column | str) -> Column:
    """The pairs of a list or tuple literal whose elements are plain ones, or lists or tuples of these; null for else.

    One fold over the tokens holds what is open: 0 the outer list, 1 an inner one; and whether an element may come.
    """
    state = "struct<open:string,items:array<string>,pairs:array<struct<src:string,dst:string>>,due:boolean,bad:boolean>"

    def step(s: Column, t: Column) -> Column:
        inside, opens, closes = s["open"] != "", t.isin("[", "("), t.isin("]", ")")
        right = ((s["open"] == "[") & (t == "]")) | ((s["open"] == "(") & (t == ")") & ((F.size(s["items"]) != 1) | s["due"]))
        two = F.when(F.size(s["items"]) == 2, F.array(F.struct(s["items"][0].alias("src"), s["items"][1].alias("dst")))).otherwise(F.array().cast(f"array<{_PAIR}>"))
        cut = _cut_pair(_named(t))
        new = lambda is_open, items, pairs, due, bad: F.struct(is_open.alias("open"), items.alias("items"), pairs.alias("pairs"), due.alias("due"), bad.alias("bad")).cast(state)
        none = F.array().cast("array<string>")
        return (
            F.when(s["bad"], s)
            .when(t == ",", new(s["open"], s["items"], s["pairs"], F.lit(True), s["due"]))
            .when(opens, new(t, none, s["pairs"], F.lit(True), inside | ~s["due"]))
            .when(closes, new(F.lit(""), none, F.concat(s["pairs"], two), F.lit(False), ~inside | ~right))
            .when(inside, new(s["open"], F.concat(s["items"], F.array(_named(t))), s["pairs"], F.lit(False), ~s["due"] | ~_element(t)))
            .otherwise(new(s["open"], none, F.concat(s["pairs"], F.array_compact(F.array(cut))), F.lit(False), ~s["due"] | ~_element(t)))
        )

    def read(tokens: Column) -> Column:
        inner = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
        start = F.struct(F.lit("").alias("open"), F.array().alias("items"), F.array().alias("pairs"), F.lit(True).alias("due"), F.lit(False).alias("bad")).cast(state)
        # A lone comma is no literal; a bracketed single element without a comma is none in round ones.
        whole = _closed_nested(tokens)
        return F.when(whole, _let(F.aggregate(inner, start, step), lambda s: F.when(~s["bad"] & (s["open"] == ""), s["pairs"])))

    return _let(col(text), lambda cell: _let(_scanned(F.when(_is_literal(cell), cell)), read))


def _closed_nested(tokens: Column) -> Column:
    """As ``_closed``; a round bracket around other brackets is left to Python unless a comma ends or parts it."""
    first, last_one = F.get(tokens, F.lit(0)), F.element_at(tokens, -1)
    return _closed(tokens) & ((first == "[") | (F.element_at(tokens, -2).isin(",", "(")) | ~F.exists(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda t: t.isin("[", "(")) & (last_one == ")"))


def parse_list(text: Column | str, python: bool = True) -> Column:
    """A list cell: a Python literal if it starts like one and parses, else comma-separated. Without ``python`` literals
    that ``flat_list`` refuses are taken as separated text."""
    text = col(text)
    flat = flat_list(text)
    if not python:
        return F.coalesce(flat, split_list(text))
    refused = _is_literal(text) & flat.isNull()
    return F.coalesce(flat, F.when(refused, literal_lists(F.when(refused, strip(text)))), split_list(text))


def refused(text: Column | str) -> Column:
    """Whether a list cell needs Python."""
    return _is_literal(col(text)) & flat_list(text).isNull()


def with_lists(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with list cells parsed; one pass tells whether any cell needs Python, else the plan has none."""
    python = df.agg(F.bool_or(reduce(lambda a, b: a | b, [refused(n) for n in names]))).first()[0] or False
    return df.withColumns({n: parse_list(n, python) for n in names})


def parse_pairs(text: Column | str) -> Column:
    """A cell of pairs as array<struct<src,dst>>: 'a->b' (or 'a,b' within a literal's element), tuples."""
    text = col(text)
    flat = flat_pairs(text)
    needs = _is_literal(text) & flat.isNull()
    literal = F.when(needs, literal_pairs(F.when(needs, strip(text))))
    arrows = F.filter(split_list(text), lambda t: t.contains("->"))
    plain = F.transform(arrows, lambda t: F.struct(strip(F.split(t, "->", 2)[0]).alias("src"), strip(F.split(t, "->", 2)[1]).alias("dst")))
    return F.coalesce(flat, literal, plain)


def parse_prefix(text: Column | str, separator: str = ";") -> Column:
    return split_list(text, separator)


def drop_end_tokens(items: Column | str) -> Column:
    return F.filter(col(items), lambda t: t.isNotNull() & ~strip(t).isin(*END_TOKENS))


def pick(columns: list[str], key: str) -> str | None:
    """The first synonym of a logical column among ``columns``."""
    return next((c for c in COLUMN_SYNONYMS.get(key, ()) if c in columns), None)


def resolve_columns(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the columns found for ``keys`` under their logical names."""
    found = {pick(df.columns, k): k for k in keys if pick(df.columns, k) is not None}
    return df.withColumnsRenamed({c: k for c, k in found.items() if c != k})


def activity_hash(activities: Column | str) -> Column:
    """Ten hex digits that name a set of activities."""
    names = F.filter(F.transform(col(activities), strip), lambda t: F.length(t) > 0)
    return F.substring(F.md5(F.array_join(F.array_sort(F.array_distinct(names)), "|")), 1, 10)


def model_id(df: DataFrame, activities: str = "unique_activities") -> Column:
    found = pick(df.columns, "model_id")
    return F.col(found).cast("string") if found else activity_hash(activities)


def group_id(df: DataFrame, order: str = "row_ord") -> Column:
    """model_id and revision_id, or model_id, or the row's order column."""
    if {"model_id", "revision_id"} <= set(df.columns):
        return F.concat_ws("_", F.col("model_id").cast("string"), F.col("revision_id").cast("string"))
    return F.col("model_id" if "model_id" in df.columns else order).cast("string")


def pseudo_trace(prefix: Column | str, following: Column | str) -> Column:
    return F.concat(F.coalesce(col(prefix), F.array().cast("array<string>")), F.array(col(following)))


def last(prefix: Column | str) -> Column:
    """The last activity, null for an empty prefix."""
    prefix = col(prefix)
    return F.when(F.size(prefix) > 0, F.element_at(prefix, -1))


# Upper bounds and names of the size buckets.
PROCESS_SIZE = ((1, "≤1"), (4, "2–4"), (7, "5–7"), (10, "8–10"), (None, "≥11"))
PREFIX_LENGTH = ((2, "≤2"), (5, "3–5"), (8, "6–8"), (None, "≥9"))
TRACE_LENGTH = ((3, "≤3"), (7, "4–7"), (10, "8–10"), (None, "≥11"))


def bucket(size: Column, buckets: tuple) -> Column:
    *bounded, (_, rest) = buckets
    return reduce(lambda out, b: F.when(size <= b[0], b[1]).otherwise(out), reversed(bounded), F.lit(rest))
