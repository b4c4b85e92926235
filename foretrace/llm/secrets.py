"""Secret scans: regular expressions, and a randomness test battery over other tokens.

Base spans are the leftmost non-overlapping matches of each kind (the whole match) that pass its test.
Other tokens of ``MIN_LENGTH`` or more characters of an encoding's alphabet are candidates. For each:

1. The encoding is inferred as the smallest of hex, base32, base58/62 and base64 alphabets that fits, from
   mixed evidence (letters and digits both occur).
2. Three tests of the whole token take "drawn evenly and independently from the alphabet" as their null:
   chi-squared over character groups of equal size, runs above and below the alphabet's middle, and lag-1 serial
   correlation. Fisher's method combines them to one score, which is small for ordinary text.
3. What is controlled are false secrets, so the null of the decision is "ordinary text of this encoding". The corpus
   itself gives its distribution: the characters of every text that an encoding has (for base64, blanks count as its
   last one, as marks join words in paths) are cut into windows of the lengths in ``LENGTHS``, scored like tokens. Each text is cut by itself, in an order of lengths that its own characters choose,
   so the windows depend neither on batches and partitions nor on other rows. A token's p-value is the share of the
   windows of its encoding and length class that look as random as it does, or more so; a class without windows (no
   text is that long) takes those of the next shorter one, which look more random and so find less.
4. Within each stratum of encoding and length class, Benjamini-Hochberg picks the candidates that are no ordinary
   text at false-discovery rate ``RATE``; these are spans of kind random. An encoding without windows gives none.

The values of base spans are scored too: ``judged`` has, for each base span in order, its value's encoding, p-value
and whether it is found to be no ordinary text by the same control over candidates and base values together
(null for values that are short, or of no encoding).

Scores enter the control as counts of a fixed grid per stratum, at most a few thousand numbers however large the
corpus is. Scanning keeps no text; the spans and candidates are written once and joined with the limits,
which are broadcast.

Offsets count code points, ends are exclusive. Edge cases: null and empty texts have no spans; repeated rows
get equal spans; empty tables give no rows; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.llm.common import column, fresh, stored, without

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Runs that pass, whole: a shorter run fails from each of its places.
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

#: '=' may stand before a token (NAME=value) and pads its end.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
MIN_LENGTH = 20
RATE, GRID = 0.01, 400
#: Length classes by their least length, which is that of the class's windows of ordinary text.
LENGTHS = (20, 28, 40, 56, 80, 112, 160)
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_ENCODINGS = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in _ALPHABETS]
#: The alphabets by which ordinary text is scored: one for each name, in upper case for base32.
_FAMILIES = [(name, chars) for k, (name, chars) in enumerate(_ALPHABETS) if k in (0, 2, 3, 4)]
_ADDED = ("base_spans", "judged", "all_spans")
_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_OPEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("cell", pa.int32())])
_CELLS = pa.struct([("stratum", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) by start, then by kind as listed."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE] if "=" in text or ":" in text else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def base_values(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """The part of each base span that would be the secret."""
    return [ASSIGN.match(text, a)[2] if rank == 0 else text[a:b] for a, rank, b in base]


def encoding(token: str) -> tuple[str, np.ndarray, int] | None:
    """Name, symbol numbers and alphabet size of the smallest fitting encoding; None for plain words or numbers."""
    body = token.rstrip("=")
    used = set(body)
    if not any(c.isdigit() for c in used) or not any(c.isalpha() for c in used):
        return None
    for name, alphabet in _ENCODINGS:
        if used <= alphabet.keys():
            return name, np.array([alphabet[c] for c in body]), len(alphabet)
    return None


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail for z >= 0 (a rational approximation, off by 1.5e-7 at most; the lead term far out); 1 - that below 0."""
    x = np.abs(np.asarray(z, float)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    near = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    far = 0.5 * np.exp(-x * x) / (np.maximum(x, 1) * math.sqrt(math.pi))
    tail = np.where(x < 3, near, np.minimum(near, far))
    return np.where(np.asarray(z) >= 0, tail, 1 - tail)


def chi_squared_tail(x: np.ndarray, degrees: int) -> np.ndarray:
    """Upper tail; exact for even degrees, Wilson-Hilferty otherwise."""
    x = np.asarray(x, float)
    if degrees % 2 == 0:
        term = np.exp(-x / 2)
        total = term.copy()
        for k in range(1, degrees // 2):
            term = term * (x / 2 / k)
            total += term
        return np.minimum(1.0, total)
    third = 2 / (9 * degrees)
    return normal_tail((np.cbrt(x / degrees) - 1 + third) / math.sqrt(third))


def randomness(symbols: np.ndarray, size: int) -> np.ndarray:
    """Combined p-value of uniformity, runs and serial correlation under even, independent draws, of each row of symbol
    numbers below ``size``."""
    m, n = symbols.shape
    groups = max(2, min(8, n // 5))
    which = (np.arange(size) * groups // size).astype(np.uint8)
    share = np.bincount(which, minlength=groups) / size
    dealt = which[symbols]
    uniform = np.zeros(m)
    for g in range(groups):
        uniform += ((dealt == g).sum(axis=1) - n * share[g]) ** 2 / (n * share[g])
    above = symbols >= size // 2
    up = above.sum(axis=1).astype(float)
    mean = 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    changes = (above[:, 1:] != above[:, :-1]).sum(axis=1) + 1
    runs = 2 * normal_tail(np.abs(changes - mean) / np.sqrt(np.where(spread > 0, spread, 1)))
    runs = np.where(up * (n - up) == 0, 2.0 ** (1 - min(n, 1000)), np.where(spread > 0, runs, 1.0))
    x = symbols.astype(np.float32)
    x -= x.mean(axis=1, keepdims=True)
    power = np.einsum("ij,ij->i", x, x, dtype=float)
    lagged = np.einsum("ij,ij->i", x[:, 1:], x[:, :-1], dtype=float)
    serial = 2 * normal_tail(np.abs(lagged / np.where(power > 0, power, 1) * math.sqrt(n) + 1 / math.sqrt(n)))
    serial = np.where(power > 0, serial, 0.0)
    least = lambda p: np.log(np.clip(p, 1e-300, 1.0))
    return chi_squared_tail(-2 * (least(chi_squared_tail(uniform, groups - 1)) + least(runs) + least(serial)), 6)


def cells_of(p: np.ndarray) -> np.ndarray:
    """Places of scores on the grid: quarter steps of the natural logarithm, 0 for the most random."""
    return np.minimum(GRID - 1, (-4 * np.log(np.maximum(p, 1e-300))).astype(np.int64))


def placed(token: str) -> tuple[str, int] | None:
    """Stratum and cell of a token; None if it is short or of no encoding."""
    if (found := encoding(token)) is None or len(found[1]) < MIN_LENGTH:
        return None
    name, symbols, size = found
    length = max(n for n in LENGTHS if n <= len(symbols))
    return f"{name}/{length}", int(cells_of(randomness(symbols[None], size))[0])


def open_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, stratum, cell) of candidates that overlap no base span."""
    out = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if not any(b[0] < end and start < b[2] for b in base) and (found := placed(m[0])) is not None:
            out.append((start, end, *found))
    return out


class Ordinary:
    """Counts of (stratum, cell) over windows of the texts' own characters."""

    _numbers: list[np.ndarray] = []
    for _name, _chars in _FAMILIES:
        _number = np.full(256, 255, np.uint8)
        for _i, _c in enumerate(_chars):
            _number[ord(_c)] = _i
            if _name == "base32":
                _number[ord(_c.lower())] = _i
        if _name == "base64":  # in paths and names the mark stands between words
            _number[ord(" ")] = _i
        _numbers.append(_number)

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.windows: dict[tuple[int, int], list[np.ndarray]] = {}

    def add(self, text: str, base: list[tuple[int, int, int]]) -> None:
        """The text but for its base spans and candidates' tokens, which may be secrets."""
        spans, last, pieces = sorted([(a, b) for a, _, b in base] + [m.span() for m in TOKEN.finditer(text) if encoding(m[0])]), 0, []
        for a, b in spans:
            pieces.append(text[last : max(a, last)])
            last = max(b, last)
        data = np.frombuffer("".join([*pieces, text[last:]]).encode(), np.uint8)
        for family, number in enumerate(self._numbers):
            symbols = number[data]
            self._cut(family, symbols[symbols != 255])

    def _cut(self, family: int, symbols: np.ndarray) -> None:
        """Windows of all lengths in turn; of what is left, those that fit, from a length on that its hash chooses."""
        total = sum(LENGTHS)
        whole = len(symbols) // total * total
        rows, at = symbols[:whole].reshape(-1, total), 0
        for length in LENGTHS if whole else ():
            self.windows.setdefault((family, length), []).append(rows[:, at : at + length])
            at += length
        rest = symbols[whole:]
        first = zlib.crc32(rest.tobytes()) % len(LENGTHS)
        for length in [*LENGTHS[first::-1], *LENGTHS[:first:-1]]:
            if len(rest) >= length:
                self.windows.setdefault((family, length), []).append(rest[None, :length])
                rest = rest[length:]

    def close(self) -> list[dict]:
        """Score what was added and give the counts."""
        for (family, length), found in self.windows.items():
            name, chars = _FAMILIES[family]
            rows = np.concatenate(found)
            for k in range(0, len(rows), 20_000):
                cells, n = np.unique(cells_of(randomness(rows[k : k + 20_000], len(chars))), return_counts=True)
                self.counts.update({(f"{name}/{length}", c): k for c, k in zip(cells.tolist(), n.tolist(), strict=True)})
        out = [{"stratum": a, "cell": c, "n": n} for (a, c), n in self.counts.items()]
        self.__init__()
        return out


def p_values(ordinary: list[tuple[str, int, int]]) -> dict[str, list[float]]:
    """By stratum the p-value of each cell, from (stratum, cell, windows)."""
    counts: dict[str, np.ndarray] = {}
    for stratum, cell, n in ordinary:
        counts.setdefault(stratum, np.zeros(GRID))[cell] += n
    out = {stratum: ((1 + np.cumsum(c)) / (1 + c.sum())).tolist() for stratum, c in counts.items()}
    for name in {stratum.partition("/")[0] for stratum in out if "/" in stratum}:
        for shorter, length in zip(LENGTHS, LENGTHS[1:]):
            if f"{name}/{length}" not in out and f"{name}/{shorter}" in out:
                out[f"{name}/{length}"] = out[f"{name}/{shorter}"]
    return out


def limits(candidates: list[tuple[str, int, int]], p: dict[str, list[float]], rate: float = RATE) -> dict[str, int]:
    """By stratum the last cell whose tokens Benjamini-Hochberg finds to be no ordinary text; -1 for none."""
    out: dict[str, int] = dict.fromkeys(p, -1)
    by: dict[str, np.ndarray] = {}
    for stratum, cell, n in candidates:
        by.setdefault(stratum, np.zeros(GRID))[cell] += n
    for stratum, c in by.items():
        if stratum in p:
            found = np.flatnonzero((c > 0) & (np.array(p[stratum]) <= rate * np.cumsum(c) / c.sum()))
            out[stratum] = int(found[-1]) if len(found) else -1
    return out


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with base_spans and all_spans: array<struct<start, rank, end>>,
    where rank counts in KINDS; by start, then by rank; and judged, array<struct<encoding, p, random>>."""
    names = without(docs.select(*map(column, docs.columns if keep is None else keep)), _ADDED).columns
    own = fresh(docs, "text", "open", "values", "ordinary")
    source = docs.select(*map(column, names), column(text).cast("string").alias(own["text"]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = Ordinary()
        for batch in batches:
            bases, opens, values = [], [], []
            for value in batch.column(batch.num_columns - 1):
                found = value.as_py() or ""
                base = base_spans(found)
                bases.append([dict(zip(("start", "rank", "end"), s, strict=True)) for s in base])
                opens.append([dict(zip(("start", "end", "stratum", "cell"), s, strict=True)) for s in open_tokens(found, base)])
                values.append([place and {"stratum": place[0], "cell": place[1], "n": 1} for place in map(placed, base_values(found, base))])
                ordinary.add(found, base)
            seen = [ordinary.close()] + [None] * (batch.num_rows - 1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bases, pa.list_(_SPAN)), pa.array(opens, pa.list_(_OPEN)), pa.array(values, pa.list_(_CELLS)), pa.array(seen, pa.list_(_CELLS))], schema.names)

    cells = "array<struct<stratum:string,cell:int,n:bigint>>"
    added = T._parse_datatype_string(f"base_spans array<struct<start:int,rank:int,end:int>>, {own['open']} array<struct<start:int,end:int,stratum:string,cell:int>>, {own['values']} {cells}, {own['ordinary']} {cells}").fields
    schema = T.StructType(source.schema.fields[:-1] + added)
    marked = stored(source.mapInArrow(scan, schema), "secrets")
    counted = lambda name, n: [tuple(r) for r in marked.select(F.explode(name).alias("o")).groupBy("o.stratum", "o.cell").agg(n.alias("n")).collect()]
    p = p_values(counted(own["ordinary"], F.sum("o.n")))
    candidates, values = counted(own["open"], F.count("*")), counted(own["values"], F.sum("o.n"))
    limit, joint = limits(candidates, p), limits(candidates + [v for v in values if v[0] is not None], p)
    table = lambda values, kind: F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.lit(None).cast(f"map<string,{kind}>")
    most, found_at, shares = table(limit, "int"), table(joint, "int"), table({k: F.array(*map(F.lit, v)) for k, v in p.items()}, "array<double>")
    random = KINDS.index("random")
    secret = F.filter(own["open"], lambda o: o["cell"] <= F.coalesce(most[o["stratum"]], F.lit(-1)))
    extra = F.transform(secret, lambda o: F.struct(o["start"].alias("start"), F.lit(random).alias("rank"), o["end"].alias("end")))
    judged = F.transform(own["values"], lambda v: F.when(v.isNotNull(), F.struct(F.substring_index(v["stratum"], "/", 1).alias("encoding"), F.get(shares[v["stratum"]], v["cell"]).alias("p"), (v["cell"] <= F.coalesce(found_at[v["stratum"]], F.lit(-1))).alias("random"))))
    return marked.withColumns({"judged": judged, "all_spans": F.array_sort(F.concat("base_spans", extra))}).select(*map(column, names), *_ADDED)


def _joined(spans: str):
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    found = find(documents, keep=["doc_id"])
    counts = [F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:3])]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))
