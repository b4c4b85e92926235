"""Removal of long strings that occur more than once, by threshold-bounded BWT intervals.

Texts are UTF-8 bytes; a byte goes when a ``length``-byte string covering it also starts anywhere else.

1. Every window of ``length`` bytes has an anchor: the least of the hashes of its GRAM-byte grams, the
   leftmost on ties. Equal windows have equal anchors at equal places, so windows need comparison only
   under equal anchors. Neighbouring windows share anchors: a text of n bytes gives about n / 85 rows,
   each standing for the run of window starts of one anchor and the bytes under them (its hull).
2. Rows whose anchor occurs once are dropped. Rows with equal hulls (64 bits of anchor and 64 of hull hash, both by
   multipliers that are drawn for the run) are repeats of each other as a whole.
3. The distinct hulls left under one anchor go, with the hulls of other anchors, to blocks of a few MB. A
   block's suffixes are sorted and its BWT is expanded backwards breadth first: step l visits the intervals
   of strings of l + 1 bytes and so finds the places where the common prefix is exactly l. The expansion begins
   with the strings of a sort key and stops at ``length``; neighbours without a value share at least that much. The hulls of an anchor with more
   than a block holds are halved by the place of the anchor in the windows: all equal windows of a half share
   the bytes before its least place and after its greatest, which deals them to smaller groups. At a single
   place a part is one window, and is counted.
4. The repeated runs of a document are joined to its text and cut out.

Counting, joining and cutting are shuffles with map-side sums or joins that split hot keys at run time.
A common passage costs one row a place, never a row a pair; neighbouring places of one anchor with equal hulls
(a run of one character) are one row with a count. Rows are numbered once, in a stored table.

Edge cases: null and empty texts have no bytes and lose none; texts under ``length`` bytes lose none;
repeated rows, whatever their ids, repeat each other and lose all bytes of their windows; bytes that
are cut within a character leave an invalid sequence in ``kept`` (binary), which is what is digested; input
columns named like an added one are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.llm.common import column, discard, fresh, give_back, stored, without

LENGTH, GRAM = 200, 32
CHUNK, BATCH_BYTES = 4 << 20, 64 << 10
BLOCK_BYTES, GROUP_BYTES = 1 << 20, 8 << 20
_POSITION = 24  # bits
KEY = 7  # values of 9 bits in a sort key
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_ADDED = ("n_bytes", "removed", "kept")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def keys() -> list[np.uint64]:
    """Multipliers of a run's hashes, drawn anew: no text can be made to collide."""
    return [np.uint64(x | 1) for x in np.frombuffer(os.urandom(64), np.uint64)]


def _block_hashes(data: np.ndarray, odd: list[np.uint64] = _ODD) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4 ... 128 bytes from each position on."""
    out = {1: _mixed((data.astype(np.uint64) + np.uint64(1)) * odd[0])}
    size = 1
    while size < 128:
        h = out[size]
        out[2 * size] = _mixed(h[:-size] * odd[size.bit_length() % 8] + h[size:])
        size *= 2
    return out


def anchors(texts: list[bytes], length: int = LENGTH, odd: list[np.uint64] = _ODD) -> tuple[np.ndarray, ...]:
    """Of each anchor: which text, gram hash, hull hash, first window start, hull bytes, and how many places one byte
    apart have the same; in order of place."""
    found, held, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), CHUNK):
            held.append((k, at, text[at : at + CHUNK + length - 1]))
            size += len(held[-1][2])
            if size >= BATCH_BYTES:
                found.append(_anchors(held, length, odd))
                held, size = [], 0
    if held:
        found.append(_anchors(held, length, odd))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(6))


def _anchors(pieces: list[tuple[int, int, bytes]], length: int, odd: list[np.uint64]) -> tuple[np.ndarray, ...]:
    """``anchors`` of pieces (text, place in it, bytes), hashed as one string of which no window may cross a border."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    hashes = _block_hashes(data, odd)
    grams = hashes[GRAM]
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(_POSITION) << np.uint64(_POSITION)) | place
    span, reach = length - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at_gram = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    # A window over a border, the first of which begins length - 1 bytes before it, ends the run before and is no run.
    new = np.r_[True, at_gram[1:] != at_gram[:-1]]
    borders = ends[:-1]
    new[borders] = True
    new[borders - length + 1] = True
    first = np.flatnonzero(new)
    piece = np.searchsorted(ends, first, side="right")
    last = np.r_[first[1:], len(at_gram)] - 1
    inside = first + length <= ends[piece]
    first, last, piece = first[inside], last[inside], piece[inside]
    size, gram = last + length - first, at_gram[first]
    whole = hashes[128]
    hull = whole[first] * odd[1] + (gram - first).astype(np.uint64)
    hull = _mixed(hull) * odd[2] + whole[first + (size - 128) // 2]
    hull = _mixed(hull) * odd[3] + whole[first + size - 128]
    hull = _mixed(_mixed(hull) * odd[4] + size.astype(np.uint64))
    same = (grams[gram][1:] == grams[gram][:-1]) & (hull[1:] == hull[:-1]) & (size[1:] == size[:-1]) & (np.diff(first) == 1)
    one = np.flatnonzero(np.r_[True, ~same])
    times = np.diff(np.r_[one, len(first)])
    first, piece = first[one], piece[one]
    text, base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]) - (ends - sizes)
    return text[piece], grams[gram[one]].astype(np.int64), hull[one].astype(np.int64), first + base[piece], size[one], times


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """Where in ``data`` (bytes + 1, with 0 after each hull) strings of ``length`` start that also start elsewhere.

    Places with a 0 among their next ``length`` values carry no meaning. The intervals of the first KEY bytes, and the
    common prefixes below that, are read off the keys that begin the sort; the expansion goes on from there.
    """
    n, depth = len(data), min(KEY, length)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= 9
        key[: n - k] |= data[k:]
    order = np.argsort(key)
    key = key[order]
    common = np.ones(n + 1, bool)  # rows whose common prefix with the row before is known
    common[1:n] = key[1:] != key[:-1]
    edge = np.flatnonzero(common)
    fresh = np.zeros(len(edge) - 1, bool)  # intervals that share all but the last byte with the next
    fresh[:-1] = key[edge[1:-1]] >> 9 == key[edge[1:-1] - 1] >> 9
    low, high = edge[:-1][fresh], edge[1:][fresh]
    rank, rows = np.empty(n, np.int32), np.arange(n)
    while True:  # rank: the first row of those equal so far; rows: of suffixes still tied
        first = np.r_[True, key[1:] != key[:-1]]
        suffixes = order[rows]
        rank[suffixes] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        tie = ~(first & np.r_[first[1:], True])
        rows, suffixes = rows[tie], suffixes[tie]
        if depth > length or not len(rows):
            break
        key = rank[suffixes].astype(np.int64) * (n + 1)
        inside = suffixes + depth < n
        key[inside] += rank[suffixes[inside] + depth] + 1
        by = np.argsort(key)
        order[rows], key = suffixes[by], key[by]
        depth *= 2
    rank[order] = np.arange(n)
    bwt = data[order - 1].astype(np.int64)
    back = rank[order - 1]  # the row of each suffix longer by its BWT value
    for _ in range(min(KEY, length), length):
        if not len(low):
            break
        sizes = high - low
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) - np.repeat(ends - sizes - low, sizes)
        key = np.repeat(np.arange(len(low)), sizes) * 257 + bwt[rows]
        by = np.argsort(key)
        key, to = key[by], back[rows[by]]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        new_low, new_high = np.minimum.reduceat(to, edge), np.maximum.reduceat(to, edge) + 1
        fresh = ~common[new_high]
        low, high = new_low[fresh], new_high[fresh]
        common[high] = True
        high, unique = np.unique(high, return_index=True)
        low = low[unique]
    tied = ~common[:n]
    out = np.zeros(n, bool)
    out[order[tied]] = True
    out[order[np.flatnonzero(tied) - 1]] = True
    return out


def _rows(docs: DataFrame, length: int, odd: list[np.uint64]) -> DataFrame:
    """(gram, hull, rid, start, size, times) of every anchor; docs: rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                text, gram, hull, start, size, times = anchors([v.as_py() or b"" for v in some.column(1).cast(pa.binary())], length, odd)
                rid = some.column(0).to_numpy()[text.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(hull), pa.array(rid), *[pa.array(x.astype(np.int32)) for x in (start, size, times)]], ["gram", "hull", "rid", "start", "size", "times"])
        give_back()

    return docs.mapInArrow(run, "gram bigint, hull bigint, rid bigint, start int, size int, times int")


def _hulls(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rid, gram, start, size, n) with the hulls' bytes."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("gram", "start", "size", "n")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                out = {k: [] for k in ("gram", "rid", "start", "n", "hull")}
                for rid, value, places in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("places").to_pylist(), strict=True):
                    text = value.as_py()
                    for p in places:
                        out["gram"].append(p["gram"])
                        out["rid"].append(rid)
                        out["start"].append(p["start"])
                        out["n"].append(p["n"])
                        out["hull"].append(text[p["start"] : p["start"] + p["size"]])
                yield pa.RecordBatch.from_arrays([pa.array(out["gram"], pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["hull"], pa.binary())], list(out))
        give_back()

    return docs.join(lists, "rid").select("rid", "text", "places").mapInArrow(run, "gram bigint, rid bigint, start int, n bigint, hull binary")


def _block_spans(hulls: DataFrame, length: int) -> DataFrame:
    """(rid, start, end) of the runs in hulls that occur once as a whole but whose windows occur elsewhere."""
    dealt = hulls.repartition("gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "rid", "start", "n", "hull")), strict=True):
                if row[0] != last and size >= BLOCK_BYTES:
                    yield spans(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield spans(held)
        held = []
        give_back()

    def spans(held: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"\0".join(r[4] for r in held) + b"\0", np.uint8).astype(np.int16) + 1
        ends = np.cumsum([len(r[4]) + 1 for r in held])
        data[ends - 1] = 0
        starts = repeated_starts(data, length)
        out: list[tuple[int, int, int]] = []
        for (_, rid, start, n, hull), end in zip(held, ends.tolist(), strict=True):
            if n == 1:
                first = end - 1 - len(hull)
                at = np.flatnonzero(starts[first : end - length])
                out += [(rid, start + a, start + b) for a, b in runs(at, length)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["rid", "start", "end"])

    return dealt.mapInArrow(run, "rid bigint, start int, end int")


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged [start, start + length) of ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def _placed(hulls: DataFrame, length: int, odd: list[np.uint64]) -> DataFrame:
    """``hulls`` as parts of all windows: ``at``, where the anchor stands, and the places it may have in a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(np.argmin(_block_hashes(np.frombuffer(h.as_buffer(), np.uint8)[:length], odd)[GRAM] >> np.uint64(_POSITION))) for h in batch.column("hull")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "at"])

    return hulls.mapInArrow(run, T.StructType([*hulls.schema.fields, T.StructField("at", T.IntegerType())])).withColumns({"low": F.lit(0), "high": F.lit(length - GRAM)})


def _halved(parts: DataFrame, length: int) -> DataFrame:
    """Each part cut in two by the place of the anchor in the windows; ``gram`` becomes a hash of what all windows of a half share."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high"))))
    cut = parts.select("gram", "rid", "start", "n", "hull", "at", half.alias("half")).select("*", "half.*").drop("half")
    last = F.greatest("low", F.col("at") + length - F.octet_length("hull"))
    cut = cut.select("*", F.least("high", "at").alias("far"), last.alias("near")).filter("near <= far")
    first = F.col("at") - F.col("far")
    hull = F.substring("hull", first + 1, F.col("far") - F.col("near") + length)
    cut = cut.select("gram", "rid", (F.col("start") + first).alias("start"), "n", hull.alias("hull"), F.col("far").alias("at"), "low", "high")
    shared = F.substring("hull", F.col("at") - F.col("low") + 1, F.col("low") + length - F.col("high"))
    return cut.withColumn("gram", F.xxhash64("gram", "low", "high", shared))


def _large_spans(hulls: DataFrame, length: int, odd: list[np.uint64], made: list[DataFrame]) -> DataFrame:
    """As ``_block_spans``, for anchors with more hulls than a block holds: parts are halved until they fit one."""
    out, parts = None, _placed(hulls, length, odd)
    for _ in range((length - GRAM).bit_length()):
        parts = stored(_halved(parts, length), "parts")
        made.append(parts)
        sizes = parts.groupBy("gram").agg(F.sum(F.octet_length("hull")).alias("bytes")).select("gram", (F.col("bytes") > GROUP_BYTES).alias("large"))
        dealt = stored(parts.join(sizes, "gram"), "dealt")
        made.append(dealt)
        some = _block_spans(dealt.filter("NOT large").select("gram", "rid", "start", "n", "hull"), length)
        out = some if out is None else out.unionByName(some)
        parts = dealt.filter("large").drop("large")
        if parts.isEmpty():
            return out
    often = parts.groupBy("hull").agg(F.count("*").alias("k"), F.max("n").alias("most")).filter("k > 1 OR most > 1").select("hull")
    return out.unionByName(parts.join(often, "hull", "left_semi").select("rid", "start", (F.col("start") + length).alias("end")))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, start, end), not merged, of the repeated runs; docs: rid, text."""
    odd = keys()
    rows = _rows(docs, length, odd)
    shared = stored(rows.groupBy("gram").agg(F.sum("times").alias("k")).filter("k > 1").select("gram"), "grams")
    rows = stored(rows.join(shared, "gram"), "anchors")
    hulls = rows.groupBy("gram", "hull").agg(F.sum("times").alias("n"), F.min(F.struct("rid", "start", "size")).alias("one"))
    hulls = stored(hulls, "hulls")
    whole = rows.join(hulls.filter("n > 1").select("gram", "hull"), ["gram", "hull"], "left_semi").select("rid", "start", (F.col("start") + F.col("size") + F.col("times") - 1).alias("end"))
    groups = hulls.groupBy("gram").agg(F.count("*").alias("k"), F.sum("one.size").alias("bytes")).filter("k > 1").select("gram", (F.col("bytes") > GROUP_BYTES).alias("large"))
    unsure = stored(hulls.join(groups, "gram").select("gram", "n", "one.*", "large"), "unsure")
    texts = docs.filter(F.octet_length("text") >= length)
    some = _block_spans(_hulls(texts, unsure.filter("NOT large").drop("large")), length)
    out, made = whole.unionByName(some), []
    if not unsure.filter("large").isEmpty():
        out = out.unionByName(_large_spans(_hulls(texts, unsure.filter("large").drop("large")), length, odd, made))
    out = stored(out, "spans")
    for x in (shared, rows, hulls, unsure, *made):
        discard(x)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, removed (maximal byte runs) and kept (the bytes that stay)."""
    own = fresh(docs, "rid", "id", "spans")
    kept = [f for f in docs.schema.fields if f.name.lower() not in _ADDED]
    both = [column(c).alias(c) for c in dict.fromkeys([f.name for f in kept] + [text])]
    source = stored(docs.select(*both, F.monotonically_increasing_id().alias(own["rid"])), "numbered")
    numbered = source.select(F.col(own["rid"]).alias("rid"), column(text).cast("string").alias("text"))
    places = spans(numbered, length).groupBy(F.col("rid").alias(own["id"])).agg(F.collect_list(F.struct("start", "end")).alias(own["spans"]))
    found = source.join(places, F.col(own["rid"]) == F.col(own["id"]), "left").select(*both, own["spans"])
    added = T._parse_datatype_string("n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, rest, sizes = [], [], []
            for value, found in zip(batch.column(batch.schema.get_field_index(text)).cast(pa.string()).cast(pa.binary()), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = value.as_py() or b""
                out, pieces, last = [], [], 0
                for s in sorted((x["start"], x["end"]) for x in found or []):
                    if out and s[0] <= out[-1][1]:
                        out[-1] = (out[-1][0], max(out[-1][1], s[1]))
                    else:
                        out.append(s)
                for a, b in out:
                    pieces.append(data[last:a])
                    last = b
                removed.append([{"start": a, "end": b} for a, b in out])
                rest.append(b"".join([*pieces, data[last:]]))
                sizes.append(len(data))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(rest, pa.binary())], [f.name for f in kept] + list(_ADDED))

    return found.mapInArrow(run, T.StructType(kept + added))


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    cut = remove_repeats(documents.select("doc_id", "text"), length)
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
