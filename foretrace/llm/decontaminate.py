"""Benchmark decontamination: a broadcast set of test n-grams against the windows of each text.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased. An item gives
its windows of ``n`` consecutive words; an item of fewer words, but not none, gives one window of all of
them. Every document word inside an occurrence of a window is hit.

The benchmark is measured before it is broadcast. Up to ``max_block_bytes`` of item text goes out in one
broadcast; a larger benchmark is cut by item hash into blocks of about that size, no item is left out. A worker keeps
one block's set at a time, from task to task: the windows' sorted 64-bit hashes and places, and the words themselves, by
which every hash hit is verified; about ``HELD_BYTES`` bytes for each byte of text. With more than one block the
documents are numbered and stored once, pass one block after another, each leaving the hits of the documents it hits, and
these are merged by document; only hits are shuffled.

Edge cases: a null or empty text has no words and no hits; a null item text gives no window; repeated items
count once per item_id, and items without an id are left out of the list but still hit; an empty benchmark
hits nothing; rows are independent, so repeated rows get equal results; an input column with the name of an
added column is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.llm.common import column, fresh, give_back, stored, without

N_WORDS = 10
#: A block of 16 MB is about 110 MB in a worker, the text itself as it was sent included.
MAX_BLOCK_BYTES, HELD_BYTES = 16 << 20, 7
#: Cells of the filter before the search in sorted hashes, for each window.
FILTER_CELLS = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_SPANS = "array<struct<start:int,end:int>>"
_ADDED = ("n_words", "hit_words", "hit_items")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes, in their order."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out *= _FACTOR
        out += hashes[i : i + n]
    return out


def _hashes(found: list[bytes]) -> np.ndarray:
    """Python's own hashes of words; they hold within a worker process, where sets are built and asked."""
    return np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)


class Windows:
    """The windows of one benchmark block: sorted hashes, and the words they stand for."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.ids = n, []
        texts, starts, ends, owners, at = [], [], [], [], 0
        hashes: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[np.ndarray]] = {}
        base, known = 0, {}
        for item_id, text in items:
            found = words(text.encode() if isinstance(text, str) else bytes(text or b""))
            if not found:
                continue
            if (same := known.setdefault(b" ".join(found), len(self.ids))) < len(self.ids):
                self.ids[same].add(item_id)
                continue
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            stops = at + np.cumsum(lengths + 1) - 1
            starts.append(stops - lengths)
            ends.append(stops)
            texts.append(b" ".join(found))
            at = int(stops[-1]) + 1
            owners.append(base)
            self.ids.append({item_id})
            size = min(n, len(found))
            hashes.setdefault(size, []).append(_rolled(_hashes(found), size))
            places.setdefault(size, []).append(np.arange(base, base + len(found) - size + 1, dtype=np.int32))
            base += len(found)
        self.text = b" ".join(texts)
        kind = np.int32 if at < 1 << 31 else np.int64
        self.starts, self.ends = (np.concatenate([np.zeros(0, kind), *x]).astype(kind) for x in (starts, ends))
        self.owners = np.array(owners, np.int64)
        #: By window length: sorted hashes, the windows' first words, and a filter over the hashes' top bits.
        self.tables = {}
        for size in sorted(hashes):
            h, p = np.concatenate(hashes.pop(size)), np.concatenate(places.pop(size))
            order = np.argsort(h, kind="stable")
            h, p = h[order], p[order]
            bits = max(10, int(FILTER_CELLS * len(h)).bit_length())
            mask = np.zeros(1 << bits >> 3, np.uint8)
            cell = h >> np.uint64(64 - bits)
            np.bitwise_or.at(mask, cell >> np.uint64(3), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))
            self.tables[size] = (h, p, mask, np.uint64(64 - bits))

    def held(self) -> int:
        """Bytes of the arrays and the text."""
        return len(self.text) + self.starts.nbytes + self.ends.nbytes + self.owners.nbytes + sum(x.nbytes for t in self.tables.values() for x in t[:3])

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans that windows cover (merged), and the ids of items they come from."""
        spans, items = [], set()
        if not found or not self.tables:
            return spans, items
        own = _hashes(found)
        for size, (hashes, places, mask, shift) in self.tables.items():
            if size > len(found):
                continue
            asked = _rolled(own, size)
            cell = asked >> shift
            near = np.flatnonzero(mask[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
            if not len(near):
                continue
            first, last = np.searchsorted(hashes, asked[near]), np.searchsorted(hashes, asked[near], "right")
            for i, a, b in zip(near.tolist(), first.tolist(), last.tolist(), strict=True):
                if a == b:
                    continue
                here = b" ".join(found[i : i + size])
                same = [p for p in places[a:b].tolist() if self.text[self.starts[p] : self.ends[p + size - 1]] == here]
                if same:
                    spans.append((i, i + size))
                    items.update(*(self.ids[k] for k in set((np.searchsorted(self.owners, same, "right") - 1).tolist())))
        return merged(spans), items


#: A worker's block, by the name that it was sent under.
_BLOCK: dict[str, Windows] = {}


def _windows(sent, name: str) -> Windows:
    if name not in _BLOCK:
        _BLOCK.clear()
        _BLOCK[name] = Windows(*sent.value)
    return _BLOCK[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES, names: tuple[str, ...] = _ADDED) -> DataFrame:
    """``docs`` with n_words, hit_words (merged spans of word positions) and hit_items (sorted ids as text), or the
    names given for these."""
    spark = docs.sparkSession
    items = benchmark.select(column(item_id).cast("string").alias("item_id"), column(item_text).alias("text")).filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / max_block_bytes))
    out = without(docs, names)

    def sent(block: int):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        return spark.sparkContext.broadcast(([(r["item_id"], r["text"]) for r in part.distinct().toLocalIterator()], n))

    def schema(df: DataFrame, added: str, own: tuple[str, ...]) -> T.StructType:
        return T.StructType(df.schema.fields + [T.StructField(name, f.dataType) for name, f in zip(own, T._parse_datatype_string(added).fields, strict=True)])

    if blocks == 1:
        return out.mapInArrow(_scanner(sent(0), text, [*out.columns, *names]), schema(out, f"a bigint, b {_SPANS}, c array<string>", names))
    own = fresh(out.select("*", *[F.lit(0).alias(x) for x in names]), "rid", "id", "spans", "items")
    rows = stored(out.withColumn(own["rid"], F.monotonically_increasing_id()), "scanned")
    found = None
    for block in range(blocks):
        held = sent(block)
        texts = rows.select(F.col(own["rid"]).alias("rid"), column(text).alias("text"))
        hits = texts.mapInArrow(_hits(held), f"id bigint, spans {_SPANS}, items array<string>")
        hits = stored(hits, "hits")
        held.destroy()
        found = hits if found is None else found.unionByName(hits)
    # A document's hits are a part of its words for each block.
    found = found.groupBy(F.col("id").alias(own["id"])).agg(F.flatten(F.collect_list("spans")).alias(own["spans"]), F.flatten(F.collect_list("items")).alias(own["items"]))
    met = rows.join(found, F.col(own["rid"]) == F.col(own["id"]), "left").select(*map(column, out.columns), own["spans"], own["items"])
    return met.mapInArrow(_merger(text, [*out.columns, *names]), schema(out, f"a bigint, b {_SPANS}, c array<string>", names))


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in found], _SPAN)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[list[bytes]]:
    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield words(value.as_py() or b"")


def _scanner(sent, text: str, names: list[str]):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(sent, key)
        for batch in batches:
            counts, spans, items = [], [], []
            for found in _texts(batch, text):
                hit, ids = windows.find(found)
                counts.append(len(found))
                spans.append(hit)
                items.append(sorted(i for i in ids if i is not None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], names)
        give_back()

    return run


def _hits(sent):
    """(id, spans, items) of the documents that a block hits."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(sent, key)
        for batch in batches:
            at, spans, items = [], [], []
            for k, found in enumerate(_texts(batch, "text")):
                hit, ids = windows.find(found)
                if hit:
                    at.append(k)
                    spans.append(hit)
                    items.append([i for i in ids if i is not None])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), _spans(spans), pa.array(items, pa.list_(pa.string()))], ["id", "spans", "items"])
        give_back()

    return run


def _merger(text: str, names: list[str]):
    """Hits of all blocks, the last two columns, as merged spans and sorted ids; and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(found) for found in _texts(batch, text)]
            spans = [merged([(s["start"], s["end"]) for s in x or []]) for x in batch.column(batch.num_columns - 2).to_pylist()]
            items = [sorted(set(x or [])) for x in batch.column(batch.num_columns - 1).to_pylist()]
            kept = batch.columns[:-2]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], names)

    return run


def digests(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the columns of ``scan``."""
    return scanned.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window hits, with their own columns."""
    names = fresh(docs, *_ADDED)
    marked = scan(docs, benchmark, names=tuple(names.values()), **options)
    return marked.filter(F.size(names["hit_words"]) == 0).select(*map(column, docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` and the columns of ``scan``, with the words of every occurrence cut out of the text (a null text stays
    null)."""
    marked = scan(docs, benchmark, text=text, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hits = batch.schema.get_field_index(text), batch.schema.get_field_index("hit_words")
            values = batch.column(at).cast(pa.binary()).to_pylist()
            for k, spans in enumerate(batch.column(hits).to_pylist()):
                if spans:
                    where = [m.span() for m in WORD.finditer(values[k].lower())]
                    out, last = [], 0
                    for s in spans:
                        out.append(values[k][last : where[s["start"]][0]])
                        last = where[s["end"] - 1][1]
                    values[k] = b"".join([*out, values[k][last:]])
            fixed = pa.array(values, pa.binary()).cast(batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), fixed)

    return marked.mapInArrow(cut, marked.schema)
