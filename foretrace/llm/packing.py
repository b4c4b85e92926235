"""Best-fit packing of tokenised documents into sequences, planned over the histogram of their lengths.

1. Every text is tokenised, ``END`` is appended, and what is longer than a sequence is cut into pieces of its size.
   No token of the vocabulary reaches over white space, so a text's ids are those of its words (runs of anything but
   ASCII white space): a worker codes each distinct word of a chunk once and keeps up to ``CACHE_WORDS`` answers.
   Words of ASCII and Latin-1 letters, whose lower case and classes are plain, are coded by their merge ranks; the
   ranks are checked for that when they are read. All other words go to the tokenizer itself.
   Pieces are stored with their task and their place among the task's pieces of equal length.
2. The histogram of lengths, at most ``size`` rows, goes to the driver. Best fit with falling lengths runs over its
   counts: sequences with equal room are ranges of numbers, and a length moves whole ranges, so the plan has a few
   runs a length, however many documents there are.
3. A piece's rank within its length is the count of that length in earlier tasks plus its place in its own. The plan's
   run that holds the rank gives sequence and offset. No task meets all pieces of a length.

Edge cases: a null text is an empty one, of the end token alone; equal, repeated or null doc_ids are pieces of rows of
their own; an empty table gives no rows; other columns are left out. A word without white space is tokenised whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import column, give_back, stored

SIZE, END = 2048, 0
CACHE_WORDS, LONGEST_CACHED = 250_000, 64
#: Texts are tokenised together up to so many bytes, or one by one if longer.
CHUNK_BYTES = 6 << 20
#: Words of these characters alone are not changed by normalisation but for their case.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
# How the tokenizer's configuration cuts a text into pieces, for these characters; and its word end.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
CUTTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: A byte that no text in UTF-8 has, for the end of a piece.
_MARK = b"\xff"


def merge_ranks(config: dict) -> tuple[dict[bytes, int], list[int]] | None:
    """(rank of each token's bytes, id by rank) of a byte-level BPE with word ends; None where it is of another form.

    Contracting the pair whose bytes have the least rank equals the listed merges if each token's own bytes, by the
    merges before it alone, end in just the pair that its merge names. That is checked here, token by token.
    """
    model, cutting = config["model"], [x.get("pattern", {}).get("Regex") for x in config["pre_tokenizer"].get("pretokenizers", [])]
    steps = [x["type"] for x in config["normalizer"].get("normalizers", [])]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or model["ignore_merges"] or cutting != [CUTTING, None] or steps != ["NFC", "Replace", "Lowercase"]:
        return None
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256
    symbol = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def raw(token: str) -> bytes:
        ended = token.endswith(WORD_END)
        return bytes(symbol[c] for c in token.removesuffix(WORD_END)) + (_MARK if ended else b"")

    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    singles = [c + end for end in ("", WORD_END) for c in symbol]
    tokens = [*singles, *(a + b for a, b in merges)]
    if any(t not in model["vocab"] for t in tokens) or len(set(tokens)) < len(tokens):
        return None
    ranks = {raw(t): i for i, t in enumerate(tokens)}
    if len(ranks) < len(tokens):
        return None
    for first, second in merges:
        a, b = raw(first), raw(second)
        top = ranks[a + b]
        parts = [(a + b)[i : i + 1] for i in range(len(a + b))]
        while len(parts) > 1:
            rank, i = min((ranks.get(x + y, top), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank >= top:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [a, b]:
            return None
    return ranks, [model["vocab"][t] for t in tokens]


class Coder:
    """Token ids of whole texts, from those of their distinct words."""

    def __init__(self, path: str, checked: tuple[dict[bytes, int], list[int]] | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.core = self.ids = None
        if checked is not None:
            self.core, self.ids = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=checked[0], special_tokens={})._core_bpe, checked[1]

    def plain(self, word: str) -> bytes:
        ranks: list[int] = []
        for piece in PIECES.findall(word.lower()):
            ranks += self.core.encode_single_piece(piece.encode() + _MARK)
        return array("I", [self.ids[r] for r in ranks]).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian integers of 32 bits."""
        out = list(map(self.cache.get, words))
        odd = []
        for i, known in enumerate(out):
            if known is None:
                word = words[i]
                if self.core is None or PLAIN.fullmatch(word) is None or "<" in word and any(t in word for t in self.added):
                    odd.append(i)
                    continue
                out[i] = self.plain(word)
                if len(self.cache) < CACHE_WORDS and len(word) <= LONGEST_CACHED:
                    self.cache[word] = out[i]
        for i, found in zip(odd, self.tokenizer.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
            if len(self.cache) < CACHE_WORDS and len(words[i]) <= LONGEST_CACHED:
                self.cache[words[i]] = out[i]
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END behind it; where each text's ids end)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        found = self.words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy()
        n = sizes[place]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(first[place] - (ends - n), n)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        ends = np.r_[0, ends][offsets[1:]]
        return np.insert(flat[at], ends, END).astype("<u4"), ends + np.arange(1, len(ends) + 1)


#: A worker's coder by file; it lives on from task to task.
_CODERS: dict[str, Coder] = {}


def _coder(path: str, checked: tuple[dict[bytes, int], list[int]] | None) -> Coder:
    if path not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
        _CODERS[path] = Coder(path, checked)
    return _CODERS[path]


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]) of every document, not yet placed."""
    kept = documents.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).cast("string").alias("text"))

    checked = merge_ranks(json.loads(Path(tokenizer).read_text()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = _coder(tokenizer, checked), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            bytes_before = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(bytes_before, bytes_before[a] + CHUNK_BYTES, "right")) - 1)
                flat, ends = coder.encode(batch.column(1).slice(a, b - a))
                lengths = np.diff(ends, prepend=0)
                count = -(-lengths // size)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(lengths[doc] - start, size)
                first = (ends - lengths)[doc] + start
                crc = [zlib.crc32(flat[i : i + k]) for i, k in zip(first.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                same = length[order]
                nth = np.empty(len(doc), np.int64)
                nth[order] = seen[same] + np.arange(len(doc)) - np.searchsorted(same, same)
                seen += np.bincount(length, minlength=size + 1)
                cells = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.r_[first, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cells, names)
                a = b
        give_back()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    return kept.mapInArrow(run, schema + (", ids array<int>" if ids else ""))


def planned(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best fit with falling lengths over counts: rows of (length, first rank, pieces, copies, first sequence, offset).

    Piece ``first rank + i`` of a run goes to sequence ``first + i // copies`` at ``offset + i % copies * length``.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = sorted(r for r in room if r >= length)
        while left:
            # The fullest sequences that still take the length, each filled with it before the next.
            space = next((r for r in fits if room.get(r)), size)
            copies = space // length
            if room.get(space):
                first, n = room[space].pop()
            else:
                first, n = opened, -(-left // copies)
                opened += n
            whole = min(n, left // copies)
            rest = left - whole * copies if whole < n else 0
            for start, many, each in ((first, whole, copies), (first + whole, int(rest > 0), rest)):
                if many:
                    runs.append((length, rank, many * each, each, start, size - space))
                    room.setdefault(space - each * length, []).append((start, many))
                    rank, left = rank + many * each, left - many * each
            if (used := whole + int(rest > 0)) < n:
                room.setdefault(space, []).append((first + used, n - used))
    return np.array(runs, np.int64).reshape(-1, 6)


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Stored ``pieces`` with sequence_id and offset in place of task and nth."""
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = planned(counts, size)
    runs = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("task", "nth", "before")
    kept = [c for c in cut.columns if c not in ("task", "nth")]
    span = max(counts.values(), default=0) + 1
    keys = runs[:, 0] * span + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            i, copies = rank - runs[at, 1], runs[at, 3]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(runs[at, 4] + i // copies), pa.array(runs[at, 5] + i % copies * length)], [*kept, "sequence_id", "offset"])

    types = dict(cut.dtypes)
    return ranked.select(*kept, "rank").mapInArrow(place, ", ".join([*[f"{c} {types[c]}" for c in kept], "sequence_id bigint", "offset bigint"]))


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of the documents."""
    return packed(stored(pieces(documents, tokenizer, size, doc_id, text, ids), "pieces"), size)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token sequences of ``pack(..., ids=True)``, with the document of each piece."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(ordered.alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
