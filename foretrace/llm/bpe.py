"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Each text is cut by the pre-tokenizing pattern. The distinct pieces a task has not met yet become
(word, position, token) rows of an in-process DuckDB table; a recursive query joins neighbouring tokens
with the merge table and contracts the leftmost pair of least rank of every word until no word has a pair
left. Decoding joins token positions with the vocabulary, in order, and joins the bytes of each document.

A recursion over a piece of b bytes would take up to b rounds of b rows, so pieces of more than ``LONG_PIECE``
bytes (a text without breaks) are cut where no token of the vocabulary reaches across: nothing contracts over
such a border. A recursion contracts in one round all occurrences of a part's least pair, from the left up to
the first that forms a pair of lower rank, which is what one contraction at a time comes to. It pauses every
``ROUNDS`` rounds for new cuts, as longer tokens leave more borders that nothing reaches across.

The merge table comes from a rank file with one "base64 rank" pair a line. It has a fixed size, is read on
the driver and broadcast. Tasks keep the pieces they met in tables of about ``CACHE_PIECES``; a full table drops
what was not met again since the last time, which costs time but changes no result. Rows are independent: a lost
executor's partitions are just encoded again.

Edge cases: null and empty texts give no tokens and decode to no bytes; special-token strings are plain
text; repeated rows get equal results; an input column with the name of an added column is replaced.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.llm.common import give_back, without

LONG_PIECE = 128
ROUNDS = 16
TOKENS_A_QUERY = 200_000
#: Memory of a DuckDB query: a query of very long pieces has more, in proportion to their tokens.
MEMORY_MB, BYTES_A_TOKEN = 120, 700
CACHE_PIECES = 300_000
CHUNK_BYTES = 1 << 20
PIECES_A_QUERY = 16_000
ROWS_A_BATCH = 500
#: A word's last state is the one of its last round; merges.pair is the left token * 2^20 + the right one.
_MERGE = """
WITH RECURSIVE state AS (
    SELECT 0 AS round, word, tokens FROM pieces
    UNION ALL
    (WITH position AS (
        SELECT word, unnest(range(1, len(tokens))) AS i, unnest(tokens[:-2]) AS token, unnest(tokens[2:]) AS after FROM state WHERE len(tokens) > 1
     ), pair AS (
        SELECT word, i, (token::BIGINT << 20) + after AS pair FROM position
     ), best AS (
        SELECT p.word, min((m.merged::BIGINT << 20) + p.i) AS least
        FROM pair p JOIN merges m ON m.pair = p.pair GROUP BY p.word
     )
     SELECT s.round + 1, s.word,
            list_concat(s.tokens[:(b.least & 1048575) - 1], [(b.least >> 20)::INTEGER], s.tokens[(b.least & 1048575) + 2:])
     FROM state s JOIN best b ON b.word = s.word)
)
SELECT word, arg_max(tokens, round) AS ids FROM state GROUP BY word ORDER BY word
"""
#: As _MERGE, but all occurrences of the least rank in one round; "i" is where the pair starts, every second of a
#: run of overlapping occurrences is taken, and none after the first that forms a pair of lower rank.
_MERGE_ALL = """
WITH RECURSIVE state AS (
    SELECT 0 AS round, word, tokens FROM pieces
    UNION ALL
    (WITH single AS (
        SELECT round, word, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS token FROM state WHERE len(tokens) > 1 AND round < $rounds
     ), position AS MATERIALIZED (
        SELECT *, lag(token) OVER w AS before, lead(token) OVER w AS after, lead(token, 2) OVER w AS second FROM single WINDOW w AS (PARTITION BY word ORDER BY i)
     ), ranked AS (
        SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY p.word) AS least
        FROM position p JOIN merges m ON m.pair = (p.token::BIGINT << 20) + p.after
     ), found AS (
        SELECT *, i - row_number() OVER (PARTITION BY word ORDER BY i) AS run FROM ranked WHERE merged = least
     ), taken AS (
        SELECT word, i, least, before, second FROM found QUALIFY (i - min(i) OVER (PARTITION BY word, run)) % 2 = 0
     ), beside AS (
        SELECT word, i, least, second, CASE WHEN lag(i) OVER (PARTITION BY word ORDER BY i) = i - 2 THEN least ELSE before END AS before FROM taken
     ), lesser AS (
        SELECT b.word, min(b.i) AS last FROM beside b
        LEFT JOIN merges l ON l.pair = (b.before::BIGINT << 20) + b.least
        LEFT JOIN merges r ON r.pair = (b.least::BIGINT << 20) + b.second
        WHERE l.merged < b.least OR r.merged < b.least GROUP BY b.word
     ), done AS MATERIALIZED (
        SELECT t.word, t.i, t.least FROM taken t LEFT JOIN lesser w ON w.word = t.word WHERE w.last IS NULL OR t.i <= w.last
     )
     SELECT any_value(p.round) + 1, p.word, list(coalesce(d.least, p.token) ORDER BY p.i)
     FROM position p LEFT JOIN done d ON d.word = p.word AND d.i = p.i LEFT JOIN done b ON b.word = p.word AND b.i = p.i - 1
     WHERE b.i IS NULL AND p.word IN (SELECT word FROM done) GROUP BY p.word)
)
SELECT word, arg_max(tokens, round) AS ids, max(round) AS rounds FROM state GROUP BY word ORDER BY word
"""
#: A row for each token, an unknown one has no bytes.
_DECODE = "SELECT coalesce(v.bytes, ''::BLOB) AS bytes FROM tokens t LEFT JOIN vocabulary v ON v.token = t.token ORDER BY t.pos"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """One worker's DuckDB database with the merge table, and the pieces met so far."""

    _held: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.met: dict[str, bytes] = {}
        self.again: set[str] = set()  # those met in several chunks since the table was full
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.reach: dict[bytes, int] = {}  # the first two bytes of tokens, and the longest token with them
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
            if len(token) > 1:
                self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 0))
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._load("merges", pa.table({"pair": pa.array([(a << 20) + b for a, b, _ in merges], pa.int64()), "merged": pa.array([m for _, _, m in merges], pa.int32())}))
        self._load("vocabulary", pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks, pa.binary())}))

    @classmethod
    def of(cls, key: str, sent) -> Codec:
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(sent.value)
        return cls._held[key]

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _query(self, sql: str, name: str, table: pa.Table, **params: int) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql, params=params).to_arrow_table()
        finally:
            self.db.unregister(name)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met yet."""
        short: list[tuple[str, bytes]] = []
        for piece in pieces:
            raw = piece.encode()
            if raw in self.ranks:
                self.met[piece] = np.array([self.ranks[raw]], "<u4").tobytes()
            elif len(raw) > LONG_PIECE:
                self.met[piece] = np.array(self.contract(raw), "<u4").tobytes()
            else:
                short.append((piece, raw))
        for at in range(0, len(short), PIECES_A_QUERY):
            part = short[at : at + PIECES_A_QUERY]
            ends = np.cumsum([0] + [len(raw) for _, raw in part]).astype(np.int32)
            tokens = self.base[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
            rows = pa.table({"word": np.arange(len(part), dtype=np.int32), "tokens": pa.ListArray.from_arrays(ends, tokens)})
            ids = self._query(_MERGE, "pieces", rows).column("ids").combine_chunks()
            ends, packed = (4 * ids.offsets.to_numpy()).tolist(), ids.values.to_numpy().astype("<u4").tobytes()
            for k, (piece, _) in enumerate(part):
                self.met[piece] = packed[ends[k] : ends[k + 1]]

    def contract(self, raw: bytes) -> list[int]:
        """The same contraction for a long piece, in parts that no token crosses."""
        parts, done = [(self.base[np.frombuffer(raw, np.uint8)], np.arange(len(raw) + 1))], {}
        while parts:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            paused: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for tokens, at in (cut for part in parts for cut in self.cuts(raw, *part)):
                if len(tokens) == 1:
                    done[at[0]] = tokens
                    continue
                if held and size + len(tokens) > TOKENS_A_QUERY:
                    paused += self._rounds(held, done)
                    held, size = [], 0
                held.append((tokens, at))
                size += len(tokens)
            parts = paused + (self._rounds(held, done) if held else [])
        return np.concatenate([done[k] for k in sorted(done)]).tolist()

    def _rounds(self, parts: list[tuple[np.ndarray, np.ndarray]], done: dict[int, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Up to ROUNDS rounds of every part: ended ones go to ``done``, the others are returned."""
        ends = np.cumsum([0] + [len(t) for t, _ in parts]).astype(np.int32)
        rows = pa.table({"word": np.arange(len(parts), dtype=np.int32), "tokens": pa.ListArray.from_arrays(ends, np.concatenate([t for t, _ in parts]))})
        self.db.execute(f"SET memory_limit = '{MEMORY_MB + int(ends[-1]) * BYTES_A_TOKEN // 1_000_000}MB'")
        found = self._query(_MERGE_ALL, "pieces", rows, rounds=ROUNDS)
        self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        out = []
        for (_, at), ids, rounds in zip(parts, found.column("ids"), found.column("rounds").to_pylist(), strict=True):
            tokens = ids.values.to_numpy().astype(np.int32)
            if rounds < ROUNDS:
                done[at[0]] = tokens
            else:
                out.append((tokens, at[0] + np.cumsum([0, *self.sizes[tokens]])))
        return out

    def cuts(self, raw: bytes, tokens: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``tokens``, with borders ``at`` in the piece, in parts between which no vocabulary token reaches from border to border."""
        borders, ranks, reach, get = at.tolist(), self.ranks, 0, self.reach.get
        last, end = 0, len(at) - 1
        for i in range(end):
            start = borders[i]
            if i == reach and i > last:
                yield tokens[last:i], at[last : i + 1]
                last = i
            longest = start + get(raw[start : start + 2], 0)
            reach = max(reach, i + 1)
            j = bisect.bisect_right(borders, longest, i) - 1
            while j > reach and raw[start : borders[j]] not in ranks:
                j -= 1
            reach = max(reach, j)
        yield tokens[last:], at[last:]

    def encode(self, texts: list[str | None], pattern: str) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        import regex

        find = regex.compile(pattern).findall
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            chunk, size = [], 0
            while at < len(texts) and (not chunk or size < CHUNK_BYTES):
                chunk.append(find(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            pieces = set().union(*chunk)
            new = pieces.difference(self.met)
            self.again |= pieces - new
            if len(self.met) + len(new) > CACHE_PIECES:
                some = self.again if len(self.again) + len(new) <= CACHE_PIECES else pieces - new
                self.met, self.again = {piece: self.met[piece] for piece in some}, set()
            self.learn(new)
            get = self.met.__getitem__
            out += [b"".join(map(get, found)) for found in chunk]
        return out

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(packed)
        at = 0
        while at < len(packed):
            chunk, size, first = [], 0, at
            while at < len(packed) and (not chunk or size < CHUNK_BYTES):
                chunk.append(np.frombuffer(packed[at] or b"", "<u4").astype(np.int32))
                size += 4 * len(chunk[-1])
                at += 1
            ends = np.cumsum([0] + [len(x) for x in chunk]).astype(np.int32)
            if not ends[-1]:
                continue
            rows = pa.table({"pos": np.arange(ends[-1], dtype=np.int32), "token": np.concatenate(chunk)})
            found = self._query(_DECODE, "tokens", rows).column("bytes").combine_chunks()
            out[first:at] = pc.binary_join(pa.ListArray.from_arrays(ends, found), b"").to_pylist()
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", packed: bool = False, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with ``ids``: array<int>, or packed little-endian unsigned 32-bit.

    With ``decoded`` also the bytes that the ids decode to, in the same pass over the text.
    """
    names = docs.columns if keep is None else keep
    out = without(docs.select(*names), ["ids", "decoded"][: 1 + decoded]).columns
    source = docs.select(*dict.fromkeys([*out, text]))
    added = [T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded
    key, sent = _sent(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(key, sent)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                ids = codec.encode(batch.column(batch.schema.get_field_index(text)).to_pylist(), pattern)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in out]
                if packed:
                    columns.append(pa.array(ids, pa.binary()))
                else:
                    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                if decoded:
                    columns.append(pa.array(codec.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*out, *(f.name for f in added)])
        give_back()

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in out] + added))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the tokens in order; ids packed or as an array."""
    out = without(encoded, ["decoded"])
    schema = T.StructType([*out.schema.fields, T.StructField("decoded", T.BinaryType())])
    is_packed = isinstance(out.schema[ids].dataType, T.BinaryType)
    key, sent = _sent(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(key, sent)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            if not is_packed:
                values = [np.array(x or [], "<u4").tobytes() for x in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.decode(values), pa.binary())], [*batch.schema.names, "decoded"])

    return out.mapInArrow(run, schema)


_broadcasts: dict[str, object] = {}


def _sent(spark: SparkSession, path: str):
    """The rank table's broadcast, one per application and file, with its key."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _broadcasts:
        _broadcasts[key] = spark.sparkContext.broadcast(read_ranks(path))
    return key, _broadcasts[key]


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: token count, and digests of the packed ids and of the decoded bytes."""
    coded = encode(documents, ranks_path, pattern, packed=True, keep=["doc_id"], decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
