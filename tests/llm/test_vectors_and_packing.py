"""Whitening, hard negatives and packing against brute force, and their edge cases."""

import functools
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foretrace.llm import negatives, packing, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id bigint, embedding array<float>, label int"


# ------------------------------------------------------------------ 11: whitening


@pytest.mark.parametrize("spread", [1, 40, 2**20, 2**45])
def test_scatter_equals_products_of_integers(spread):
    rnd = np.random.default_rng(spread)
    x = rnd.integers(-spread, spread + 1, (200, 5))
    x[:, 3] = 7  # a constant dimension has no plane
    total, cross = whitening.scatter(x)
    wide = x.astype(object)
    assert total.tolist() == wide.sum(axis=0).tolist() and cross.tolist() == (wide.T @ wide).tolist()
    one, square = whitening.scatter(x[:1])
    assert one.tolist() == x[0].tolist() and square.tolist() == np.outer(wide[0], wide[0]).tolist()


def test_deviations_beyond_a_long():
    z = np.array([[3, -4], [1 << 40, 5], [(1 << 51) + 1, -(1 << 51)]])
    assert whitening.deviations(z).tolist() == [sum(int(v) ** 2 for v in row) for row in z]
    far = z.astype(object) * (1 << 30)
    assert whitening.deviations(far).tolist() == [sum(v**2 for v in row) for row in far.tolist()]


def whitened_by_numpy(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    v = (z.astype(float) / n).T @ (z.astype(float) / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return (z / n) @ axes / np.sqrt(values), values / np.trace(v), (z.astype(object) ** 2).sum(axis=1)


def test_whitening_equals_numpy(spark):
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    bad = [(900, None, 0), (901, [None] * 12, 0), (902, [math.nan] * 12, 0), (903, [math.inf] + [0.0] * 11, 0), (904, [], 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumnsRenamed({"label": "X"}).withColumn("deviation", F.lit("theirs")).repartition(5)
    got = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        got[r.vec_id][r.component] = r
    expected, explained, deviation = whitened_by_numpy(vectors, 8)
    assert set(got) == set(range(300)) and all(sorted(g) == list(range(1, 9)) for g in got.values())
    for c in range(1, 9):
        sign = np.sign(got[0][c].whitened * expected[0, c - 1])
        assert all(abs(sign * got[i][c].whitened - expected[i, c - 1]) < 1e-9 for i in range(300))
        assert abs(got[0][c].explained - explained[c - 1]) < 1e-9 and got[0][c].identity_error < 1e-9
    assert all(got[i][1].deviation == deviation[i] == int(got[i][1].deviation_exact) and got[i][1].n == 300 for i in range(300))


def test_whitening_of_few_equal_and_short_vectors(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (None, [0.5, 0.25], 1)], VECTORS)
    rows = whitening.whiten(same).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in rows)
    mixed = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.0], 0), (5, [1e30, 0.5], 0)], VECTORS)
    got = whitening.whiten(mixed).collect()
    assert Counter((r.vec_id, r.n) for r in got) == {(1, 2): 1, (2, 2): 1, (3, 3): 2, (4, 3): 2, (5, 3): 2}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got if r.n == 2)
    assert all(r.deviation is None and r.deviation_exact > 0 for r in got if r.vec_id == 5)
    assert whitening.whiten(same.limit(0)).count() == 0


# ------------------------------------------------------------------ 12: hard negatives


def mined(rows, scale=256, positives=5, few=3, low=50, high=95):
    out = []
    held = [(i, [math.floor(scale * float(np.float32(x))) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for a, (i, v, l) in enumerate(held):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, b, m) for b, (j, w, m) in enumerate(held) if b != a and len(w) == len(v)]
        for score, j, _, _ in sorted(s for s in scored if s[3] == l)[:positives]:
            band = sorted(s for s in scored if s[3] != l and low * -score <= 100 * -s[0] <= high * -score)[:few]
            out += [(i, j, k, s[1], -score, -s[0]) for k, s in enumerate(band, 1)]
    return Counter(out)


@pytest.mark.parametrize("scale", [3, 256, 2**20, 2**26])
def test_packed_products_are_exact(scale):
    rnd = np.random.default_rng(scale)
    vectors = np.floor(rnd.normal(size=(1000, 9)) * scale).astype(np.int64)
    table = pa.table({"vec_id": np.arange(1000), "row": np.arange(1000), "label": np.zeros(1000, np.int64), "v": pa.array(vectors.tolist())})
    block = negatives.PackedBlock(table)
    assert (block.scores(vectors[:70]) == vectors[:70] @ vectors.T).all()
    assert (negatives.PackedBlock(table.slice(0, 1)).scores(vectors[:1]) == vectors[:1] @ vectors[:1].T).all()


@pytest.mark.parametrize("block,many", [(8192, 2048), (37, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, many):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SLICE", many)
    rnd = random.Random(4)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    # Few distinct vectors, so that scores tie; one label holds most rows.
    pool = [([c + rnd.gauss(0, 0.6) for c in centre[k]], k) for k in (0, 0, 0, 0, 1, 2) for _ in range(12)]
    rows = [(i, *rnd.choice(pool)) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]
    rows += [rows[50], rows[7], (500, None, 1), (550, [None] * 6, 1), (600, [math.nan] * 6, 1), (650, rows[0][1], None), (None, rows[0][1], 1), (700, [1.0, 2.0], 1), (701, [1.0, 1.5], 1), (702, [0.5, 1.0], 2), (750, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"V": F.lit("x"), "Row": F.lit(1), "score": F.lit(None).cast("int"), "_block": F.lit(3)})
    got = negatives.hard_negatives(df.repartition(6), F.col("vec_id") % 50 == 0).collect()
    found = Counter(tuple(r) for r in got)
    assert len(found) > 50 and found == mined(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ------------------------------------------------------------------ 13: packing

RANKS = packing.merge_ranks(json.loads(Path(WORDS).read_text()))
TEXTS = [None, "", " ", "one two", "it's 1234 o'clock, isn't it?!", "<|endoftext|> a<|endoftext|>b", "é́ ΣΑΣ ΑΣ. ǅ İ ﬁ x\u0085y z w", "x" * 9000, "漢字 𝔘𝔫𝔦 \U0001f600", "\x00\x1c\x1d\x1e\x1f\x0b\x0c a\tb\r\nc", "1 2 3 " * 3000]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_by_library(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_words_give_the_tokens_of_the_text(monkeypatch):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("abc'sS1.,é́Σ \n\t\x1f 漢") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    for kept in (300_000, 3):
        monkeypatch.setattr(packing, "CACHE_WORDS", kept)
        coder = packing.Coder(WORDS, RANKS if kept > 3 else None)
        flat, ends = coder.encode(pa.array(texts).slice(1))
        assert len(coder.cache) <= kept
        for t, a, b in zip(texts[1:], [0, *ends.tolist()], ends.tolist()):
            assert flat[a:b].tolist() == [*ids_by_library(t), 0]


def best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return len(room)


def test_plan_by_counts_equals_best_fit_of_pieces():
    rnd = random.Random(8)
    for _ in range(60):
        size = rnd.choice([10, 37, 100])
        lengths = [rnd.randint(1, rnd.choice([3, size])) for _ in range(rnd.randint(0, 200))]
        counts, used, held = Counter(lengths), defaultdict(int), defaultdict(list)
        for length, rank, n, copies, first, offset in packing.planned(dict(counts), size).tolist():
            assert rank == used[length]
            used[length] += n
            for i in range(n):
                held[first + i // copies].append((offset + i % copies * length, length))
        assert used == counts and len(held) == best_fit(lengths, size)
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size


def test_plan_grows_with_lengths_not_documents():
    counts = {n: 10**12 + n for n in range(1, 2049)}
    runs = packing.planned(counts)
    assert len(runs) < 20_000 and runs[:, 2].sum() == sum(counts.values())


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_places_every_token(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 5000)
    texts = TEXTS + ["same words in many rows"] * 300 + [f"w{i} " * (i % 50) for i in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one two", "y"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, nth string").withColumns({"Length": F.lit(1), "task": F.lit(2), "ids": F.lit(3)}).repartition(parts)
    placed = packing.pack(df, WORDS, size=64)
    got = placed.collect()
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    wanted = Counter()
    for i, t, _ in rows:
        ids = [*ids_by_library(t), 0]
        for k in range(0, len(ids), 64):
            wanted[i, k // 64, k, tuple(ids[k : k + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == wanted
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append(r)
    assert len(held) == best_fit([r.length for r in got], 64)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for s, own in held.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert whole[s].ids == [t for r in own for t in r.ids] and len(whole[s].ids) <= 64 and whole[s].doc_ids == [r.doc_id for r in own]
    assert "ids" not in packing.pack(df, WORDS, ids=False).columns and packing.pack(df.limit(0), WORDS).count() == 0
