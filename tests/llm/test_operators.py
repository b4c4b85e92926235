"""Each training-data operator against a brute-force version, and its edge cases."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foretrace.llm import bpe, chat, decontaminate, near_dup, pii, quality, secrets, substring_dedup, topk, warc
from foretrace.llm.common import new_path
from foretrace.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "é" * 700, "x" * 20000, "one two three four five six seven eight nine ten eleven", "\x00\t\n", "漢字 𝔘𝔫𝔦 \U0001f600"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ 1: tokens


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(1)
    texts = [*ODD, "<|endoftext|> don't", "a" * 5000, " \n\t " * 99, "".join(rnd.choice("abcd") for _ in range(900))]
    texts += ["".join(rnd.choice("abcdeé ß漢1.!\n'") for _ in range(80)) for _ in range(60)]
    docs = documents(spark, texts).withColumn("IDS", F.lit(1))
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(coded.columns) == ["doc_id", "ids", "source", "text"]
    back = bpe.decode(coded, RANKS).collect()
    assert len(back) == len(texts)
    for r in back:
        assert r["ids"] == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    packed = {r.doc_id: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in back:
        raw = np.array(r["ids"], "<u4").tobytes()
        assert packed[r.doc_id].n_tokens == len(r["ids"]) and packed[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_drops_from_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 20)
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    texts = [prose(random.Random(i), 9) for i in range(20)]
    assert [b.decode() for b in codec.decode(codec.encode(texts, public_tokenizers.PATTERN))] == texts


def test_bpe_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 12)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1)
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    learned, learn = Counter(), codec.learn
    codec.learn = lambda pieces: (learned.update(pieces), learn(pieces))
    texts = [t for i in range(20) for t in ("qzqz wqwq xzxz", " ".join(f"rare{chr(97 + i)}{chr(97 + k)}" for k in range(5)))]
    ids = codec.encode(texts, public_tokenizers.PATTERN)
    assert [b.decode() for b in codec.decode(ids)] == texts
    assert [learned[p] for p in ("qzqz", " wqwq", " xzxz")] == [1, 1, 1] and len(codec.met) <= 12
    known = codec.ranks[b"the"]
    assert codec.decode([np.array(x, "<u4").tobytes() for x in ([known, 900_000, known], [], [900_000], [known])]) == [b"thethe", b"", b"", b"the"]


def leftmost_first(raw, ranks):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("rounds", [1, 16])
def test_long_pieces_equal_one_contraction_at_a_time(monkeypatch, rounds):
    monkeypatch.setattr(bpe, "ROUNDS", rounds)
    monkeypatch.setattr(bpe, "TOKENS_A_QUERY", 40)
    for seed in range(15):
        rnd = random.Random(seed)
        pool = [b"a", b"b", b"c"]
        for _ in range(rnd.randint(5, 60)):
            pool.append(rnd.choice(pool)[:6] + rnd.choice(pool)[:6])
        longer = sorted({t for t in pool if len(t) > 1})
        rnd.shuffle(longer)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(longer)}
        codec = bpe.Codec(ranks)
        for size in (2, 40, 150):
            raw = bytes(rnd.choice(b"abcd") for _ in range(size))
            assert codec.contract(raw) == leftmost_first(raw, ranks), (seed, raw)


def test_very_long_pieces():
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    codec = bpe.Codec(ranks)
    for text in ("a" * 300_000, "".join(rnd.choice(["the", "ing", "é", "漢", "q", "Zx"]) for _ in range(50_000))):
        assert np.frombuffer(codec.encode([text], public_tokenizers.PATTERN)[0], "<u4").tolist() == reference.encode_ordinary(text)


# ------------------------------------------------------------------ 2: search


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    vectors = [rnd.normal(0, 0.3, 8).tolist() for _ in range(300)] + [[0.5] * 8] * 40
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [0.1] * 7 + [None]), (902, [0.1] * 7 + [float("nan")]), (903, [float("inf")] * 8), (904, [1.0, 2.0]), (None, [0.1] * 8), (20, vectors[20]), (920, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = [(i, r, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for i, r, q in whole:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, s) for j, s, v in whole if s != r and len(v) == len(q))[:20]
            expected += [(i, n, j, -score) for n, (score, j, _) in enumerate(found, 1)]
    for block in (topk.BLOCK, 64):
        got = topk.top_k(table, F.col("vec_id") % 20 == 0, 20, block=block)
        assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_top_k_stops_on_proof():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 12, (150, 64))
    vectors = np.floor(centres[rnd.integers(0, 150, 6000)] + rnd.normal(0, 2, (6000, 64))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(6000), np.arange(6000), vectors)
    queries = vectors[:200].astype(float)
    hits, proven = index.search(queries, np.arange(200), 20, np.full(200, -np.inf))
    scores = vectors[:200] @ vectors.T
    np.fill_diagonal(scores, scores.min() - 1)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert proven > 150 and len(hits) == 4000
    assert {(q, v, s) for q, v, _, s in hits} == {(q, int(v), int(scores[q, v])) for q in range(200) for v in best[q]}
    assert index.work[0] < 0.6 * index.work[1]
    weak = topk.ImpactIndex(np.arange(50), np.arange(50), vectors[:50] // 8)
    least = np.take_along_axis(scores, best[:, -1:], 1)[:, 0].astype(float)
    assert (weak.bounds(queries) >= (vectors[:200] @ (vectors[:50] // 8).T).max(axis=1)).all() and (weak.bounds(queries) < least).sum() > 150
    assert not weak.search(queries, np.full(200, -1), 20, least)[0]


def test_top_k_stops_without_clusters():
    """Vectors of no structure: small impacts are left out on proof all the same, and results are exact."""
    rnd = np.random.default_rng(8)
    vectors = rnd.normal(size=(4000, 64))
    vectors = np.floor(64 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), np.arange(4000), vectors)
    hits, proven = index.search(vectors[:100].astype(float), np.arange(100), 20, np.full(100, -np.inf))
    scores = vectors[:100] @ vectors.T
    np.fill_diagonal(scores, scores.min() - 1)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert {(q, v) for q, v, _, _ in hits} == {(q, int(v)) for q in range(100) for v in best[q]}
    assert proven == 100 and index.work[0] < 0.95 * index.work[1]


def test_top_k_queries_are_spread_and_pruned(spark, monkeypatch):
    """No cell has all queries, and a block out of reach is shipped none."""
    rnd = np.random.default_rng(9)
    vectors = np.r_[rnd.normal(0, 1, (600, 8)) * 4, rnd.normal(0, 0.05, (600, 8))].tolist()
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    seen, original = [], topk.in_cells
    monkeypatch.setattr(topk, "in_cells", lambda both, *more: seen.append(both) or original(both, *more))
    monkeypatch.setattr(topk, "SLICE", 40)
    got = topk.top_k(table, F.col("vec_id") % 5 == 0, 4, block=100)
    assert got.count() == 240 * 4
    home, others = (b.filter("_side = 1").groupBy("_block", "_slice").count().collect() for b in seen)
    assert len(home) >= 10 and max(r["count"] for r in home) < 60
    assert max(r["count"] for r in others) < 80 and sum(r["count"] for r in others) < 240 * 9


# ------------------------------------------------------------------ 3: personal data

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_pii(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return True


def pii_spans(text):
    return sorted((m.start(), rank, m.end()) for rank, kind in enumerate(PII) for m in re.finditer(PII[kind], text or "") if is_pii(kind, m[0]))


def test_pii_base_spans(spark):
    rnd = random.Random(5)
    texts = [*ODD, "a@b.c_x@y.org", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.004", "4485 1638 9022 5519 12", "+1 (017) 555-7713 +49 30 1234567.", "9" * 3000, "1 " * 900, "a@" * 900]
    texts += ["".join(rnd.choice("0123456789 .-+()@ab%é\n") for _ in range(60)) for _ in range(400)]
    texts += [f"x {rnd.randrange(10**11, 10**20)} {rnd.randrange(10**15, 10**16)}" for _ in range(400)]
    docs = documents(spark, texts).withColumn("Base_Spans", F.lit(1))
    got = pii.find(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r.base_spans] == pii_spans(r.text)
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.all_spans))
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_bootstrap(spark):
    texts = [f"please call +1 (555) 555-01{i:02d} now" for i in range(40)] + ["please call 5550123456 now", "room 12345678 here", None]
    got = {r.doc_id: r for r in pii.redacted(documents(spark, texts)).collect()}
    assert got[3].text == "please call [PHONE] now" and got[40].text == "please call [PHONE] now"
    assert got[41].text == texts[41] and got[42].text is None


PII_EDGE, PII_IN = r"""(?<![^\s"'(<\[{=:;,|])""", r"""[^\s"'(<\[{=:;,|)>\]}]"""
PII_OPEN = rf"""{PII_EDGE}(?:\+?+[0-9]++(?:[\x20().-]{{1,2}}+[0-9]++)++(?![\p{{L}}\p{{N}}@])|(?={PII_IN}*[0-9@]){PII_IN}*[\p{{L}}\p{{N}}])"""


def plain_bootstrap(texts):
    """The bootstrap in plain Python: the added (doc, start, rank, end)."""
    import regex

    edges, spots = Counter(), []
    for doc, text in enumerate(texts):
        base = pii_spans(text)
        found = [(k, [m for m in regex.finditer(pattern, text)]) for k, pattern in [*enumerate(PII.values()), (None, PII_OPEN)]]
        for rank, all_matches in found:
            for at, m in enumerate(all_matches):
                if rank is None and (m.end() - m.start() < 4 or any(a < m.end() and m.start() < b for a, _, b in base)):
                    continue
                if rank is not None and (m.start(), rank, m.end()) not in base:
                    continue
                gap = text[all_matches[at - 1].end() if at else 0 : m.start()]
                rest = text[m.end() : all_matches[at + 1].start() if at + 1 < len(all_matches) else len(text)]
                words = regex.split("[\n\x0b\f\r]", gap[-80:])[-1].replace("\t", " ").split(" ")
                words = [w for w in words if w][-2:]
                after = rest[:80].split()[0] if rest.split() and not rest.startswith("\n") else None
                fold = lambda w: regex.sub("[0-9]", "0", w.lower())
                of = [("1", fold(words[-1]))] if words else []
                of += [("2", *map(fold, words))] if len(words) == 2 else []
                of += [("3", fold(words[-1]), fold(after))] if words and after else []
                spots.append((doc, m.start(), rank, m.end(), m[0], of))
                edges.update((p, rank, m[0]) for p in of)
    kind = {}

    def confidence():
        total, known, values = Counter(), Counter(), Counter()
        for (p, rank, value), n in edges.items():
            values[p, rank] += 1
            rank, share = kind.get(value, (None, 0)) if rank is None else (rank, 1)
            total[p] += n
            known[p, rank] += n * share
        return {(p, k): known[p, k] / total[p] for p, k in known if k is not None and values[p, k] >= pii.SUPPORT}

    while True:
        sure, grown = confidence(), False
        doubt = {}
        for p, rank, value in edges:
            if rank is None and value not in kind:
                for k in range(4):
                    if sure.get((p, k), 0) >= pii.FLOOR:
                        doubt[value, k] = doubt.get((value, k), 1) * (1 - min(sure[p, k], 0.999999))
        for value in {v for v, _ in doubt}:
            best = max((1 - doubt[value, k], -k) for k in range(4) if (value, k) in doubt)
            if best[0] >= pii.ACCEPT:
                kind[value], grown = (-best[1], best[0]), True
        if not grown:
            break
    return {(doc, a, kind[v][0], b) for doc, a, rank, b, v, of in spots if rank is None and v in kind and any(sure.get((p, kind[v][0]), 0) >= pii.ACCEPT for p in of)}


def test_pii_bootstrap_equals_plain_python(spark):
    rnd = random.Random(47)
    number = lambda: f"+1 (555) 555-{rnd.randrange(10**4):04d}"
    texts = [f"you can reach me at {number()} today" for _ in range(30)] + [f"mail goes to u{i}@mail.example.com always" for i in range(20)]
    texts += [f"you can reach me at {x} today" for x in ("555 123 4567", "ext-88231", "0049-30-12", "@bob_77")] + ["mail goes to carol@intranet always", "contact desk ext-88231 now"] * 8
    texts += [f"contact desk line-{i:04d} now" for i in range(3)] + [f"room {i}5 and page {i}{i} of AB-{i}99 there" for i in range(40)] + ["item 4444 555 66\nnext 7777"]
    texts += [f"see page {number() if rnd.random() < 0.5 else rnd.randrange(10**6)} there" for _ in range(40)]
    rows = pii.find(documents(spark, texts)).collect()
    got = {(r.doc_id, *s) for r in rows for s in map(tuple, r.all_spans) if s not in map(tuple, r.base_spans)}
    assert got == plain_bootstrap(texts)
    said = {texts[d][a:b] for d, a, _, b in got}
    assert {"555 123 4567", "ext-88231", "0049-30-12", "@bob_77", "carol@intranet"} <= said and not [x for x in said if x.startswith("AB-")]


def pii_added(spark, texts):
    rows = pii.find(documents(spark, texts)).collect()
    got = {(r.doc_id, *s) for r in rows for s in map(tuple, r.all_spans) if s not in map(tuple, r.base_spans)}
    assert got == plain_bootstrap(texts)
    return [texts[d][a:b] for d, a, _, b in sorted(got)]


@pytest.mark.parametrize("lead", ["Phone: ", "see\nPhone:\t", "My Phone: ", "My  Phone:"])
def test_pii_contexts_of_one_word(spark, lead):
    texts = [f"{lead}+1 (555) 555-{i:04d}" for i in range(60)] + [f"{lead}555 123 {i:04d}" for i in range(5)]
    assert pii_added(spark, texts) == [f"555 123 {i:04d}" for i in range(5)]


def test_pii_weak_patterns_do_not_add_up(spark):
    """Five years stand in twelve patterns of which a quarter is phones; no year becomes one anywhere."""
    texts = []
    for k in range(12):
        texts += [f"ctx{chr(97 + k)} wrote +1 (555) 5{k:02d}-{i:04d} then" for i in range(6)] + [f"ctx{chr(97 + k)} wrote {2016 + i} then" for i in range(5)]
        texts += [f"ctx{chr(97 + k)} wrote room-{k}{i}9 then" for i in range(14)]
    years = [f"In the year {2016 + i} it was" for i in range(5)] * 9 + [f"In the year {1900 + i} it was" for i in range(98)]
    assert pii_added(spark, texts + years) == []


def test_pii_found_values_strengthen_a_pattern(spark):
    """A value found in one pattern counts in another by its confidence, which then gives the next value."""
    phones = [f"+1 (555) 777-{i:04d}" for i in range(40)]
    texts = [f"kindly ring {p} soon" for p in phones] + ["kindly ring desk-4711 soon"] * 2
    texts += [f"ask under {p} first" for p in phones[:14]] + ["ask under desk-4711 first"] * 6 + ["ask under desk-0815 first"]
    found = pii_added(spark, texts)
    assert found.count("desk-4711") == 8 and "desk-0815" in found


def test_pii_of_many_spans_and_long_texts(spark):
    texts = [" ".join(f"a{i}@b.org,{'x' * (i % 7)}" for i in range(3000)), "é" * 70_000 + " a@b.org " + "z" * 140_000 + " 1.2.3.4 c@d.org1.2.3.4", "1.2.3.4@b.org"]
    for r in pii.redacted(documents(spark, texts)).collect():
        out, at = [], 0
        for a, rank, b in pii_spans(texts[r.doc_id]):
            if a >= at:
                out.append(texts[r.doc_id][at:a] + f"[{list(PII)[rank].upper()}]")
            at = max(at, b)
        assert r.text == "".join([*out, texts[r.doc_id][at:]])


# ------------------------------------------------------------------ 4: repeated strings


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("large", [substring_dedup.GROUP_BYTES, 500])
def test_repeated_strings(spark, monkeypatch, large):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", large)
    rnd = random.Random(7)
    passage, line = prose(rnd, 90), prose(rnd, 20)
    texts = [*ODD, passage, "Der " * 300]
    for _ in range(30):
        words = prose(rnd, 60).split()
        at = rnd.randrange(60)
        texts.append(" ".join(words[:at] + [rnd.choice([passage, line, passage[: rnd.randrange(150, 400)], ""])] + words[at:]))
    texts += [texts[-1], texts[-2] + "é"]
    got = substring_dedup.remove_repeats(documents(spark, texts).withColumn("kept", F.lit(0))).collect()
    assert len(got) == len(texts)
    expected = brute_repeats(texts, 200)
    for r in got:
        n, removed, spans, kept = expected[r.doc_id]
        assert (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) == (n, removed, spans, kept), r.doc_id
    assert substring_dedup.remove_repeats(documents(spark, texts).limit(0)).count() == 0


def test_bwt_intervals_against_counting():
    rnd = random.Random(3)
    for _ in range(60):
        length, base = rnd.choice([3, 8, 20]), bytes(rnd.choice(b"ab") for _ in range(80))
        hulls = []
        for _ in range(rnd.randint(1, 12)):
            h = bytearray(base[(a := rnd.randint(0, 40)) : a + rnd.randint(length, 40)])
            h[rnd.randrange(len(h))] = rnd.choice(b"abc")
            hulls.append(bytes(h))
        data = np.frombuffer(b"\0".join(hulls) + b"\0", np.uint8).astype(np.int16) + 1
        ends = np.cumsum([len(h) + 1 for h in hulls])
        data[ends - 1] = 0
        found = substring_dedup.repeated_starts(data, length)
        often = Counter(h[i : i + length] for h in hulls for i in range(len(h) - length + 1))
        for h, end in zip(hulls, ends.tolist(), strict=True):
            assert found[end - 1 - len(h) : max(end - length, end - 1 - len(h))].tolist() == [often[h[i : i + length]] > 1 for i in range(len(h) - length + 1)]


# ------------------------------------------------------------------ 5: secrets

SECRETS = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def test_secret_base_spans(spark):
    rnd = random.Random(9)
    texts = [*ODD, "TOKEN = 'abcdefghijkl' apikey:short API_key='ABCDEFGHIJKLMNOP", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 16 + "g" + "0" * 15, "ſecret=abcdefghijklmn"]
    texts += [rnd.choice(["token: ", "passwd=", "x "]) + "".join(rnd.choice("abcdef0123456789AKI-=") for _ in range(40)) for _ in range(200)]
    got = secrets.find(documents(spark, texts).withColumn("all_spans", F.lit(2))).collect()
    for r in got:
        expected = sorted((m.start(), k, m.end()) for k, p in enumerate(SECRETS) for m in p.finditer(r.text or "") if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k])
        assert [tuple(s) for s in r.base_spans] == expected
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.all_spans))
    assert secrets.find(documents(spark, texts).limit(0)).count() == 0


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def ordinary(rnd, n=300):
    """Texts of pronounceable words, by which the battery is set."""
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    return [" ".join(rnd.choice(words).capitalize() if k % 12 == 0 else rnd.choice(words) for k in range(200)) for _ in range(n)]


def plain_randomness(token, chars):
    """The battery in plain Python, with the library's exact normal tail."""
    import math

    n, size, at = len(token), len(chars), [chars.index(c) for c in token]
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))

    def chi(x, degrees):
        if degrees % 2 == 0:
            return min(1.0, sum(math.exp(-x / 2) * (x / 2) ** k / math.factorial(k) for k in range(degrees // 2)))
        third = 2 / (9 * degrees)
        return tail(((x / degrees) ** (1 / 3) - 1 + third) / math.sqrt(third))

    groups = max(2, min(8, n // 5))
    expected = [n * sum(s * groups // size == g for s in range(size)) / size for g in range(groups)]
    uniform = chi(sum((sum(s * groups // size == g for s in at) - e) ** 2 / e for g, e in enumerate(expected)), groups - 1)
    up = sum(s >= size // 2 for s in at)
    mean = 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    changes = 1 + sum((a >= size // 2) != (b >= size // 2) for a, b in zip(at, at[1:], strict=False))
    runs = 2.0 ** (1 - n) if up in (0, n) else 2 * tail(abs(changes - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centre = sum(at) / n
    power = sum((s - centre) ** 2 for s in at)
    lagged = sum((a - centre) * (b - centre) for a, b in zip(at, at[1:], strict=False))
    serial = 2 * tail(abs(lagged / power * math.sqrt(n) + 1 / math.sqrt(n))) if power else 0.0
    return chi(-2 * sum(math.log(min(1.0, max(p, 1e-300))) for p in (uniform, runs, serial)), 6)


def test_battery_equals_plain_python():
    import math

    rnd = random.Random(10)
    for name, chars in secrets._ALPHABETS:
        for n in (20, 21, 33, 64, 200):
            tokens = ["".join(rnd.choices(chars, k=n)) for _ in range(6)] + ["".join(rnd.choices(chars[:3] + chars[-1], k=n)), chars[0] * n, chars[0] * (n - 1) + chars[-1]]
            got = secrets.randomness(np.array([[chars.index(c) for c in t] for t in tokens]), len(chars))
            for p, t in zip(got, tokens, strict=True):
                assert math.isclose(p, plain_randomness(t, chars), rel_tol=0.02, abs_tol=1e-9), (name, t)


def test_control_equals_plain_benjamini_hochberg():
    rnd = random.Random(12)
    seen = [("s", rnd.randint(0, 60) + 20 * (rnd.random() < 0.99), 1) for _ in range(3000)]
    tokens = [("s", rnd.choice([rnd.randint(0, 10), rnd.randint(0, 80)]), 1) for _ in range(200)]
    p = secrets.p_values(seen)
    each = sorted((1 + sum(c <= t for _, c, _ in seen)) / (1 + len(seen)) for _, t, _ in tokens)
    found = max([0, *(k for k, x in enumerate(each, 1) if x <= secrets.RATE * k / len(each))])
    limit = secrets.limits(tokens, p)["s"]
    assert 0 < found == sum(t <= limit for _, t, _ in tokens) < 200
    assert secrets.limits([], {}) == {} and secrets.limits([("t", 0, 5)], p) == {"s": -1}


def test_randomness_battery(spark):
    rnd = random.Random(11)
    keys = ["".join(rnd.choice(LETTERS) for _ in range(40)) for _ in range(100)]
    words = ["Internationalization2Configuration", "com/example/project/module/v2/Main", "the_quick_brown_fox_jumps_over_1", "a" * 30 + "1", LETTERS]
    docs = documents(spark, keys + words * 5 + ["password=" + keys[0], "password=gggggggggggggggggggggggggg1"] + ordinary(rnd)).coalesce(2)
    got = secrets.find(docs).collect()
    found = {r.doc_id: sum(s.rank == 3 for s in r.all_spans) for r in got}
    assert sum(found[i] for i in range(100)) >= 90 and sum(found[i] for i in range(100, len(found))) == 0
    judged = {r.doc_id: r.judged for r in got if r.base_spans}
    assert [(j.encoding, j.random) for j in judged[125] + judged[126]] == [("base62", True), ("base62", False)] and judged[125][0].p < 0.01 < judged[126][0].p


@pytest.mark.parametrize("before", ["NAME=", "{'x':'", "https://h/?a=1&sig="])
def test_keys_after_marks(spark, before):
    rnd = random.Random(37)
    texts = [f"see {before}{''.join(rnd.choice(LETTERS) for _ in range(40))} there" for _ in range(60)]
    got = secrets.find(documents(spark, texts + ordinary(rnd)).coalesce(2)).collect()
    start = 4 + len(before)
    assert sum((start, 3, start + 40) in [tuple(s) for s in r.all_spans] for r in got) >= 54
    assert not [r.doc_id for r in got if r.doc_id >= 60 and r.all_spans]


def test_secrets_depend_on_no_partition_batch_or_order(spark):
    """Short texts, each cut by itself: the null is the same however rows are dealt out."""
    rnd = random.Random(53)
    texts = [" ".join(t.split()[: rnd.randint(6, 14)]) for t in ordinary(rnd, 3000)]
    texts[::250] = [f"see {''.join(rnd.choice(LETTERS) for _ in range(40))} there" for _ in texts[::250]]
    texts += [f"token = {''.join(rnd.choice(LETTERS) for _ in range(32))}" for _ in range(9)] + ["token = internationalization1234"] * 3
    docs, seen = documents(spark, texts), set()
    for parts, batch in ((1, 10_000), (7, 10_000), (200, 10_000), (3, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rows = secrets.find(docs.repartition(parts, F.xxhash64("doc_id", F.lit(parts))), keep=["doc_id"]).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        seen.add(tuple(sorted((r.doc_id, str(r.all_spans), str(r.judged)) for r in rows)))
    assert len(seen) == 1
    found = {r.doc_id for r in rows if any(s.rank == 3 for s in r.all_spans)}
    assert found == set(range(0, 3000, 250))
    judged = [r.judged[0].random for r in sorted(rows, key=lambda r: r.doc_id) if r.base_spans]
    assert judged == [True] * 9 + [False] * 3


def test_a_class_without_windows_takes_the_shorter_one():
    p = secrets.p_values([("hex/20", 3, 99), ("hex/40", 5, 9)])
    assert p["hex/28"] == p["hex/20"] and p["hex/160"] == p["hex/40"] and "base62/20" not in p


def test_long_tokens_are_judged_whole(spark):
    rnd = random.Random(41)
    draw = lambda n: "".join(rnd.choices(LETTERS, k=n))
    tokens = [draw(512) + LETTERS * 40, draw(600) + "z1" * 1500, LETTERS * 9 + draw(400_000)]
    got = {r.doc_id: [tuple(s) for s in r.all_spans] for r in secrets.find(documents(spark, tokens + ordinary(rnd)).coalesce(2)).filter("doc_id < 3").collect()}
    assert got == {0: [], 1: [], 2: [(0, 3, len(tokens[2]))]}


def test_tail_functions():
    assert abs(secrets.chi_squared_tail(11.07, 5) - 0.05) < 0.002 and abs(secrets.chi_squared_tail(12.592, 6) - 0.05) < 1e-4


# ------------------------------------------------------------------ 6: archives


def test_archive_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\n", "é" * 500, "<p>a</p>", "a\nb\r\n\r\nc"]
    rows = [(i if i != 6 else 1, f"http://x/{i}\n", h) for i, h in enumerate(html)] + [(None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    path = new_path(spark, "test-warc")
    warc.write(pages, path)
    read = warc.read(spark, path)
    assert read.filter("reason IS NOT NULL").count() == 0
    got = sorted(map(tuple, warc.digests(read).collect()), key=str)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert sorted((r[:3] for r in got), key=str) == sorted(expected, key=str)
    assert Counter((r[3], r[4]) for r in got) == {("response", None): 6, ("revisit", 0): 2, ("revisit", 2): 1}
    empty = new_path(spark, "test-warc")
    warc.write(pages.limit(0), empty)
    assert warc.digests(warc.read(spark, empty)).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string")
    assert warc.records(pages, min_bytes=3).filter("refers_to IS NOT NULL").count() == 0


def record(payload):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(b"payload %d" % i)) for i in range(5)]
    whole = b"".join(parts)
    assert [x[3] for x in warc.salvage(whole)] == [b"payload %d" % i for i in range(5)]
    broken = parts[0] + parts[1][:15] + b"???" + parts[2] + parts[3][:-3] + parts[4]
    out = list(warc.salvage(broken))
    assert [x[3] for x in out if x[2] is not None] == [b"payload 0", b"payload 2", b"payload 4"]
    gaps = [x[:2] for x in out if x[2] is None]
    assert gaps[0] == (len(parts[0]), len(parts[0]) + 18) and len(gaps) == 2
    assert list(warc.salvage(b"")) == [] and [x[:2] for x in warc.salvage(b"junk")] == [(0, 4)]
    assert [x[2] is None for x in warc.salvage(whole[:-2])] == [False] * 4 + [True]


def test_archive_keeps_long_urls_and_pages(spark):
    long = "0123456789abcdef" * (50 << 16)
    rows = [(1, "data:," + "x" * (1 << 20), "<p>a</p>"), (2, "http://x/2", "<p>a</p>"), (3, "data:," + "y" * 70_000, None), (4, "http://x/4", long), (5, "data:," + "z" * (20 << 20), "b")]
    path = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    got = warc.read(spark, path).collect()
    assert all(r.reason is None for r in got) and sorted(r.uri for r in got) == sorted(r[1] for r in rows)
    assert {r.payload_bytes for r in got} == {0, 1, 8, len(long)} and any(bytes(r.payload or b"") == long.encode() for r in got)
    assert [x[2] is None for x in warc.salvage(b"WARC/1.1\r\nno end\r\n" + record(b"good"))] == [True, False]


def response(i, rnd):
    payload = rnd.randbytes(3000)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d:0>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 3000\r\n\r\n"
    return head % (i, warc.payload_digest(payload).encode()) + payload + b"\r\n\r\n", payload


def test_salvage_inside_members():
    rnd = random.Random(31)
    pairs = [response(i, rnd) for i in range(100)]
    raw, payloads = [p[0] for p in pairs], [p[1] for p in pairs]
    good = lambda data: [x[3] for x in warc.salvage(data) if x[2] is not None]
    gaps = lambda data: [x[:2] for x in warc.salvage(data) if x[2] is None]
    whole = gzip.compress(b"".join(raw))
    assert good(whole) == payloads and not gaps(whole) and len(whole) > 2 * warc.STEP
    one_bad = gzip.compress(b"".join([*raw[:40], raw[40][:-9] + b"x" + raw[40][-8:], *raw[41:]]))
    assert good(one_bad) == payloads[:40] + payloads[41:]
    cut = whole[: len(whole) * 3 // 4]
    kept = good(cut)
    assert 70 <= len(kept) < 76 and kept == payloads[: len(kept)] and gaps(cut) == [(0, len(cut))]
    after = cut + gzip.compress(raw[99])
    assert good(after)[: len(kept)] == kept and good(after)[-1] == payloads[99]
    bare = gzip.compress(b"".join(record(b"%05d" % i * 40) for i in range(50)))
    assert len(good(bare[:-9])) >= 40


def plain_repair(roles):
    """(action, new roles) of each turn on the way of least cost whose options come first, by keeping whole ways."""
    best = {3: (0, ())}
    for role in roles:
        after = {}
        for state, (cost, way) in best.items():
            for place, (more, action, new) in enumerate(chat._options(state, role if role < 3 else -1)):
                to, found = new[-1] if new else state, (cost + more, (*way, (place, action, new)))
                after[to] = min(after.get(to, found), found)
        best = after
    return min((cost + chat.INSERT * len(chat.ending(s)), [w[0] for w in way], way, s) for s, (cost, way) in best.items())


@pytest.mark.parametrize(("block", "partitions"), [(1024, 4), (1, 7), (3, 1), (3, 16)])
def test_role_repair(spark, block, partitions):
    rnd = random.Random(13)
    names = ["system", "user", "assistant", None, "robot", " User "]
    rows = [(c, t, rnd.choice(names), rnd.choice([None, "", f"t{t}"])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(None, None, "user", "x"), (7, 0, "user", "again"), (7, 0, "user", "again"), *((61, t, r, "") for t, r in enumerate(["user", None, "assistant", "assistant"]))]
    rows += [(62, t, rnd.choice(names), f"t{t}") for t in range(200)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit(1)).withColumn("part", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = chat.repair(turns, block).orderBy("conv_id", "block", "seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.action != "insert" for r in got) == len(rows)
    first = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2])
    for conv in {r.conv_id for r in got}:
        own = [r for r in got if r.conv_id == conv]
        given = sorted(((t, r.strip().lower() if r is not None else None, x or "") for c, t, r, x in rows if c == conv), key=first)
        _, _, way, end = plain_repair([chat._number(r) for _, r, _ in given])
        expected = []
        for (turn, role, text), (_, action, new) in zip(given, way, strict=True):
            expected += [("insert", None, chat.ROLES[x]) for x in new[:-1]]
            expected.append((action, turn, chat.ROLES[new[-1]] if new else expected[-1][2]))
        expected += [("insert", None, chat.ROLES[x]) for x in chat.ending(end)]
        assert [(r.action, r.turn, r.role) for r in own] == expected
        places = [k // block for k, r in enumerate(x for x in own if x.action != "insert")]
        assert [r.block for r in own if r.action != "insert"] == places
        rendered = re.findall(r"<\|(\w+)\|>", "".join(r.piece for r in own))
        assert all(chat.ROLES.index(x) in chat._NEXT[chat.ROLES.index(y) if y else 3] for x, y in zip(rendered, [None, *rendered], strict=False)) and rendered[-1] == "assistant"
    assert chat.repair(turns.limit(0)).count() == 0


# ------------------------------------------------------------------ 8: near duplicates


def brute_groups(texts, width, threshold):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [(i, len(sets[i]), top(i), top(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("leaf", [near_dup.LEAF, 6])
def test_near_duplicates(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dup, "LEAF", leaf)
    rnd = random.Random(17)
    texts = [*ODD, "a b", "A  b", "b a"]
    for _ in range(12):
        words = prose(rnd, 60).split()
        for _ in range(rnd.randint(1, 9)):
            copy = list(words)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(60)] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += texts[-3:]
    docs = documents(spark, texts).withColumn("kept", F.lit(1))
    got = near_dup.near_duplicates(docs, 2, 80).collect()
    assert sorted(map(tuple, got)) == brute_groups(texts, 2, 80)
    if leaf == near_dup.LEAF:
        left = near_dup.deduplicated(docs, 2, 80)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [r[0] for r in brute_groups(texts, 2, 80) if r[3]]
        assert near_dup.near_duplicates(docs.limit(0)).count() == 0
        nulls = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "x y z"), (None, "q r s"), (None, None)], "doc_id bigint, text string")
        assert sorted(map(tuple, near_dup.near_duplicates(nulls).collect()), key=str) == sorted([(None, 1, 5, False), (None, 1, 5, False), (5, 1, 5, True), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_large_nodes_make_rows_in_proportion_and_keep_each_pair(spark, monkeypatch):
    wide = 20 * near_dup.WIDE // near_dup.LEAF
    monkeypatch.setattr(near_dup, "LEAF", 20)
    monkeypatch.setattr(near_dup, "WIDE", wide)
    rnd, made = np.random.default_rng(9), []
    heads = list(range(near_dup.TREES))
    for n in (60, 120):
        sizes = [4, 5, 80, 100, 125, 1600, 2000] + [int(1.25 ** (rnd.random() * 34)) + 1 for _ in range(n - 7)]
        rows = [(i, x, 1, heads, bytearray(rnd.bytes(near_dup.VALUES // 2)), i) for i, x in enumerate(sizes)]
        classes = spark.createDataFrame(rows, "id bigint, n_shingles bigint, weight bigint, heads array<bigint>, sketch binary, root bigint")
        first = next(near_dup.cross_groups(classes, 80)).toPandas()
        made.append(len(first))
        together = {(a, b) for _, g in first.groupby("group") for a in g.id for b in g.id if a < b}
        assert len(together) and all((a, b) in together for a in range(n) for b in range(a + 1, n) if 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b]))
    assert made[1] <= 2.8 * made[0] and made[1] <= 2 * near_dup.TREES * 120


@pytest.mark.parametrize("wide", [near_dup.WIDE, 6])
def test_recall_of_near_duplicates_at_any_depth(spark, monkeypatch, wide):
    """600 pairs at similarity 0.8 that all lie in the same crowded nodes; LEAF is small so that these branch."""
    monkeypatch.setattr(near_dup, "LEAF", 6)
    monkeypatch.setattr(near_dup, "WIDE", wide)
    rnd = np.random.default_rng(23)
    base = rnd.integers(0, 1 << 62, near_dup.VALUES, np.uint64)
    change = lambda row, share: np.where(rnd.random(near_dup.VALUES) < share, rnd.integers(0, 1 << 62, near_dup.VALUES, np.uint64), row)
    rows, expected = [], set()
    for i in range(600):
        one = change(base, 0.3)
        other = change(one, 0.2)
        both = [near_dup._packed(x) for x in (one, other)]
        rows += [(2 * i + k, 100, 1, [int(h) for h in least[: near_dup.TREES]], bytearray(s), 2 * i + k) for k, least, s in zip((0, 1), (one, other), both, strict=True)]
        differ = np.frombuffer(both[0], np.uint8) ^ np.frombuffer(both[1], np.uint8)
        if ((differ & 15) == 0).sum() + ((differ & 240) == 0).sum() >= near_dup.candidate(80):
            expected.add((2 * i, 2 * i + 1))
    classes = spark.createDataFrame(rows, "id bigint, n_shingles bigint, weight bigint, heads array<bigint>, sketch binary, root bigint")
    got = set()
    for groups in near_dup.cross_groups(classes, 80):
        held = near_dup.with_partners(groups, 80).toPandas().sort_values("group", kind="stable")
        for _, part in held.groupby("group"):
            left, right = near_dup.possible_pairs(pa.Table.from_pandas(part, preserve_index=False), 80)
            ids = part["id"].to_numpy()
            got |= {tuple(sorted(x)) for x in zip(ids[left].tolist(), ids[right].tolist(), strict=True)}
    assert len(expected) > 590 and expected <= got


def test_common_items_and_forests():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 9000, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    for keep in (slice(None), slice(0, 5)):
        assert near_dup.common_items(sets, i[keep], j[keep]).tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i[keep], j[keep], strict=True)]
    for n in (0, 1, 40, 400):
        a, b = rnd.integers(0, 300, n), rnd.integers(0, 300, n)
        low, other = near_dup.forest(a, b)
        group = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(300):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                group[x] = group[y] = min(group[x], group[y])
        assert {(int(y), int(x)) for x, y in zip(low, other, strict=True)} == {(x, g) for x, g in group.items() if x != g} and len(low) == len(set(other.tolist()))


def test_miss_rate_by_depth():
    trees = near_dup.trees_at(80)
    assert len(trees) == near_dup.DEEPEST + 1 and all(near_dup.miss_rate(0.8, d, n) <= near_dup.MISS for d, n in enumerate(trees))
    rnd, n = np.random.default_rng(29), 40_000
    for depth, count in enumerate(trees):
        heads, values = rnd.random((n, near_dup.TREES)) < 0.8, rnd.random((n, near_dup.VALUES // 2)) < 0.8125**2
        together = np.zeros(n, bool)
        for t in range(count):
            together |= heads[:, t % near_dup.TREES] & values[:, near_dup._PATHS[t, :depth]].all(axis=1)
        assert (~together).sum() <= 4


@pytest.mark.parametrize("threshold", [50, 5])
def test_near_duplicates_at_small_thresholds(spark, threshold):
    texts = []
    for i in range(40):
        words = [f"p{i}w{j}" for j in range(60)]
        keep = 41 + i % 3 if threshold == 50 else 7 + i % 3
        texts += [" ".join(words), " ".join(words[:keep] + [f"q{i}w{j}" for j in range(60 - keep)])]
    got = sorted(map(tuple, near_dup.near_duplicates(documents(spark, texts), 2, threshold).collect()))
    assert got == brute_groups(texts, 2, threshold) and len({r[2] for r in got}) == 40


def test_bounds_by_threshold():
    assert (near_dup.candidate(80), near_dup.heads_for(80)) == (86, 12) and near_dup.trees_at(50) == (17,)
    assert near_dup.candidate(60) < 68 and near_dup.candidate(100) == near_dup.VALUES
    assert near_dup.heads_for(100) == 12 and near_dup.heads_for(5) == near_dup.heads_for(0) == 0


def test_components(spark):
    pairs = [(b"a", b"b"), (b"b", b"c"), (b"x", b"y"), (b"z", b"y"), (b"c", b"a"), (b"q", b"q")] + [(bytes([200, i]), bytes([200, i + 1])) for i in range(40)]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")).collect()}
    assert {k: got[k] for k in (b"a", b"b", b"c", b"x", b"y", b"z")} == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x", b"z": b"x"}
    assert all(got[bytes([200, i])] == bytes([200, 0]) for i in range(41)) and b"q" not in got


# ------------------------------------------------------------------ 9: quality


def test_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.scored(docs.withColumn("score", F.lit("x")), labels)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) >= 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_quality_without_labels(spark):
    docs = documents(spark, ODD).unionByName(spark.createDataFrame([(None, "x", None)], "doc_id bigint, text string, source string"))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, None) for i in range(9)] + [(3, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in quality.scored(docs, one).collect()} == {1}
    assert quality.scored(docs.limit(0), one).count() == 0
    assert quality.kept(docs, one).columns == docs.columns


def test_rules_of_a_description():
    lines = ["DecisionTreeClassificationModel", "  Tree 0 (weight 1.0):", "    If (feature 1 <= 0.5)", "     If (feature 0 <= 2.0)", "      Predict: 0.0", "     Else (feature 0 > 2.0)", "      Predict: 1.0", "    Else (feature 1 > 0.5)", "     Predict: 1.0"]
    rules = [r.conditions for r in quality.tree_rules("\n".join(lines), ("a", "b"))]
    assert rules == [(("b", "<=", 0.5),), (("a", "<=", 2.0), ("b", "<=", 0.5)), (("a", ">", 2.0), ("b", "<=", 0.5)), (("b", ">", 0.5),)]


# ------------------------------------------------------------------ 10: decontamination


def brute_hits(text, items, n):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = find(text), set(), set()
    for item_id, item in items:
        own = find(item)
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(item_id)
    return len(words), len(hit), ids - {None}


@pytest.mark.parametrize("block", [decontaminate.MAX_BLOCK_BYTES, 200])
def test_decontamination(spark, block):
    rnd = random.Random(19)
    items = [(i, prose(rnd, rnd.choice([1, 3, 9, 10, 14]), 3000)) for i in range(20)] + [(30, None), (31, ""), (32, "Ünï-cödé X"), (None, "lost item words"), (2, "second text of two")]
    texts = [*ODD, "lost item words"]
    for _ in range(60):
        words = prose(rnd, 40, 3000).split()
        leak = (rnd.choice(items)[1] or "").upper().split()
        cut = rnd.choice([0, 0, 1])
        texts.append(", ".join(words[:20] + leak[cut:] + words[20:]))
    texts.append("ünï; CÖDÉ-x")
    docs = documents(spark, texts).withColumn("HIT_items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.scan(docs, bench, max_block_bytes=block).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, ids = brute_hits(r.text, items, 10)
        assert (r.n_words, sum(s.end - s.start for s in r.hit_words), r.hit_items) == (n, hit, sorted(map(str, ids)))
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == [c for c in docs.columns if c != "HIT_items"] or clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if brute_hits(t, items, 10)[1] == 0}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert all(brute_hits(cut[i], items[:1], 10)[1] == 0 or brute_hits(t, items[:1], 10)[1] == 0 for i, t in enumerate(texts)) and cut[0] is None
    assert decontaminate.scan(docs, bench.limit(0)).filter(F.size("hit_words") > 0).count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ columns of the input


CLASHES = ["rid", "row", "id", "key", "mark", "root", "node", "group", "n", "at", "of", "part", "start", "end", "value", "weight", "first", "_id", "_mark", "_again", "_row", "_RID", "_text", "_words", "_base", "_open", "_added", "_spans", "_score", "_values"]
CLASHES += ["score", "predicted", "held_out", *quality.STATISTICS, "n_words", "hit_words", "hit_items", "base_spans", "all_spans", "judged", "removed", "kept", "n_bytes", "ids", "decoded", "component_id"]


def clashing(spark, texts):
    docs = documents(spark, texts)
    return docs.select("*", *[F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias(name) for name in CLASHES])


def test_filters_keep_clashing_columns(spark):
    rnd = random.Random(53)
    passage = prose(rnd, 30)
    texts = [*ODD, passage, "mail me@x.org now", *[prose(rnd, 40) for _ in range(6)]]
    texts += [texts[-1], texts[-2]]
    docs = clashing(spark, texts)
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([("b1", passage)], "item_id string, text string")
    left = {"quality": quality.kept(docs, labels), "near": near_dup.deduplicated(docs), "leaks": decontaminate.drop_contaminated(docs, bench), "personal": pii.redacted(docs)}
    for name, out in left.items():
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and all(r[2:] == whole[r[0]][2:] and (r[1] == whole[r[0]][1] or "[EMAIL]" in r[1]) for r in rows), name
    assert left["near"].count() == len(texts) - 2 and left["leaks"].count() == len(texts) - 1 and left["personal"].count() == len(texts)


def test_added_columns_leave_the_others(spark):
    docs = clashing(spark, ["mail me@x.org now", "token=abcdefghijklmnop1", None, "x " * 300])
    whole = {r.doc_id: r.asDict() for r in docs.collect()}
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([("b1", "x")], "item_id string, text string")
    made = [(pii.find(docs), pii._ADDED), (secrets.find(docs), secrets._ADDED), (substring_dedup.remove_repeats(docs), substring_dedup._ADDED), (quality.scored(docs, labels), ("held_out", "score", "predicted"))]
    made += [(decontaminate.scan(docs, bench), decontaminate._ADDED), (bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True), ("ids", "decoded"))]
    for out, added in made:
        assert sorted(out.columns) == sorted(docs.columns), added
        for r in out.collect():
            assert {k: v for k, v in r.asDict().items() if k not in added} == {k: v for k, v in whole[r.doc_id].items() if k not in added}


def test_digests_of_tables_with_clashing_columns(spark, sf_dir):
    """The narrow results do not depend on other columns."""
    texts = ["mail me@x.org now", "a b c d", "a b c d", None]
    plain, odd = documents(spark, texts), clashing(spark, texts)
    for digest in (pii.digests, secrets.digests, substring_dedup.digests, near_dup.near_duplicates, lambda d: bpe.digests(d, RANKS, public_tokenizers.PATTERN)):
        assert sorted(map(str, digest(odd).collect())) == sorted(map(str, digest(plain).collect()))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id bigint, embedding array<double>")
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id bigint, url string, html string")
    turns = spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    more = lambda table: table.select("*", *[F.lit(1).alias(c) for c in [*CLASHES, "v", "dim", "block", "side", "least", "size", "same", "digest", "place", "matrix", "ahead"] if c not in table.columns])
    for table, digest in ((vectors, lambda d: topk.top_k(d, F.col("vec_id") % 20 == 0, 20)), (pages, lambda d: warc.records(d).drop("row")), (turns, chat.repair)):
        assert sorted(map(str, digest(more(table)).collect())) == sorted(map(str, digest(table).collect()))


def test_quality_scores_equal_plain_rules(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.model_of(docs, labels)

    def plain(text):
        import math

        text = text or ""
        n, words = len(text), text.lower().split(" ")
        out = {f"s_{k}": sum(text.count(c) for c in chars) / max(n, 1) for k, chars in quality._CLASSES.items()}
        out |= {"s_length": math.log1p(n), "s_word": n / len(words), "s_distinct": len(set(words)) / len(words), "s_repeat": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)}
        margin = model.bias + sum(w for rule, w in model.weighted if all(out[s] <= t if sign == "<=" else out[s] > t for s, sign, t in rule.conditions))
        return 1 / (1 + math.exp(-margin))

    rows = quality.scored(docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))), labels).collect()
    again = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert model.weighted and all(abs(again[r.doc_id] - plain(r.text)) < 1e-9 for r in docs.collect()) and len(rows) == len(again) + 1


def test_a_large_block_is_held_in_few_bytes():
    """Three megabytes of benchmark: bytes held for each byte of text, and hits that are told by their words."""
    rnd = random.Random(61)
    items = [(f"i{k}", prose(rnd, 5000, 200_000)) for k in range(90)]
    windows = decontaminate.Windows(items, 10)
    size = sum(len(t) for _, t in items)
    assert size > 2.5e6 and windows.held() < (decontaminate.HELD_BYTES - 1) * size
    asked = items[7][1].split()[100:130]
    assert windows.find([w.encode() for w in ["x", *asked, "y"]]) == ([(1, 31)], {"i7"})
    assert windows.find([w.encode() for w in asked[:9]]) == ([], set())
    # Equal hashes of other words are no hits.
    one = decontaminate.Windows([("a", prose(rnd, 12))], 10)
    hashes, places, mask, shift = one.tables[10]
    other = [w.encode() for w in prose(rnd, 10, 7).split()]
    fake = decontaminate._rolled(decontaminate._hashes(other), 10)
    one.tables[10] = (fake.repeat(len(hashes)), places, np.full_like(mask, 255), shift)
    assert one.find(other) == ([], set())


def test_many_benchmark_blocks(spark):
    rnd = random.Random(59)
    items = [(f"i{k}", prose(rnd, 14)) for k in range(12)]
    docs = documents(spark, [items[k][1] if k % 2 else prose(rnd, 30) for k in range(12)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r.hit_items for r in decontaminate.scan(docs, bench, max_block_bytes=60).collect()}
    assert got == {k: [f"i{k}"] if k % 2 else [] for k in range(12)}


def test_runs_of_one_character_are_few_rows():
    assert len(substring_dedup.anchors([b"x" * 100_000])[0]) < 5
    assert sum(substring_dedup.anchors([b"x" * 100_000])[5]) == 99_801
