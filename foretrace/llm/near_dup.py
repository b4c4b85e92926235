"""Near-duplicate documents by chosen-path set similarity join.

A text's words are its runs without ASCII white space, A-Z lower-cased; its set is the distinct runs of
``width`` words, or all its words as one when there are fewer. Two texts are linked when
100 * intersection >= threshold * union; components of links form the groups.

1. Texts with equal sets form one class; only classes go on, so exact copies are never compared.
2. ``TREES`` independent trees branch the classes by minwise tokens: a tree's first node is its minimum under
   the tree's first hash function. A class weighs one for every ``ITEMS`` shingles, and a node of weight up to
   ``LEAF`` is small.
3. In the first ``FIRST`` trees all classes of a small node are compared, and those of a large one in blocks. This
   ties groups of near copies together, of any number: components are taken of the links.
4. Then every node of all trees that still holds more than one component is compared in full, across components:
   small nodes at once; large ones, of which all but at most ``LEAF`` lie in one component, in blocks that each
   get the few others. The rest are split in overlapping bands of set sizes, which part no two sizes that allow
   the threshold. Bands with over ``WIDE`` others branch by a byte of the sketch (two tokens), and their classes
   enter further trees, as many as keep the miss rate at this depth within ``MISS``. So rows grow with the size of
   a node, not with its square; but at depth ``DEEPEST`` any band is compared in pairs of blocks. Nothing is cut off.

A comparison has two passes, neither of which makes a row for a pair. The first holds 128 minwise values of 4 bits
against each other and returns the classes that have a possible partner in their node. The second gets the texts
of these, once for each such node, counts the common shingles of the possible pairs exactly, and returns a spanning
forest of the links: in a node of n classes n - 1 rows at most, which join roots of components.

A pair at similarity 0.8 shares a tree's first node with probability 0.8, so one whose nodes need no
branching is missed with probability 0.2 ** TREES (4e-9). A branching keeps it together with probability
0.66, and ``trees_at`` gives 24, 48 and 96 trees for depths 1 to 3: at each depth a pair that got there is
missed with probability ``MISS`` (1e-5) at most, at all depths together with 3e-5. A pair whose sketches agree in
under ``candidate`` of 128 values (86 for similarity 0.8) is none; the binomial tail keeps a pair at the threshold
from that but for ``SKETCH_MISS`` (5e-5). Smaller thresholds get more trees, so that some first node is shared but
for ``MISS``, and block pairs instead of branchings; where ``VALUES`` trees are not enough, one node holds all.
Sets hold 64-bit hashes of the word runs, and classes 128-bit hashes of the sets.

Rows are numbered once, in a stored table, and texts are fetched by (doc_id, 64-bit hash of the text), so no result
depends on how a table is read a second time.

Edge cases: null, empty or blank texts have empty sets, are linked with nothing and are their own group;
rows with equal texts are equal whatever their ids; a group's id is its least doc_id, rows without an id
join a group but never name it, and a group without any id has a null one and keeps all its rows; an empty
table gives no rows; other columns of the input are not touched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import column, discard, fresh, give_back, stored
from foretrace.llm.components import components

TREES, VALUES, LEAF, FIRST, ITEMS = 12, 128, 1024, 2, 4096
#: Pairs of blocks make rows with the square of a node: not before the deepest level, unless WIDE is over LEAF.
WIDE, MISS, DEEPEST, FANS = LEAF, 1e-5, 3, 8
SKETCH_MISS = 5e-5
CHUNK_ROWS, CHUNK_ITEMS = 4096, 4 << 20
BROADCAST_IDS = 1_000_000
_MASK = (1 << 64) - 1
_WORDS_HELD = 300_000

_random = np.random.default_rng(20240229)
_FLIP = _random.integers(0, 1 << 63, VALUES, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_TIMES = _random.integers(0, 1 << 63, VALUES, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The sketch bytes, none of them of a head, by which each tree branches.
_FREE = np.arange((TREES + 1) // 2, VALUES // 2)
_PATHS = np.array([np.random.default_rng(tree).permutation(_FREE)[:DEEPEST] for tree in range(TREES * FANS)])


def miss_rate(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair shares no node of ``trees`` trees, ``trees / TREES`` a head, after ``depth`` branchings."""
    same = (similarity + (1 - similarity) / 16) ** 2  # two values of four bits
    total, n = 0.0, len(_FREE)
    for k in range(n + 1):
        apart = (1 - math.comb(k, depth) / math.comb(n, depth)) ** (trees // TREES)
        total += math.comb(n, k) * same**k * (1 - same) ** (n - k) * (1 - similarity * (1 - apart)) ** TREES
    return total


@lru_cache
def candidate(threshold: float) -> int:
    """The most values of which a pair at the threshold agrees in fewer with probability ``SKETCH_MISS`` at most."""
    same = min(1.0, max(0.0, threshold / 100))
    same += (1 - same) / 16
    tail = 0.0
    for k in range(VALUES):
        tail += math.comb(VALUES, k) * same**k * (1 - same) ** (VALUES - k)
        if tail > SKETCH_MISS:
            return k
    return VALUES


def heads_for(threshold: float) -> int:
    """Trees that leave a pair at the threshold without a common first node with probability ``MISS`` at most; 0 if
    ``VALUES`` trees are too few: then one node holds all."""
    apart = 1 - threshold / 100
    if apart <= 0:
        return TREES
    needed = math.ceil(math.log(MISS) / math.log(apart)) if apart < 1 else VALUES + 1
    return max(TREES, needed) if needed <= VALUES else 0


@lru_cache
def trees_at(threshold: float) -> tuple[int, ...]:
    """Trees at each depth up to the deepest that at most ``FANS`` trees a head keep within ``MISS``."""
    out = [heads_for(threshold)]
    if out[0] != TREES:
        return tuple(out)
    for depth in range(1, DEEPEST + 1):
        enough = [k * TREES for k in range(1, FANS + 1) if miss_rate(threshold / 100, depth, k * TREES) <= MISS]
        if not enough:
            break
        out.append(enough[0])
    return tuple(out)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``width`` words."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(each) - width + 1)
    size = min(width, len(each))
    runs = np.full(n, size, np.uint64)
    for k in range(size):
        runs = _mixed(runs * _STEP + each[k : k + n])
    return np.unique(runs)


def minima(items: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, _MASK, np.uint64)
    for at in range(0, len(items), 8192):
        out = np.minimum(out, ((items[None, at : at + 8192] ^ _FLIP) * _TIMES).min(axis=1))
    return out


def _packed(least: np.ndarray) -> bytes:
    """Four bits of each value, two values a byte."""
    bits = ((least >> np.uint64(24)) & np.uint64(15)).astype(np.uint8)
    return ((bits[::2] << 4) | bits[1::2]).tobytes()


def sketches(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """(row, doc_id, mark, n_shingles, key, heads, sketch) of every row; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            counts, keys, heads, sketch = [], [], [], []
            for value in batch.column(3).cast(pa.binary()):
                items = shingles(value.as_py() or b"", width, hashes)
                counts.append(len(items))
                if len(items):
                    least = minima(items)
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                    heads.append(least[:trees].astype(np.int64).tolist() or [0])
                    sketch.append(_packed(least))
                else:
                    for x in (keys, heads, sketch):
                        x.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["row", "doc_id", "mark", "n_shingles", "key", "heads", "sketch"],
            )
        hashes.clear()
        give_back()

    source = docs.select(F.monotonically_increasing_id().alias("row"), column(doc_id).cast("bigint").alias("doc_id"), _mark(text).alias("mark"), column(text).cast("string").alias("text"))
    return source.mapInArrow(run, "row bigint, doc_id bigint, mark bigint, n_shingles bigint, key binary, heads array<bigint>, sketch binary")


def _mark(text: str) -> Column:
    return F.xxhash64(column(text).cast("string"))


_CLASS = ("id", "n_shingles", "weight", "root", "sketch")
_MEMBER = ("id", "n_shingles", "root", "sketch")


def _first_nodes(classes: DataFrame, trees: int | None = None) -> DataFrame:
    """A row (node, tree, class) for each class and (one of the first) tree."""
    heads = F.col("heads") if trees is None else F.slice("heads", 1, trees)
    return classes.select(*_CLASS, F.posexplode(heads).alias("tree", "head")).select(*_CLASS, "tree", F.xxhash64("tree", "head").alias("node"))


def _blocks(size) -> Column:
    return F.ceil(size / LEAF).cast("int")


def _block_of(blocks, *salt) -> Column:
    """A block of 0 .. blocks - 1 for the row's class."""
    return F.pmod(F.xxhash64("id", *salt), blocks).cast("int")


def _grouped_by(rows: DataFrame, block, side) -> DataFrame:
    return rows.select(F.xxhash64("node", block).alias("group"), side.cast("int").alias("side"), *_MEMBER)


def first_groups(classes: DataFrame) -> DataFrame:
    """(group, side, class): small nodes of the first trees, and blocks of their large ones."""
    level = _first_nodes(classes, FIRST)
    sizes = level.groupBy("node").agg(F.sum("weight").alias("size"), F.count("*").alias("k")).filter("k > 1").select("node", "size")
    block = F.when(F.col("size") > LEAF, _block_of(_blocks(F.col("size")), "tree")).otherwise(0)
    return _grouped_by(level.join(sizes, "node"), block, F.lit(0))


def _crossing(level: DataFrame) -> DataFrame:
    """The rows of nodes of several components, with the node's size, its greatest component and that one's size c."""
    parts = level.groupBy("node", "root").agg(F.sum("weight").alias("c"))
    sizes = parts.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    return level.join(sizes.select("node", "size", F.col("most.c").alias("c"), F.col("most.root").alias("main")), "node")


def _by_size(rows: DataFrame, threshold: int) -> DataFrame:
    """The nodes' rows, twice each, in bands of set sizes: any two sizes that allow the threshold share a band."""
    if not 0 < threshold < 100:
        return rows
    band = F.floor(F.log("n_shingles") / (math.log(100 / threshold) * (1 + 1e-9)))
    return rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("node", F.xxhash64("node", "band")).drop("band")


def cross_groups(classes: DataFrame, threshold: int) -> Iterator[DataFrame]:
    """(group, side, class) for each depth of the trees: nodes of several components, but for those that the first
    trees have compared in full. Each must be read before the next is asked for."""
    level, trees, held = _first_nodes(classes).withColumn("banded", F.lit(False)), trees_at(threshold), []
    others = F.col("size") - F.col("c")
    for depth in range(len(trees)):
        inner = _crossing(level)
        if depth == 0:
            inner = inner.filter((F.col("tree") >= FIRST) | (F.col("size") > LEAF))
        inner, last = stored(inner, "crossing"), depth == len(trees) - 1
        held.append(inner)
        small, large, pairs = inner.filter(others <= LEAF), inner.filter(others > LEAF).select(*level.columns), None
        if not large.isEmpty():
            bands = _by_size(large.filter("not banded"), threshold).withColumn("banded", F.lit(True))
            bands = stored(_crossing(bands.unionByName(large.filter("banded"))), "bands")
            held.append(bands)
            small = small.unionByName(bands.filter(others <= LEAF))
            pairs = bands.filter((others > LEAF) & ((others <= WIDE) | F.lit(last)))
            large = bands.filter(others > max(LEAF, WIDE))
        blocks = F.when(F.col("size") > 2 * LEAF, _blocks(F.col("size"))).otherwise(1)
        own = F.when(F.col("root") == F.col("main"), F.array(_block_of(blocks))).otherwise(F.sequence(F.lit(0), blocks - 1))
        groups = _grouped_by(small.withColumn("block", F.explode(own)), F.col("block"), F.lit(0))
        yield groups if pairs is None else groups.union(_block_pairs(pairs))
        if last or large.isEmpty():
            break
        at = F.element_at(F.array(*[F.lit(int(x) + 1) for x in _PATHS[: trees[depth], depth]]), F.col("tree") + 1)
        level = large.select(*_CLASS, "tree", F.xxhash64("node", F.substring(F.col("sketch"), at, F.lit(1))).alias("node"), "banded")
        reached = classes.join(large.select("id").distinct(), "id", "left_semi")
        level = level.union(_further(reached, range(trees[depth], trees[depth + 1]), depth + 1).withColumn("banded", F.lit(False)))
    for inner in held:
        discard(inner)


def _block_pairs(rows: DataFrame) -> DataFrame:
    """The rows dealt to all pairs of their block with one of the node's blocks; side tells the two blocks apart."""
    rows = rows.withColumn("blocks", _blocks(F.col("size"))).withColumn("own", _block_of(F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.least("own", "other").cast("bigint") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return _grouped_by(rows, block, side)


def _further(classes: DataFrame, trees: range, depth: int) -> DataFrame:
    """The classes' nodes at ``depth`` of further trees, as of ``_first_nodes``."""
    if not trees:
        return _first_nodes(classes).limit(0)
    paths = F.array(*[F.array(*[F.lit(int(x) + 1) for x in _PATHS[t, :depth]]) for t in trees])
    rows = classes.select(*_CLASS, "heads", F.explode(F.sequence(F.lit(trees.start), F.lit(trees.stop - 1))).alias("tree")).withColumn("path", F.element_at(paths, F.col("tree") - trees.start + 1))
    head = F.element_at("heads", F.pmod("tree", F.lit(TREES)) + 1)
    return rows.select(*_CLASS, "tree", F.xxhash64("tree", head, *[F.substring(F.col("sketch"), F.col("path")[k], F.lit(1)) for k in range(depth)]).alias("node"))


_NIBBLES = np.uint64(0x1111111111111111)


def possible_pairs(table: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, by place, of equal groups but unequal roots, whose sketches agree enough and whose sizes allow
    the threshold. Rows of the same side, but for side 0, are no pair."""
    groups, sides, sizes, roots = (table.column(c).to_numpy() for c in ("group", "side", "n_shingles", "root"))
    packed = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(groups), VALUES // 16)
    most = VALUES - candidate(threshold)
    left, right = [], []
    for step in range(1, len(groups)):
        i = np.flatnonzero(groups[:-step] == groups[step:])
        if not len(i):
            break
        j = i + step
        keep = (roots[i] != roots[j]) & ((sides[i] == 0) | (sides[i] != sides[j]))
        keep &= 100 * np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        i, j = i[keep], j[keep]
        differ = packed[i] ^ packed[j]
        differ |= differ >> np.uint64(2)
        differ |= differ >> np.uint64(1)
        keep = np.bitwise_count(differ & _NIBBLES).sum(axis=1, dtype=np.int64) <= most
        left.append(i[keep])
        right.append(j[keep])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def common_items(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact number of common items of each pair of sets; many pairs among few sets are counted on bit rows."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) <= 16 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    i, j = place[: len(i)], place[len(i) :]
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, item = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    out = np.zeros(len(i), np.int64)
    for first in range(0, int(item[-1]) + 1, 4096):
        low, high = np.searchsorted(item, [first, first + 4096])
        bits = np.zeros((len(used), 4096), bool)
        bits[owner[low:high], item[low:high] - first] = True
        rows = np.packbits(bits, axis=1).view(np.uint64)
        for at in range(0, len(i), 1 << 15):
            out[at : at + (1 << 15)] += np.bitwise_count(rows[i[at : at + (1 << 15)]] & rows[j[at : at + (1 << 15)]]).sum(axis=1, dtype=np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, other) from the least number of each component to its others."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        for side in (x, y, label[x], label[y]):
            np.minimum.at(label, side, low)
        label = label[label]
    label = label[label]
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[label[other]], names[other]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, some at a time."""
    rest = None
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = pa.Table.from_batches([batch.slice(at, CHUNK_ROWS)])
            table = part if rest is None else pa.concat_tables([rest, part])
            groups = table.column("group").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            rest = table.slice(cut)
            if cut:
                yield table.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()


_GROUP_ROW = "group bigint, side int, id bigint, n_shingles bigint, root bigint, sketch binary"


def with_partners(rows: DataFrame, threshold: int) -> DataFrame:
    """The rows (group, side, class) that have a possible partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            some = np.unique(np.concatenate(possible_pairs(table, threshold)))
            if len(some):
                yield from table.take(pa.array(some)).to_batches()
        give_back()

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, _GROUP_ROW)


def linked(rows: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each group, as edges between roots; texts: id, text."""
    dealt = rows.join(texts, "id").select("group", "side", *_MEMBER, "text").repartition("group").sortWithinPartitions("group", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        held, sets, items = [], [], 0
        for batch in batches:
            values = batch.column(batch.num_columns - 1).cast(pa.binary())
            narrow = batch.select(batch.schema.names[:-1])
            groups, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            start = 0
            for k in range(batch.num_rows):
                last = (groups[k - 1], ids[k - 1]) if k else (held[-1].column(0)[-1].as_py(), held[-1].column(2)[-1].as_py()) if held else None
                again = last == (groups[k], ids[k])  # the text of a repeated row
                if again or (last and groups[k] != last[0] and (items > CHUNK_ITEMS or len(sets) > CHUNK_ROWS)):
                    if k > start:
                        held.append(narrow.slice(start, k - start))
                    start = k
                    if again:
                        start = k + 1
                        continue
                    yield edges(held, sets)
                    held, sets, items = [], [], 0
                sets.append(shingles(values[k].as_py() or b"", width, hashes))
                items += len(sets[-1])
            if batch.num_rows > start:
                held.append(narrow.slice(start))
        if sets:
            yield edges(held, sets)
        held, sets = [], []
        hashes.clear()
        give_back()

    def edges(held: list[pa.RecordBatch], sets: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        i, j = possible_pairs(table, threshold)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(i):
            groups, roots, sizes = table.column("group").to_numpy(), table.column("root").to_numpy(), table.column("n_shingles").to_numpy()
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cuts = np.flatnonzero(np.diff(groups[i])) + 1
            for x, y in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
                common = common_items(sets, x, y)
                good = 100 * common >= threshold * (sizes[x] + sizes[y] - common)
                out.append(forest(roots[x[good]], roots[y[good]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    out = _grouped(docs, width, threshold, doc_id, text).withColumn("component_id", F.col("first.doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one row of least doc_id, of a group without ids any."""
    rows = _grouped(docs, width, threshold, doc_id, text)
    name = fresh(docs, "id", "mark", "again")
    chosen = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.count_if(F.col("row") == F.col("first.row")).alias("stay")).filter("stay > 0")
    chosen = stored(chosen.select(F.col("doc_id").alias(name["id"]), F.col("mark").alias(name["mark"]), (F.col("stay") < F.col("n")).alias(name["again"])), "kept")
    total, repeated = chosen.agg(F.count("*"), F.count_if(name["again"])).first()
    if total <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    both = docs.join(chosen, column(doc_id).cast("bigint").eqNullSafe(column(name["id"])) & (_mark(text) == column(name["mark"])))
    if not repeated:
        return both.select(*map(column, docs.columns))
    once = both.filter(column(name["again"])).dropDuplicates([name["id"], name["mark"]])
    return both.filter(~column(name["again"])).union(once).select(*map(column, docs.columns))


def _grouped(docs: DataFrame, width: int, threshold: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, mark, n_shingles, first) of every row; first: the doc_id and row that name and stand for its group."""
    rows = stored(sketches(docs, width, doc_id, text, heads_for(threshold)), "sketches")
    some = rows.filter("n_shingles > 0")
    named = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "mark")
    classes = some.groupBy("key").agg(F.min(named).alias("least"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("heads").alias("heads"), F.any_value("sketch").alias("sketch"))
    classes = stored(classes.withColumn("id", F.col("least.row")).withColumn("weight", F.ceil(F.col("n_shingles") / ITEMS).cast("bigint")), "classes")
    labelled = classes.withColumn("root", F.col("id"))

    def joined(groups: Iterable[DataFrame]) -> DataFrame:
        """``labelled`` with the components that the links of these groups leave."""
        found = [stored(with_partners(g, threshold), "partners") for g in groups]
        partners = found[0]
        for more in found[1:]:
            partners = partners.union(more)
        links = stored(linked(partners, _texts(docs, partners, classes, doc_id, text), width, threshold), "links")
        roots = stored(components(links).toDF("root", "new_root"), "roots")
        for x in (*found, links):
            discard(x)
        return labelled.join(roots, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")

    labelled = joined([first_groups(labelled)])
    labelled = joined(cross_groups(labelled, threshold))
    member = labelled.select("key", "root", "least")
    member = member.join(member.groupBy("root").agg(F.min("least").alias("first")), "root").select("key", "first")
    out = some.select("row", "doc_id", "mark", "n_shingles", "key").join(member, "key").select("row", "doc_id", "mark", "n_shingles", "first")
    return out.unionByName(rows.filter("n_shingles = 0").select("row", "doc_id", "mark", "n_shingles", named.alias("first")))


def _texts(docs: DataFrame, partners: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text) of every class in ``partners``: the text of its least row, once for each row equal to that in
    doc_id and text."""
    wanted = classes.join(partners.select("id").distinct(), "id", "left_semi").select("id", F.col("least.doc_id").alias("least_id"), F.col("least.mark").alias("least_mark"))
    wanted = stored(wanted, "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    source = docs.select(column(doc_id).cast("bigint").alias("doc_id"), _mark(text).alias("mark"), column(text).cast("string").alias("text"))
    return source.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("mark") == F.col("least_mark"))).select("id", "text")
