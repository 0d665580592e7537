"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 values (seed 42) of the text's word
shingles. Fingerprints within `distance` bits are linked, and linked documents form components.

Index. Upper nodes are masked bit patterns: the 64 bits are cut into distance + 2 blocks, and two fingerprints
within the distance agree on two blocks at least, so every link lies under an upper node that fixes two
blocks. Inside a node fingerprints are sorted by Gray rank, so that runs of neighbours share many bits; runs
of LEAF become leaves, and FAN nodes an upper one, each with the bits its members share (a mask and a
pattern). A walk over pairs of nodes adds up the differences of their shared bits and drops a pair of groups
when these exceed the distance, or when all members are in one component already. Small nodes are one leaf.

Only different fingerprints enter the index, so copies of one text are one entry. A node gives the links of a
spanning star of each local component, not all pairs. Nodes with more than NODE_MOST members are cut into
parts, each pair of parts a task of its own, so no task holds more than two parts. All links survive.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; fewer words than a
shingle are one shingle; repeated rows give repeated results; a null id is named by no component unless
all ids of it are null (then component_id is null). Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored
from tidelog.llm.components import components, join_labels

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42

#: Fingerprints of a leaf, and nodes under an upper node.
LEAF, FAN = 32, 16

#: Members of an upper node that one task takes.
NODE_MOST = 4_000_000

#: Pairs of nodes that are looked at together.
PAIRS_AT_ONCE = 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of a text in UTF-8; A-Z count as a-z, words are runs without ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:z], SEED) for a, z in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of distance + 2 blocks of nearly equal size."""
    n = distance + 2
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """The tree under one upper node; `links` walks it against itself."""

    def __init__(self, codes: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.leaf, self.fan = leaf, fan
        n = len(codes)
        every, some = self.codes, self.codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern) of each node, leaves first
        step = leaf
        while True:
            at = np.arange(0, len(every), step)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            mask = ~(every ^ some)
            self.levels.append((mask, every & mask))
            step = fan
            if len(every) == 1:
                break
        self.starts = np.arange(0, n, leaf)
        self.label = np.arange(n)

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Spanning stars of the components: (root, other) codes."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            mask, pattern = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            a, b = a[near], b[near]
            if level == 0:
                self._compare(a, b, distance)
                continue
            below = len(self.levels[level - 1][0])
            steps = np.arange(self.fan)
            x = np.repeat(a[:, None] * self.fan + steps, self.fan, axis=1).ravel()
            y = np.tile(b[:, None] * self.fan + steps, (1, self.fan)).ravel()
            good = (x <= y) & (x < below) & (y < below)
            x, y = x[good], y[good]
            order = np.argsort(y - x, kind="stable")  # close ones first: what they join prunes the rest
            for i in reversed(range(0, len(order), PAIRS_AT_ONCE)):
                part = order[i : i + PAIRS_AT_ONCE]
                todo.append((level - 1, x[part], y[part]))
        others = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.codes[self.label[others]], self.codes[others]

    def _compare(self, a: np.ndarray, b: np.ndarray, distance: int) -> None:
        n = len(self.codes)
        if len(self.starts) > 1:
            low, high = np.minimum.reduceat(self.label, self.starts), np.maximum.reduceat(self.label, self.starts)
            new = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[new], b[new]
        found_a, found_b = [], []
        inside = np.arange(self.leaf)
        for i in range(0, len(a), 256):
            x, y = a[i : i + 256, None] * self.leaf + inside, b[i : i + 256, None] * self.leaf + inside
            near = np.bitwise_count(self.codes[np.minimum(x, n - 1)][:, :, None] ^ self.codes[np.minimum(y, n - 1)][:, None, :]) <= distance
            near &= (x < n)[:, :, None] & (y < n)[:, None, :]
            k, r, c = np.nonzero(near)
            found_a.append(x[k, r])
            found_b.append(y[k, c])
        if found_a:
            self.label = join_labels(self.label, np.concatenate(found_a), np.concatenate(found_b))


def small_nodes(keys: np.ndarray, codes: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many nodes of one leaf each: rows sorted by key; sizes: of the row's node."""
    label, found_a, found_b = np.arange(len(keys)), [], []
    rows = np.arange(len(keys))
    for d in range(1, int(sizes.max(initial=0))):
        rows = rows[rows + d < len(keys)]
        rows = rows[keys[rows] == keys[rows + d]]
        near = rows[np.bitwise_count(codes[rows] ^ codes[rows + d]) <= distance]
        found_a.append(near)
        found_b.append(near + d)
    if found_a:
        label = join_labels(label, np.concatenate(found_a), np.concatenate(found_b))
    others = np.flatnonzero(label != np.arange(len(label)))
    return codes[label[others]], codes[others]


def _node_links(distance: int):
    """For rows (key, fp) sorted by key: links inside every node."""

    def settle(keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
        sizes = np.diff(np.append(cuts, len(keys)))
        each = np.repeat(sizes, sizes)
        small = each <= LEAF
        some = small & (each > 1)
        got = [small_nodes(keys[some], codes[some], each[some], distance)]
        got += [GrayIndex(codes[c : c + n]).links(distance) for c, n in zip(cuts[sizes > LEAF], sizes[sizes > LEAF], strict=True)]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*got, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # from where the last key began
        for batch in batches:
            keys, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])
            if held and last == 0 and held[-1][0][-1] == keys[-1]:
                held.append((keys, codes))
                continue
            held.append((keys[:last], codes[:last]))
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(keys[last:], codes[last:])]
        if held:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _routed(distinct: DataFrame, distance: int, node_most: int) -> DataFrame:
    """(key, fp): every fingerprint under each of its upper nodes."""
    cut = blocks(distance)
    value = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in cut]
    pairs = list(combinations(range(len(cut)), 2))
    # A node can be large only if both of its blocks are common: a histogram of few thousand counts tells.
    counts = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(value)])).alias("x")).groupBy("x").count()
    common = [r.x for r in counts.where(F.col("count") > node_most).collect()]
    nodes = [F.struct((F.lit(k) * F.lit(1 << 40) + F.shiftleft(value[i], 20) + value[j]).alias("key"), F.lit(k).alias("pair")) for k, (i, j) in enumerate(pairs)]
    routed = distinct.select("fp", F.explode(F.array(*nodes)).alias("n")).select("n.key", "n.pair", "fp")
    if not common:
        return routed.select("key", "fp")
    is_common = [value[i].isin([r.v for r in common if r.i == i] or [-1]) for i in range(len(cut))]
    both = F.lit(False)
    for k, (i, j) in enumerate(pairs):
        both |= (F.col("pair") == k) & is_common[i] & is_common[j]
    large = routed.where(both).groupBy("key").count().where(F.col("count") > node_most)
    parts = large.select(F.col("key"), F.ceil(F.col("count") / node_most).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    split = routed.join(parts, "key").withColumn("p", own).withColumn("q", other)
    split = split.select(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).bitwiseOR(F.lit(-(1 << 63))).alias("key"), "fp")
    return routed.join(parts, "key", "left_anti").select("key", "fp").unionByName(split)


def links(distinct: DataFrame, distance: int = DISTANCE, node_most: int = NODE_MOST) -> DataFrame:
    """(a, b): links whose components are those of all pairs within the distance. distinct: fp, each once."""
    routed = _routed(distinct, distance, node_most).repartition("key").sortWithinPartitions("key")
    return routed.mapInArrow(_node_links(distance), "a long, b long")


def near_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, node_most: int = NODE_MOST) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (least id that links lead to)."""
    marks = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance, node_most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_mark = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(of_mark, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows of which the group keeps a smaller id; rows of a null id stay."""
    gone = near_groups(docs, distance, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
