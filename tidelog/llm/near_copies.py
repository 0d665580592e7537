"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's near-dedup stage.

Two texts are linked if their sets of shingles (SHINGLE words, compared as 64-bit hashes) have a Jaccard similarity
of at least 4/5, and linked documents form components. Sizes and overlaps are whole numbers, so nothing is rounded.

The first candidates are the links of op2's index (simhash.py): fingerprints of the same shingles within its distance. It
finds close copies only; at 4/5 most links lie beyond it. All the rest come from prefixes: in any fixed order of all shingles, two sets that similar share one of their first
n - ceil(4n/5) + 1, so no link is missed. The order puts shingles that many texts have last. Which ones these
are is estimated (at most HOT_MOST of them); the estimate decides how long groups get, never what is found. Most
candidates are ruled out by sketches, whose distance is never more than that of the sets; every other is
confirmed by its whole sets.

Texts with equal sets are one node. A group of more than SMALL nodes at one shingle gives a star first, around the
node that has the shingle earliest, as it has the fewest shingles of its own before it: the text that the others
were made from, or the nearest to it. Then come the pairs of nodes that still lie in different components, so
a cluster of copies does not cost its square.

Defined results: words are runs without ASCII white space, A-Z count as a-z; fewer words than a shingle are one
shingle; null, empty and blank texts are equal; rows of a null id stay. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.common import discard, stored
from tidelog.llm.components import components

SHINGLE = 5
ODD = np.uint64(0x9E3779B97F4A7C15)

#: Shingles that are counted together; times a shingle is met for a place at the end, and how many get one.
COUNTED, HOT, HOT_MOST = 2_000_000, 20, 1_000_000

#: Nodes of a group of which all pairs are candidates at once.
SMALL = 32

#: Candidates that are given on together.
PAIRS = 1 << 16


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the different shingles of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h = (h ^ w[j : j + n]) * ODD
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_hash(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def similar(overlap, n, m):
    """Whether sets of n and m with this overlap have a Jaccard similarity of 4/5 or more."""
    return 9 * overlap >= 4 * (n + m)


def sketch(s: np.ndarray) -> bytes:
    """The size of a set, and which of a power of two of buckets hold an odd number of its shingles: about a bit a shingle."""
    m = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return len(s).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes) -> bool:
    """False only if the sets of two sketches cannot be similar: what one set has alone changes at most one bit."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    a, b = (int.from_bytes(z[4:], "little") for z in (x, y))
    size, bits = len(y) - 4, 8 * (len(y) - 4)
    while size > len(x) - 4:
        size, bits = size // 2, bits // 2
        b = (b >> bits) ^ (b & ((1 << bits) - 1))
    n, m = (int.from_bytes(z[:4], "little") for z in (x, y))
    return 9 * (a ^ b).bit_count() <= n + m


def _texts(docs: DataFrame, *also) -> DataFrame:
    return docs.select(*also, F.col("text").cast("binary").alias("text"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(2)]
        fp, sketches = pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())
        bits = pa.array(np.array([simhash.fingerprint(t.as_py(), SHINGLE) for t in b.column(2)], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, sketches, bits], ["doc_id", "text_hash", "fp", "sketch", "bits"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    held, size = [], 0
    for b in batches:
        for t in b.column(0):
            held.append(shingles(t.as_py()))
            size += len(held[-1])
            if size >= COUNTED:
                yield count(held)
                held, size = [], 0
    if held:
        yield count(held)


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """Frequent shingles, the most frequent last."""
    counts = _texts(docs).mapInArrow(_repeated, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    got = counts.orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").toArrow().column(0).to_numpy()
    return got[::-1].astype(np.int64).view(np.uint64)


def _prefixes(hot: np.ndarray):
    order = np.argsort(hot)
    known, place = hot[order], order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, marks, sizes = [], [], []
            for t in b.column(0):
                s = shingles(t.as_py())
                marks.append(set_hash(s))
                sizes.append(len(s))
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, place[at], 0), kind="stable")]
                heads.append(s[: len(s) - (4 * len(s) + 4) // 5 + 1])
            if not heads:
                continue
            each = [len(s) for s in heads]
            at = np.concatenate([np.arange(k) for k in each])
            columns = [np.concatenate(heads).view(np.int64), np.repeat(np.array(marks, np.int64), each), np.repeat(np.array(sizes, np.int64) << 32, each) | at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "fp", "w"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first two, repeated ones left out, cut so that no value of the first is cut through."""

    def whole(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        fresh = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        return rows if fresh.all() else [c[fresh] for c in rows]

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy() for c in b.columns]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last == 0 and held and held[-1][0][-1] == rows[0][-1]:
            held.append(rows)
            continue
        if last:
            held.append([c[:last] for c in rows])
        if held:
            yield whole(held)
        held = [[c[last:] for c in rows]]
    if held:
        yield whole(held)


def _possible(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows of one shingle: whether what stands behind it in both orders can make the sets similar."""
    n, at = w >> 32, w & 0xFFFFFFFF
    return similar(1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1), n[i], n[j])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, fp, w) sorted by h and fp: candidates (h null, a, b), and the rows of large groups as they are (a: fp)."""
    for rows in _groups(batches):
        h, fp, w = rows
        cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        each = np.diff(np.append(cuts, len(h)))
        sizes = np.repeat(each, each)
        found = []
        some = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
        for d in range(1, int(sizes[some].max(initial=1))):
            some = some[some + d < len(h)]
            some = some[h[some] == h[np.minimum(some + d, len(h) - 1)]]
            good = some[_possible(w, some, some + d)]
            found.append((good, good + d))
        large = np.flatnonzero(sizes > SMALL)
        at = w & 0xFFFFFFFF
        early = np.flatnonzero(at == np.repeat(np.minimum.reduceat(at, cuts), each))
        hub = np.repeat(early[np.searchsorted(early, cuts)], each)[large]
        good = (large != hub) & _possible(w, hub, large)
        found.append((hub[good], large[good]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([fp[i], fp[j]]), axis=1)
        none = np.zeros(pairs.shape[1], np.int64)
        for a in range(0, pairs.shape[1], PAIRS):
            k = slice(a, a + PAIRS)
            yield pa.RecordBatch.from_arrays([pa.array(none[k], mask=none[k] == 0), pa.array(pairs[0, k]), pa.array(pairs[1, k])], ["h", "a", "b"])
        for a in range(0, len(large), PAIRS):
            k = large[a : a + PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(fp[k]), pa.array(w[k])], ["h", "a", "b"])


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, fp, w, root) of large groups, sorted by h and fp: candidates of different roots."""
    for h, fp, w, root in _groups(batches):
        cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (root[a:z] == root[a]).all():
                continue
            for i in range(a, z - 1):
                others = i + 1 + np.flatnonzero(root[i + 1 : z] != root[i])
                others = others[_possible(w, np.full(len(others), i), others)]
                for c in range(0, len(others), PAIRS):
                    k = others[c : c + PAIRS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), fp[i])), pa.array(fp[k])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "s"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            good.append(bool(similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [may_be_similar(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()


def close_pairs(marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that their sketches leave possible."""
    own = marks.join(_nodes(pairs), "fp", "left_semi").select("fp", "sketch").dropDuplicates(["fp"])
    both = pairs.join(own.select(F.col("fp").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("sketch").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(_close, "a long, b long"), "close-pairs")


def _confirm(docs: DataFrame, marks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates of which the whole sets are similar. A set is moved once by its hash, and once beside each candidate that its sketch leaves."""
    pairs = close_pairs(marks, candidates)
    needed = marks.groupBy("fp").agg(F.min("text_hash").alias("needed")).join(_nodes(pairs), "fp", "left_semi").select("needed")
    sets = _texts(docs.join(needed, F.xxhash64("text") == F.col("needed"), "left_semi")).mapInArrow(_sets, "fp long, s binary").dropDuplicates(["fp"])
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    found = stored(both.select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long"), "links")
    discard(pairs)
    return found


def index_candidates(marks: DataFrame) -> DataFrame:
    """(a, b): set hashes that SimHash's index links, one set standing for all of its fingerprint, and these with that one."""
    nodes = stored(marks.select("fp", "bits").distinct(), "fingerprints")
    first = nodes.groupBy("bits").agg(F.min("fp").alias("first"))
    same = nodes.join(first, "bits").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(first.select(F.col("bits").alias("fp"))).where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    named = near.join(first.select(F.col("bits").alias("x"), F.col("first").alias("a")), "x").join(first.select(F.col("bits").alias("y"), F.col("first").alias("b")), "y")
    out = stored(same.unionByName(named.select("a", "b")), "candidates")
    discard(nodes)
    return out


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of nodes that lie in different components."""
    own = lambda c: roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b): links of set hashes whose components are those of all similar pairs."""
    near = index_candidates(marks)
    close = _confirm(docs, marks, near)
    discard(near)
    heads = _texts(docs).mapInArrow(_prefixes(hot_shingles(docs)), "h long, fp long, w long")
    first = stored(heads.repartition("h").sortWithinPartitions("h", "fp").mapInArrow(_first, "h long, a long, b long"), "shared-shingles")
    pairs = stored(apart(first.where("h IS NULL").select("a", "b").distinct(), components(close).withColumnRenamed("node", "fp")), "candidates")
    found = close.unionByName(_confirm(docs, marks, pairs))
    large = first.where("h IS NOT NULL").select("h", F.col("a").alias("fp"), F.col("b").alias("w"))
    if large.isEmpty():
        discard(first, pairs)
        return found
    roots = components(found).withColumnRenamed("node", "fp")
    rows = large.join(roots, "fp", "left").select("h", "fp", "w", F.coalesce("root", "fp").alias("root"))
    more = stored(rows.repartition("h").sortWithinPartitions("h", "fp").mapInArrow(_second, "a long, b long").distinct(), "candidates")
    again = _confirm(docs, marks, more)
    discard(first, pairs, more)
    return found.unionByName(again)


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows of which the group keeps a smaller id. A row is told by its id and its text."""
    marks = stored(_texts(docs, F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash")).mapInArrow(_marks, "doc_id long, text_hash long, fp long, sketch binary, bits long"), "set-hashes")
    roots = components(links(docs, marks)).withColumnRenamed("node", "fp")
    rooted = marks.join(roots, "fp", "left").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    gone = rooted.join(least, "root").where("doc_id <> least").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
