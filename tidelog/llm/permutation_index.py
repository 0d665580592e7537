"""Approximate nearest neighbours by largest inner product, with a permutation index.

Pivots see every vector in an order: from the pivot with the largest inner product down. A vector is represented
by the first PREFIX pivots of that order and their ranks, and posted, with the rank, in the inverted file of each.
A query reads the files of its own pivots only and adds up, for every vector met there, PREFIX minus the later
of the two ranks; that is the Spearman footrule distance of the two prefixes up to a constant. The best by
footrule are reranked by the exact inner product in double precision.

Growth. Pivots are PIVOTS times the square root of the number of entries, a sample in the order of a hash (at
most PIVOTS_MOST), so a query reads PREFIX squared / PIVOTS times that root in postings; CANDIDATES times the
root are reranked. Nothing else depends on the size.

Layout. Equal vectors are one entry with their k + 1 least ids (an entry needs no more, as ties go to the
smaller id), so a vector that a third of the rows share costs one entry. Entries are dealt by a hash into
blocks of BLOCK times the root (BLOCK_MOST at most), each moved once and indexed once, in one task; the
queries, a vector and its prefix each, are sent to every block and stream through it. A block gives k + 1
entries a query, whatever ties there are. Memory follows BLOCK_MOST.

Defined results: vectors that are null or zero or hold null or non-finite components take no part, neither as query
nor as candidate; only vectors of one length have an inner product, so each length is searched on its own;
rows that repeat id and vector count once; null ids take no part. A query never finds its own id. With k
candidates or fewer a query gets all. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import stored

#: Pivots of a vector's representation.
PREFIX = 64

#: Times the square root of the number of entries: pivots, candidates that are reranked, entries of a block.
PIVOTS, CANDIDATES, BLOCK = 4, 20, 32

#: The bound of the sample of pivots, and of a block's entries.
PIVOTS_MOST, BLOCK_MOST = 1 << 17, 1 << 18

#: Vectors that are held against all pivots together.
ROWS = 1024

FOUND = "query long, score double, ids array<long>"


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def times_root(factor: float, n: int) -> int:
    return int(np.ceil(factor * np.sqrt(n)))


def prefixes(x: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The first pivots of each vector's order, a row each."""
    size = min(size, len(pivots))
    out = np.empty((len(x), size), np.int32)
    for a in range(0, len(x), ROWS):
        near = -(x[a : a + ROWS] @ pivots.T)
        first = np.argpartition(near, size - 1, axis=1)[:, :size]
        order = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")
        out[a : a + ROWS] = np.take_along_axis(first, order, 1)
    return out


class Block:
    """Inverted files over some vectors; `least` holds the least id of each."""

    def __init__(self, x: np.ndarray, least: np.ndarray, pivots: np.ndarray, size: int):
        self.x, self.least, self.prefix = x, least, min(size, len(pivots))
        posted = prefixes(x, pivots, size).ravel()
        order = np.argsort(posted, kind="stable")
        self.files = np.searchsorted(posted[order], np.arange(len(pivots) + 1))
        self.rows, self.gain = (order // self.prefix).astype(np.int32), (self.prefix - order % self.prefix).astype(np.int16)

    def nearness(self, prefix: np.ndarray) -> np.ndarray:
        """Of every vector to a query with this prefix: the footrule distance, turned round and moved."""
        cuts = [slice(self.files[p], self.files[p + 1]) for p in prefix]
        rows = np.concatenate([self.rows[c] for c in cuts])
        gain = np.concatenate([np.minimum(self.gain[c], self.prefix - i) for i, c in enumerate(cuts)])
        return np.bincount(rows, weights=gain, minlength=len(self.x))

    def search(self, query: np.ndarray, prefix: np.ndarray, candidates: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, inner products) of the k best of the candidates by product, then by least id."""
        near, most = self.nearness(prefix), min(candidates, len(self.x))
        some = np.sort(np.argpartition(-near, most - 1)[:most])
        product = np.einsum("ij,j->i", self.x[some].astype(np.float64), query.astype(np.float64))
        if len(some) > k:  # all as good as the k-th, of which the least ids stay
            good = product >= np.partition(product, len(some) - k)[len(some) - k]
            some, product = some[good], product[good]
        best = np.lexsort((self.least[some], -product))[:k]
        return some[best], product[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, pa.RecordBatch]]:
    """(size, block, asks, rows) of rows sorted by these."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(keys[0, a]), int(keys[1, a]), bool(keys[2, a]), b.slice(a, z - a)


def _searcher(pivots: dict[int, np.ndarray], shares: dict[int, float], prefix: int, k: int):
    def answers(index: Block, own: pa.Array, size: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        q, orders = _matrix(pa.chunked_array([rows.column("embedding")])), _matrix(pa.chunked_array([rows.column("prefix")]))
        candidates = int(np.ceil(shares[size] * len(index.x))) + k
        found = [index.search(query, order, candidates, k) for query, order in zip(q, orders, strict=True)]
        each = [len(some) for some, _ in found]
        ids = own.take(pa.array(np.concatenate([some for some, _ in found])))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows.column("node").to_numpy(), each)), pa.array(np.concatenate([s for _, s in found])), ids], ["query", "score", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, own = None, [], None, None
        for size, block, asks, rows in _segments(batches):
            if (size, block) != at:
                at, held, index, own = (size, block), [], None, None
            if not asks:
                held.append(rows)
                continue
            if not held:
                continue
            if index is None:
                table = pa.Table.from_batches(held)
                own = table["ids"].combine_chunks()
                held = held[:1]
                index = Block(_matrix(table["embedding"]), own.flatten().to_numpy()[own.offsets.to_numpy()[:-1] - own.offsets[0].as_py()], pivots[size], prefix)
            yield answers(index, own, size, rows)

    return run


def _with_prefixes(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lists = b.column("size").to_numpy(), [None] * b.num_rows
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                own = b.column("embedding").take(pa.array(rows))
                for i, p in zip(rows.tolist(), prefixes(_matrix(pa.chunked_array([own])), pivots[size], prefix), strict=True):
                    lists[i] = p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], [*b.schema.names, "prefix"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, pivots: float = PIVOTS, prefix: int = PREFIX, block: float = BLOCK, candidates: float = CANDIDATES) -> DataFrame:
    """vectors: vec_id, embedding; queries: query_id, embedding. Rows: query_id, rank from 1, vec_id, score."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").where(F.col("id").isNotNull() & usable(F.col("embedding")))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where(F.col("query_id").isNotNull() & usable(F.col("embedding")))
    first = v.withColumn("r", F.dense_rank().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("r") <= k + 1)
    both = first.select("embedding", "id", F.lit(False).alias("asks")).unionByName(q.select("embedding", F.lit(None).cast("long").alias("id"), F.lit(True).alias("asks")).distinct())
    entries = both.groupBy("embedding").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max("asks").alias("asks"))
    entries = stored(entries.select(F.size("embedding").alias("size"), "embedding", "ids", "asks", F.monotonically_increasing_id().alias("node"), F.xxhash64("embedding").alias("hash")), "vectors")
    data = entries.where(F.size("ids") > 0)
    counts = {r.size: r.n for r in data.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of a vector
    per_size = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("size")) if values else F.lit(0)
    wanted = {s: min(PIVOTS_MOST, times_root(pivots, n)) for s, n in counts.items()}
    placed = data.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy("hash", "embedding"))).where(F.col("r") <= max(wanted.values(), default=0))
    sample = placed.where(F.col("r") <= per_size(wanted)).select("size", "embedding").toArrow() if counts else None
    seen = {s: _matrix(sample.filter(pa.compute.equal(sample["size"], s))["embedding"]) for s in counts}
    shares = {s: min(1.0, times_root(candidates, n) / n) for s, n in counts.items()}
    blocks = {s: -(-n // min(BLOCK_MOST, times_root(block, n))) for s, n in counts.items()}
    firsts = dict(zip(blocks, np.cumsum([0, *blocks.values()]).tolist(), strict=False))
    asks = entries.where("asks").where(F.col("size").isin(list(counts))).select("size", "embedding", "node")
    asks = asks.mapInArrow(_with_prefixes(seen, prefix), asks.schema.simpleString()[7:-1].replace(":", " ", 3) + ", prefix array<int>") if counts else asks.withColumn("prefix", F.lit(None).cast("array<int>"))
    none = F.lit(None)
    dealt = data.select("size", F.pmod("hash", per_size(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), none.cast("long").alias("node"), "embedding", none.cast("array<int>").alias("prefix"), "ids")
    sent = asks.select("size", F.explode(F.sequence(F.lit(0), per_size(blocks).cast("int") - 1)).alias("block"), F.lit(1).alias("asks"), "node", "embedding", "prefix", none.cast("array<long>").alias("ids"))
    all_rows = dealt.unionByName(sent).repartitionById(max(1, sum(blocks.values())), (per_size(firsts) + F.col("block")).cast("int"))
    found = all_rows.sortWithinPartitions("size", "block", "asks").mapInArrow(_searcher(seen, shares, prefix, k + 1), FOUND)
    ranked = found.select("query", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    nodes = q.join(entries.where("asks").select("embedding", "node"), "embedding").select("query_id", "node").distinct()
    near = nodes.join(lists, nodes["node"] == lists["query"]).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return near.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
