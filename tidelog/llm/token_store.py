"""Token ids in binary shards with a minimal perfect hash index.

A shard has two files. `shard-N.ids` is nothing but ids, little-endian, 2 bytes each where the vocabulary allows it
and 4 otherwise, of documents in ascending order of their keys. `shard-N.idx` has a JSON head and arrays: the bits
of a minimal perfect hash over the shard's different keys; for each hash number a 32-bit fingerprint of its
key and the ordinal of the key's first document; the bounds of all documents; their keys. A key is found by its
hash number, refused if the fingerprint is another key's, and confirmed by the stored key: no search and no
scan. `manifest.json` has every shard's key range, documents and ids.

Shards are ranges of keys, cut by a sample of the keys, so a shard's size does not depend on one source, and all
rows of one key lie together in one shard. A task holds its shard's keys and bounds and a batch of texts; its
files appear under their names only when they are complete, so tasks can run again.

Defined results: a null or empty text has only the end id; rows of one key stand next to each other, ordered by
text, and a lookup gives them all; rows of a null key come first and are found by None; an empty table has
no shards and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.files import Publishing, make_folder, opened
from tidelog.llm.perfect_hash import PerfectHash, mix
from tidelog.llm.tokens import encoder, little_batches

#: Documents of a shard, about.
SHARD_ROWS = 8192

#: Seed of the fingerprints, apart from those of the hash's levels.
PRINT = 1000

MAGIC = b"TLIDS1\n\0"

MANIFEST = "shard int, null_docs long, docs long, ids long, first_key long, last_key long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Ids that are read at once.
IDS_AT_ONCE = 4_000_000


def _shard(path: str, n: int, kind: str) -> str:
    return f"{path}/shard-{n:06d}.{kind}"


def _write_index(uri: str, attempt: int, head: dict, arrays: dict[str, np.ndarray]) -> None:
    head = head | {"arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}
    text = json.dumps(head).encode()
    out = Publishing(uri, attempt)
    out.write(MAGIC + len(text).to_bytes(8, "little") + text)
    for a in arrays.values():
        out.write(np.ascontiguousarray(a).tobytes())
    out.publish()


class Shard:
    """One shard, opened for reading."""

    def __init__(self, path: str, n: int):
        with opened(_shard(path, n, "idx")) as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"not an index: {_shard(path, n, 'idx')}")
        size = int.from_bytes(raw[8:16], "little")
        head, at = json.loads(raw[16 : 16 + size]), 16 + size
        a = {}
        for name, kind, count in head["arrays"]:
            a[name] = np.frombuffer(raw, kind, count, at)
            at += a[name].nbytes
        self.kind, self.nulls = np.dtype(head["ids"]), head["nulls"]
        self.hash = PerfectHash(a["words"], a["sizes"], a["rest"])
        self.prints, self.first, self.bounds, self.keys = a["prints"], a["first"], a["bounds"], a["keys"]
        self.payload = opened(_shard(path, n, "ids"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of each key's first document, -1 for keys that are not here."""
        number = self.hash(keys)
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(number >= 0)
        some = some[self.prints[number[some]] == (mix(keys[some], PRINT) >> np.uint64(32)).astype(np.uint32)]
        ordinal = self.first[number[some]].astype(np.int64)
        right = self.keys[ordinal] == keys[some]
        out[some[right]] = ordinal[right]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Of documents start ... stop - 1, in a row."""
        a, z = int(self.bounds[start]), int(self.bounds[stop])
        self.payload.seek(a * self.kind.itemsize)
        return np.frombuffer(self.payload.read((z - a) * self.kind.itemsize), self.kind)

    def last(self, ordinal: int) -> int:
        """One past the last document with the key of this one."""
        return int(np.searchsorted(self.keys[self.nulls :], self.keys[ordinal], "right")) + self.nulls


def write(docs: DataFrame, path: str, tokenizer_file: str, newline_is_space: bool, end_id: int, shard_rows: int = SHARD_ROWS) -> list[dict]:
    """Write the store to a folder all executors share; returns the manifest."""
    make_folder(path)
    shards = max(1, -(-docs.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(tokenizer_file, newline_is_space), TaskContext.get()
        n, attempt = task.partitionId(), task.taskAttemptId()
        kind = np.dtype("<u2" if max(code.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        out, keys, lengths, nulls = None, [], [], 0
        for batch in batches:
            own = batch.column(0)
            nulls += own.null_count
            keys.append(own.fill_null(0).to_numpy())
            texts = batch.column(1).to_pylist()
            for a, z in little_batches(texts):
                ids, bounds = code.encode(texts[a:z])
                out = out or Publishing(_shard(path, n, "ids"), attempt)
                out.write(np.insert(ids, bounds[1:], end_id).astype(kind).tobytes())
                lengths.append(np.diff(bounds) + 1)
        if out is None:
            return
        out.publish()
        key, length = np.concatenate(keys), np.concatenate(lengths)
        different, first = np.unique(key[nulls:], return_index=True)
        ph = PerfectHash.build(different)
        number = ph(different)
        prints, firsts = np.zeros(len(different), np.uint32), np.zeros(len(different), np.uint32)
        prints[number] = (mix(different, PRINT) >> np.uint64(32)).astype(np.uint32)
        firsts[number] = first + nulls
        arrays = {"words": ph.words, "sizes": ph.sizes, "rest": ph.rest, "prints": prints, "first": firsts, "bounds": np.concatenate([[0], np.cumsum(length)]), "keys": key}
        _write_index(_shard(path, n, "idx"), attempt, {"ids": kind.str, "nulls": nulls}, arrays)
        ends = (int(different[0]), int(different[-1])) if len(different) else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((n, pa.int32()), (nulls, pa.int64()), (len(key), pa.int64()), (int(length.sum()), pa.int64()), (ends[0], pa.int64()), (ends[1], pa.int64()))], [c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = sorted((r.asDict() for r in placed.mapInArrow(run, MANIFEST).collect()), key=lambda r: r["shard"])
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["ids"]
    out = Publishing(f"{path}/manifest.json", 0)
    out.write(json.dumps(manifest).encode())
    out.publish()
    return manifest


def read(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """One row per document, from the files, each found by its key: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path, n)
                keys, nulls = shard.keys, shard.nulls
                first = shard.find(keys[nulls:])
                again = np.flatnonzero(np.diff(keys[nulls:], prepend=keys[nulls] - 1 if len(keys) > nulls else 0) == 0)
                where = first - nulls
                if (first < 0).any() or (np.delete(where, again) != np.delete(np.arange(len(where)), again)).any():
                    raise ValueError(f"the index of shard {n} does not lead to its documents")
                a = 0
                while a < len(keys):
                    z = max(a + 1, int(np.searchsorted(shard.bounds, shard.bounds[a] + IDS_AT_ONCE, "right")) - 1)
                    ids, bounds = shard.ids(a, z).astype("<u4"), shard.bounds[a : z + 1]
                    own = bounds - bounds[0]
                    crc = [zlib.crc32(ids[i:k]) for i, k in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    ids_of = pa.array(keys[a:z], mask=np.arange(a, z) < nulls)
                    yield pa.RecordBatch.from_arrays([ids_of, pa.array(bounds[:-1] + begin), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], [c.split()[0] for c in ROWS.split(", ")])
                    a = z

    shards = spark.createDataFrame([(r["shard"], r["start"]) for r in manifest], "shard int, start long")
    return shards.repartition(max(1, len(manifest)), "shard").mapInArrow(run, ROWS)


class TokenStore:
    """Keyed access to a store's files, outside Spark."""

    def __init__(self, path: str):
        self.path = path
        with opened(f"{path}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.keyed = [r for r in self.manifest if r["last_key"] is not None]
        self.lasts = [r["last_key"] for r in self.keyed]
        self.open: dict[int, Shard] = {}

    def _shard(self, n: int) -> Shard:
        if n not in self.open:
            self.open[n] = Shard(self.path, n)
        return self.open[n]

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document of a key."""
        if key is None:
            return [self._shard(r["shard"]).ids(i, i + 1) for r in self.manifest for i in range(r["null_docs"])]
        at = bisect_left(self.lasts, key)
        if at == len(self.lasts) or key < self.keyed[at]["first_key"]:
            return []
        shard = self._shard(self.keyed[at]["shard"])
        first = int(shard.find(np.array([key]))[0])
        return [] if first < 0 else [shard.ids(i, i + 1) for i in range(first, shard.last(first))]
