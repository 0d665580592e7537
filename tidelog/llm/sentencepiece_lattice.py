"""SentencePiece encoding and decoding as a relational lattice.

A text becomes words that no piece reaches across: runs of space marks with the letters or the signs that follow, and
line ends. Each different word is worked on once, in Spark SQL: at every place its substrings of one to
HEAD characters are exploded and equi-joined to the piece table (32,000 pieces under their heads, broadcast);
of the pieces under a head those stay that the word goes on with. They are grouped by word as edges of a
lattice, and a higher-order `aggregate` folds over the edges to the word's ids.

The fold. For a unigram model the best path is a Viterbi sum of scores. The model here is a BPE model, of which the
scores are merge ranks, and a path of the best sum is not what it encodes to. So the fold walks the edges from
the best rank down and takes an edge where just one boundary lies inside it, which is BPE's merge; boundaries
are the bits of a long. That is exact unless a word holds a piece that is made after a merge that ranks no better (irregular, runs of
the space mark mostly), or exceeds LONGEST characters; those words go through the same rule with a queue, in Python.

Assembly. Different words outnumber what one task may hold, so a task knows the KNOWN most frequent words of a sample of
SAMPLE documents and asks for the others it has: its wants are joined to the word table and written to the
shared folder by task, and the second reading of the texts finds all its words. The sample decides which words
are at hand everywhere, never what is found. Texts themselves are never shuffled. A task goes by the number
of the partition that its texts are read in, as the plan has it beneath the encoding, so merging or uniting
partitions later changes nothing. Where texts lie otherwise at the second reading (an input that is not
the same twice, a scan cut anew after executors were lost), a word that was not asked for goes through the
same rule with a queue, so ids are right whatever happens.

Defined results: a null or empty text has no ids; characters without a piece become byte pieces; repeated rows give
repeated results; empty tables give no rows; other columns are ignored. `decode` gives the text back, with
the mark of a space (U+2581) read as a space, as the library does.
"""

from __future__ import annotations

import ctypes
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import discard, fresh_path, stored
from tidelog.llm.files import place
from tidelog.llm.tokens import little_batches

SPACE = "▁"

#: Words of a text, as runs of letters and digits or of signs, with the marks before them. No piece of the model has a
#: mark after another character, a letter beside a sign, or a line end beside anything; raised powers are signs here.
_SIGN, _OTHER = f"(?:[^\\w{SPACE}\n]|[_²³¹])", "[^\\W_²³¹]"
WORDS = f"{SPACE}+(?:{_SIGN}+|{_OTHER}*)|{_SIGN}+|{_OTHER}+|\n"

#: Characters of a piece's head; few pieces have more, so few stand under one head.
HEAD = 5

#: Where a long has an edge's rank, its start and its piece's id; its lowest bits have the size.
RANK_AT, START_AT, ID_AT = 38, 26, 6

#: Characters of a word that the fold takes; a long has a bit for each boundary.
LONGEST = 60

#: Most frequent words that every task knows.
KNOWN = 100_000

#: Documents whose words are counted, about.
SAMPLE = 20_000

#: Different words that a task counts, or asks for, before it hands them on.
COUNTED = 400_000


#: Wanted words, repeated over tasks, for each part of the word table.
PART_WANTS = 400_000


class Model:
    """The piece table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(file, "rb") as f:
            m.ParseFromString(f.read())
        t, n = m.trainer_spec, m.normalizer_spec
        if t.model_type != t.BPE or not t.byte_fallback or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalization")
        self.pieces = {p.piece: (p.score, i) for i, p in enumerate(m.pieces) if p.type == p.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == p.BYTE}
        self.out = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else b"" if p.type == p.CONTROL else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.longest = max(map(len, self.pieces))
        order = {s: i for i, s in enumerate(sorted({s for s, _ in self.pieces.values()}, reverse=True))}
        self.rank = {p: order[s] for p, (s, _) in self.pieces.items()}
        whole = re.compile(WORDS).fullmatch
        if not all(whole(p) for p in self.pieces):
            raise ValueError("a piece reaches across words")

    def irregular(self, piece: str) -> bool:
        """Whether the piece, alone, is made after a merge that ranks no better than itself.

        As long as no merge reaches across the ends of a span, its inside goes the way that the span alone goes.
        So where every piece is made in the order of the ranks, one walk down the ranks meets every merge in time.
        """
        steps: list[int] = []
        self.merge(piece, steps)
        return len(steps) == len(piece) - 1 > 1 and steps[-1] <= max(steps[:-1])

    def rows(self) -> list[tuple[str, int, int, bool]]:
        """(piece, rank, id, irregular)."""
        return [(p, self.rank[p], i, self.irregular(p)) for p, (_, i) in self.pieces.items()]

    def merge(self, word: str, steps: list[int] | None = None) -> list[int]:
        """The ids of one word: again and again the best-ranked pair of neighbours, the first of equals, becomes one."""
        n = len(word)
        start, stop = list(range(n)), list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int]] = []

        def look(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank.get(word[start[i] : stop[j]])) is not None:
                heapq.heappush(queue, (r, i, stop[i], stop[j]))

        for i in range(n - 1):
            look(i)
        alive = [True] * n
        while queue:
            r, i, middle, end = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or stop[i] != middle or j >= n or stop[j] != end:
                continue
            stop[i], after[i], alive[j] = end, after[j], False
            if steps is not None:
                steps.append(r)
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                look(before[i])
            look(i)
        out, i = [], 0
        while i < n:
            piece = word[start[i] : stop[i]]
            out += [self.pieces[piece][1]] if piece in self.pieces else [self.bytes[b] for b in piece.encode()]
            i = after[i]
        return out


@lru_cache(maxsize=2)
def model(file: str) -> Model:
    return Model(file)


def give_back() -> None:
    """Return what a task has freed to the system, as its worker stays for the next one."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few texts are Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def marked(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@contextmanager
def hashed_groups(spark: SparkSession, keys: int = 200_000) -> Iterator[None]:
    """Lists of up to so many words a task are gathered by hashing; beyond that, and at first by default, by sorting."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, keys)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_table(words: DataFrame, file: str, parts: int) -> DataFrame:
    """(word, ids) of words: word, each once; dealt into so many parts."""
    m = model(file)
    spark = words.sparkSession
    rows = m.rows()
    # A piece is one long, rank first: rank, id and length; an edge adds the place where it starts.
    coded = [(p, (r << RANK_AT) | (i << ID_AT) | len(p), len(p)) for p, r, i, _ in rows]
    pieces = spark.createDataFrame(coded, "piece string, code long, size int")
    odd = [re.escape(p) for p, _, _, irregular in rows if irregular]
    smooth = (F.length("word") <= LONGEST) & (~F.col("word").rlike("|".join(odd)) if odd else F.lit(True))
    head = F.substring("piece", 1, HEAD).alias("head")
    heads = pieces.groupBy(head).agg(F.max(F.when(F.col("size") < HEAD, F.col("code"))).alias("short"), F.collect_list(F.when(F.col("size") >= HEAD, F.struct("piece", "code"))).alias("under"))
    heads = F.broadcast(heads)
    size = F.length("word")
    # Dealt by word before anything grows; what follows leaves each word where it is.
    places = words.where(smooth).repartition(parts, "word").select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    at = F.col("s") + 1
    joined = places.withColumn("rest", F.col("word").substr(at, F.lit(m.longest)))
    for n in range(1, HEAD + 1):
        table = heads.select(F.col("head").alias(f"head{n}"), F.col("short" if n < HEAD else "under").alias(f"found{n}"))
        joined = joined.join(table, (F.substring("rest", 1, n) == F.col(f"head{n}")) & (F.length("rest") >= n), "left")
    long = F.transform(F.filter(f"found{HEAD}", lambda p: F.startswith(F.col("rest"), p["piece"])), lambda p: p["code"])
    single = F.coalesce("found1", F.lit((1 << 62) | 1))  # a character without a piece
    found = F.concat(F.array(single), F.array_compact(F.array(*[F.col(f"found{n}") for n in range(2, HEAD)])), F.coalesce(long, F.array().cast("array<long>")))
    placed = F.transform(found, lambda c: c + F.col("s").cast("long") * (1 << START_AT))
    lattice = joined.select("word", placed.alias("found")).groupBy("word").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("edges"))
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)
    begin = lambda x: F.shiftright(x, START_AT).bitwiseAND(63).cast("int")
    size_of = lambda x: x.bitwiseAND(63).cast("int")
    number = lambda x: F.shiftright(x, ID_AT).bitwiseAND((1 << 16) - 1).cast("int")
    # Of an edge of size k moved down to its start: its ends are bits 0 and k, its inside what lies between.
    down = lambda b, x: F.call_function("shiftright", b, begin(x)).bitwiseAND(F.call_function("shiftleft", F.lit(2).cast("long"), size_of(x)) - 1)
    ends = lambda x: bit(size_of(x)) + 1
    start = (bit(F.length("word")) * 2 - 1).alias("start")

    def take(b, x):
        own = down(b, x)
        inside = own - ends(x)
        merges = (inside > 0) & (own.bitwiseAND(ends(x)) == ends(x)) & (inside.bitwiseAND(inside - 1) == 0)
        return F.when(merges, b - F.call_function("shiftleft", inside, begin(x))).otherwise(b)

    several = F.filter("edges", lambda x: size_of(x) > 1)
    walked = lattice.select("word", "edges", F.aggregate(several, start, take).alias("b"))
    chosen = F.filter("edges", lambda x: down(F.col("b"), x) == ends(x))
    by_place = F.transform(F.sort_array(F.transform(chosen, lambda x: begin(x).cast("long") * (1 << 24) + F.when(x >= (1 << 62), F.lit(1 << 20)).otherwise(number(x)))), lambda y: y.bitwiseAND((1 << 24) - 1).cast("int"))
    bare = F.element_at("edges", -1) < (1 << 62)
    first_byte = m.bytes[0]
    octets = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i, F.lit(1))), 16, 10).cast("int") + first_byte)
    starts = F.sort_array(F.transform(F.filter("edges", lambda x: down(F.col("b"), x) == ends(x)), begin))
    spelled = F.flatten(F.transform("ids", lambda y, i: F.when(y == (1 << 20), octets(F.col("word").substr(F.get(starts, i) + 1, F.lit(1)))).otherwise(F.array(y))))
    cut = walked.select("word", "edges", "b", by_place.alias("ids"), bare.alias("bare"))
    smooth_rows = cut.select("word", F.when(F.col("bare"), F.col("ids")).otherwise(spelled).alias("ids"))

    def queued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = model(file).merge
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merge(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return smooth_rows.unionByName(words.where(~smooth).select("word").mapInArrow(queued, "word string, ids array<int>"))


class Known:
    """Word to ids, in two tables: the frequent words of all tasks and the others of one."""

    def __init__(self, table: pa.Table):
        self.place = dict(zip(table["word"].to_pylist(), range(table.num_rows), strict=True))
        lists = table["ids"].combine_chunks()
        self.ids, self.ends = lists.values.to_numpy(zero_copy_only=False).astype(np.uint16), lists.offsets.to_numpy().astype(np.int64)


class Others(dict):
    """The place of each word of one task behind those of the frequent ones; a word that is new gets the next place and waits for its ids."""

    def __init__(self, place: dict[str, int], shift: int):
        super().__init__((w, p + shift) for w, p in place.items())
        self.new: list[str] = []
        self.next = shift + len(self)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        place = self[word] = self.next
        self.next += 1
        return place


class Spelling:
    """The bytes of many ids at once."""

    def __init__(self, out: list[bytes]):
        self.bytes, self.ends = np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, bounds by id)."""
        begin = self.ends[ids]
        size = self.ends[ids.astype(np.int64) + 1] - begin
        bounds = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(begin - bounds[:-1], size) + np.arange(int(bounds[-1]))], bounds


def _read(uri: str) -> pa.Table:
    fs, path = place(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    return pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["word", "ids"])


@lru_cache(maxsize=1)
def at_hand(uri: str) -> frozenset[str]:
    fs, path = place(uri)
    return frozenset(pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["word"])["word"].to_pylist())


@lru_cache(maxsize=1)
def frequent(uri: str) -> Known:
    return Known(_read(uri))


def encode(docs: DataFrame, file: str, known: int = KNOWN) -> DataFrame:
    """One row per document: doc_id, ids, round_trip (decoding gives the text back)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    find = re.compile(WORDS).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for t in part.column(1).to_pylist():
                counts.update(find(marked(t)))
                if len(counts) > COUNTED:
                    yield rows_of()
                    counts.clear()
        yield rows_of()
        counts.clear()
        give_back()

    share = min(1.0, SAMPLE / max(1, rows.count()))
    counted = rows.sample(share, seed=1).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") <= LONGEST)
    listed = stored(counted.orderBy(F.desc("n"), "word").limit(known).select("word"), "listed-words")
    listed_at = listed.stored_at

    def wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, task, new = at_hand(listed_at), 0, set()
        for part in slices(batches):
            task = part.column(2)[0].as_py()
            for t in part.column(1).to_pylist():
                new.update(find(marked(t)))
            if len(new) > COUNTED:
                new -= have
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(new), pa.int32()), pa.array(sorted(new), pa.string())], ["task", "word"])
                new = set()
        new -= have
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(new), pa.int32()), pa.array(sorted(new), pa.string())], ["task", "word"])
        new.clear()
        give_back()

    wanted = stored(rows.mapInArrow(wants, "task int, word string"), "wants", "zstd")
    # Few enough words a task for groups to be hashed: different words are at most all that are wanted.
    parts = max(1, -(-(wanted.count() + known) // PART_WANTS))
    with hashed_groups(spark):
        table = stored(word_table(wanted.select("word").union(listed).distinct(), file, parts), "words", "zstd")
    top, answers = fresh_path(spark, "frequent-words"), fresh_path(spark, "wanted-words")
    listed.join(table, "word").write.parquet(top)
    wanted.join(table, "word").repartition("task").sortWithinPartitions("task").write.option("compression", "zstd").partitionBy("task").parquet(answers)
    discard(wanted, table, listed)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, all_know = model(file), frequent(top)
        get, other, out = all_know.place.get, None, Spelling(m.out)
        for part in slices(batches):
            if other is None:
                own = Known(_read(f"{answers}/task={part.column(2)[0].as_py()}"))
                ids = np.concatenate([all_know.ids, own.ids])
                ends = np.concatenate([all_know.ends, own.ends[1:] - own.ends[0] + all_know.ends[-1]])
                other = Others(own.place, len(all_know.place))
                del own
            doc_ids, texts = part.column(0), part.column(1).to_pylist()
            for a, z in little_batches(texts, 500_000):
                split = [find(marked(t)) for t in texts[a:z]]
                counts = np.fromiter(map(len, split), np.int64, z - a)
                flat = chain.from_iterable(split)
                at = np.fromiter((p if (p := get(w)) is not None else other[w] for w in flat), np.int64, int(counts.sum()))
                if other.new:
                    found = [m.merge(w) for w in other.new]
                    other.new = []
                    ids = np.concatenate([ids, np.array(list(chain.from_iterable(found)), ids.dtype)])
                    ends = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in found])])
                begin = ends[at]
                size = ends[at + 1] - begin
                before = np.cumsum(size) - size
                got = ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
                word_ends, id_ends = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(size)])
                bounds = id_ends[word_ends]
                raw, raw_ends = out.spell(got)
                same = [bytes(raw[i:k]) == marked(t).replace(SPACE, " ").encode() for t, i, k in zip(texts[a:z], raw_ends[bounds[:-1]].tolist(), raw_ends[bounds[1:]].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, z - a), lists, pa.array(same)], ["doc_id", "ids", "round_trip"])
        other = ids = ends = None
        give_back()

    return rows.mapInArrow(assemble, "doc_id long, ids array<int>, round_trip boolean")


def decoded(ids: list[int], out: list[bytes]) -> str:
    """The text of ids; the space before the first word is not part of it."""
    raw = b"".join([out[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = model(file).out
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decoded(x, out) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
