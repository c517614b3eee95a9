"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacities.

A document's ids are those of a public byte-level BPE, then an end id 0. An overlong document is first
cut into full windows; what is left of it, and every shorter document, goes to the tightest open window.

Defined cases: a null or empty text is the end id alone; repeated rows are packed once each; a null
doc_id stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.llm.common import cut, table

CAPACITY = 1024
END = 0
#: Pieces that are packed together in one task; the least full windows of a shard are few against it.
SHARD = 16_384
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_loaded: dict = {}


class _Tokenizer:
    """The ids of the JSON tokenizer; its vocabulary as ranks gives the same ids in a quarter of the time.

    They differ only where a text holds the string of an added token, which then goes to the JSON tokenizer.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("lexiforge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


def tokenizer(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> _Tokenizer:
    if (vocabulary, ranks) not in _loaded:
        _loaded[vocabulary, ranks] = _Tokenizer(vocabulary, ranks)
    return _loaded[vocabulary, ranks]


def windows(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the full windows and of the rest."""
    return [(at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ids if asked for."""

    def run(batches):
        bpe = tokenizer(vocabulary, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(bpe.ids(text or ""), np.uint32(END)).astype("<u4")
                for start, part in windows(ids, capacity):
                    out.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if with_ids else [])))
            columns = list(zip(*out)) or [[]] * (5 + with_ids)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
            names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES + (", ids array<long>" if with_ids else ""))


class OpenWindows:
    """Open windows by remaining capacity; each tree node knows whether one is open below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, window: int, left: int) -> None:
        self.at[left].append(window)
        i = self.size + left
        while i and not self.any[i]:
            self.any[i] = True
            i //= 2

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least remaining capacity that is at least need; (window, left)."""
        i = self.size + need
        if not self.any[i]:
            while i > 1 and (i % 2 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        left = i - self.size
        window = self.at[left].pop()
        if not self.at[left]:
            self.any[i] = False
            i //= 2
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = False
                i //= 2
        return window, left


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length, placed in the given order."""
    open_, used, where, offset = OpenWindows(capacity), 0, [], []
    for n in lengths:
        found = open_.tightest(n) if n < capacity else None
        window, left = found or (used, capacity)
        used += found is None
        where.append(window)
        offset.append(capacity - left)
        if left > n:
            open_.put(window, left - n)
    return where, offset


def place(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces with sequence_id and offset. They are dealt out by hash, so shards are even and bounded."""
    shards = max(1, -(-pieces.count() // shard))

    def run(key, part):
        part = part.drop_columns(["_shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(part["length"].to_pylist(), capacity)
        part = part.append_column("sequence_id", pa.array(np.array(where, np.int64) + (key[0].as_py() << 32)))
        return part.append_column("offset", pa.array(offset, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards).cast("long")))
    return dealt.groupBy("_shard").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """One row per piece; tokenised once, then only the pieces' sizes are moved (and their ids if asked for)."""
    return place(cut(cut_documents(docs, capacity, vocabulary, ranks, with_ids)), capacity, shard)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """(sequence_id, ids, used): the windows themselves, padded unless their length is a power of two."""
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = whole.withColumn("used", F.size("ids"))
    padding = F.when(F.bit_count("used") == 1, 0).otherwise(F.lit(capacity) - F.col("used"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), padding)).alias("ids"), "used")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
