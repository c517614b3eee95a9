"""Word vectors in the binary and the text format: a header of count and length, then a name and numbers per row.

A binary file is read in ranges of bytes, a task each. Names differ in length and the numbers may hold any byte, so
a task that starts inside the file looks for a place from which CHAIN rows follow one another (or as many
as are left): a name of UTF-8 without white space, a blank, the numbers, all finite. A range owns the rows that begin in it.

Defined cases: rows may end with a newline or not, as the first one does; a file that is not binary
is read as text; an empty vocabulary has no rows; a row that breaks off ends the file with an error; repeated names are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiforge.sources.office import place

SPLIT = 32 << 20
LONGEST_NAME = 1024
CHAIN = 8
_SPACE = b" \t\r\n\x0b\x0c"


@dataclass
class Layout:
    """Where the rows begin, how long vectors are, whether a newline ends each, the file's size."""

    begin: int
    dim: int
    newline: int
    size: int


def row_at(raw: bytes, at: int, layout: Layout) -> tuple[str, int] | None:
    """(name, place after the row) if a whole row stands at a place of raw."""
    blank = raw.find(b" ", at, at + LONGEST_NAME + 1)
    end = blank + 1 + 4 * layout.dim + layout.newline
    if blank <= at or end > len(raw) or layout.newline and raw[end - 1 : end] != b"\n":
        return None
    name = raw[at:blank]
    if any(c in _SPACE for c in name):
        return None
    try:
        text = name.decode()
    except UnicodeDecodeError:
        return None
    return (text, end) if np.isfinite(np.frombuffer(raw, "<f4", layout.dim, blank + 1)).all() else None


def layout_of(f, size: int) -> Layout | None:
    """Of an open binary file, or None if its first row is a line of text or none at all."""
    head = f.read(64)
    first, line, _ = head.partition(b"\n")
    if not line:
        raise ValueError("no header of count and length")
    count, dim = map(int, first.split())
    begin = len(first) + 1
    if not count:
        return Layout(begin, dim, 0, begin)
    f.seek(begin)
    raw = f.read(LONGEST_NAME + 4 * dim + 2)
    fields = raw.partition(b"\n")[0].split()[1:]
    if len(fields) == dim and all(re.fullmatch(rb"[-+0-9.eE]+|nan|inf", x) for x in fields):
        return None
    plain = row_at(raw, 0, Layout(begin, dim, 0, size))
    if plain is None:
        return None
    return Layout(begin, dim, int(raw[plain[1] : plain[1] + 1] == b"\n"), size)


def first_row(raw: bytes, start: int, to_end: bool, layout: Layout) -> int | None:
    """The first place at or after start from which CHAIN rows follow one another, or rows up to the file's end; it may lie within a name."""
    for at in range(start, len(raw)):
        here = at
        for k in range(CHAIN):
            row = row_at(raw, here, layout)
            if row is None:
                break
            here = row[1]
            if to_end and here == len(raw):
                return at
        else:
            return at
    return None


@dataclass
class _Range(InputPartition):
    start: int
    end: int
    layout: Layout


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        store, at = place(self.path)
        with store.open_input_file(at) as f:
            layout = layout_of(f, f.size())
        if layout is None:
            raise ValueError(f"{self.path} is not in the binary format")
        return [_Range(a, min(a + self.split, layout.size), layout) for a in range(layout.begin, layout.size, self.split)] or [_Range(0, 0, layout)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        layout = partition.layout
        if partition.start >= partition.end:
            return
        # What lies behind the range: the rest of its last row, and rows that prove where others begin. What lies before
        # it: a row found within a name's letters ends where it should, so the search starts two rows ahead.
        longest = LONGEST_NAME + 4 * layout.dim + 2
        base = max(layout.begin, partition.start - 2 * longest)
        store, at = place(self.path)
        with store.open_input_file(at) as f:
            f.seek(base)
            raw = f.read(min(partition.end + (CHAIN + 1) * longest, layout.size) - base)
        here = 0
        if base > layout.begin:
            here = first_row(raw, 0, base + len(raw) == layout.size, layout)
            if here is None:
                raise ValueError(f"no row near byte {partition.start} of {self.path}")
            here = row_at(raw, here, layout)[1]
        while here < partition.end - base:
            row = row_at(raw, here, layout)
            if row is None:
                raise ValueError(f"no row at byte {base + here} of {self.path}")
            name, end = row
            if here >= partition.start - base:
                yield name, np.frombuffer(raw, "<f4", layout.dim, end - layout.newline - 4 * layout.dim).tolist()
            here = end


class Vectors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wordvectors"

    def schema(self) -> str:
        return "word string, vec array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_vectors(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(word, vec) of a binary file, read in ranges of `split` bytes, or else of a text file."""
    store, at = place(path)
    with store.open_input_file(at) as f:
        binary = layout_of(f, f.size()) is not None
    if binary:
        spark.dataSource.register(Vectors)
        return spark.read.format("wordvectors").option("split", split).load(path)
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def row_bytes(words, vectors: np.ndarray) -> bytes:
    """Rows of the binary format, with newlines."""
    return b"".join(w.encode() + b" " + v.astype("<f4").tobytes() + b"\n" for w, v in zip(words, vectors))
