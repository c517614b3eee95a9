"""Language-model scores: a text's probability over all ways to cut its words into pieces of a public vocabulary.

A text is its words and an end. Pieces are drawn one by one with the weights of a unigram model; a piece
that starts a word bears a mark. No piece crosses a word's border, so the probability of a text, summed
over all segmentations, is the product of its words' sums, each found by the forward recursion over
the word's lattice in log space, times that of the end. Any code point can be drawn as its UTF-8 bytes,
so no text is impossible.

The pieces and the order of their scores are the vocabulary's (its scores are ranks, which are read as
1 / (rank + 10)). The weights start there and are estimated again from the counts of all training words: each
round gives every piece its expected count over all segmentations (forward times backward) of the
distinct words, plus PRIOR counts dealt by the starting weights. The tokenizer itself is not trained.

The base score needs the training count of every token. Words that make up at least one SHARE-th of the
training tokens, of which there are SHARE at most, are broadcast with their counts; all others of a
document are joined with the counts by word. So frequent words do not meet in one task, and nothing that
grows without bound is broadcast.

Defined cases: a null or empty text is the end alone; a null doc_id keeps its row and counts as held
out; repeated rows score alike and count as often; without training rows all counts are 0, the base
score is 0 and the weights are the starting ones; a word of any length is scored whole (for learning, words
over PART code points are cut into parts); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiforge.llm.common import cut, table

VOCABULARY = "piece_bpe_32k.model"
FOLDS = 10
ROUNDS = 4
PRIOR = 32_000.0
SHARE = 500_000
#: Distinct words that a task counts at a time, and those whose scores it remembers.
HELD, REMEMBERED = 300_000, 500_000
#: Distinct words whose lattices are made at a time; those of one length share their steps.
WORDS_AT_ONCE = 100_000
#: Documents that are scored at a time.
AT_ONCE = 1024
#: Code points of a lattice that are worked on at a time.
CELLS = 1 << 16
PART = 1024
#: Longer words are looked up by their digest.
KEY_BYTES = 32
_MARK = " "
_LOG10 = math.log(10)


@dataclass
class Pieces:
    """Hashes of all pieces, sorted, the longest piece's length, and each one's starting weight; then 256 bytes, then the end."""

    hashes: np.ndarray
    longest: int
    start: np.ndarray

    def __post_init__(self):
        self.slot = np.full(1 << 19, -1, np.int32)
        self.slot[self.hashes >> np.uint64(45)] = np.arange(len(self.hashes))

    def __reduce__(self):  # the table is made again where this arrives
        return Pieces, (self.hashes, self.longest, self.start)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places in h that hold the hash of a piece, and the piece there; two pieces may share a slot, then a search decides."""
        at = self.slot[h >> np.uint64(45)]
        where = np.nonzero(at >= 0)
        at, h = at[where], h[where]
        other = np.flatnonzero(self.hashes[at] != h)
        at[other] = np.searchsorted(self.hashes, h[other]).clip(0, len(self.hashes) - 1)
        same = self.hashes[at] == h
        return *(x[same] for x in where), at[same]

    @property
    def bytes_at(self) -> int:
        return len(self.hashes)

    @property
    def end(self) -> int:
        return len(self.hashes) + 256


def _extended(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer; that of the empty string is 0."""
    h = (h ^ (codes + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


def pieces_of(scored: dict[str, float]) -> Pieces:
    """Pieces (a word's first one begins with a space) and their ranks; every rank is a number of 0 or more."""
    named, hashes = list(scored), np.zeros(len(scored), np.uint64)
    for at, codes in _by_length([p[1:] for p in named], [p[0] for p in named]):
        for c in codes.astype(np.uint64):
            hashes[at] = _extended(hashes[at], c)
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces share a hash")
    weight = 1 / (np.array(list(scored.values())) + 10)
    # Bytes and the end are as rare as the last piece.
    start = np.concatenate([weight[order], np.full(257, weight.min())])
    return Pieces(hashes[order], max(map(len, scored)), start / start.sum())


def public_pieces(vocabulary: str = VOCABULARY) -> Pieces:
    """The vocabulary's pieces that can occur within a word; control pieces and runs of spaces are none."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    named = ((model.id_to_piece(i), model.get_score(i)) for i in ids)
    return pieces_of({p.replace("▁", _MARK): -score for p, score in named if "▁" not in p[1:]})


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes: 4 x codes, which of them there are)."""
    c = codes.astype(np.int64)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    lead = np.choose(size - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
    rest = [0x80 | (c >> np.maximum(6 * (size - 2 - k), 0)) & 0x3F for k in range(3)]
    return np.stack([lead, *rest]), np.stack([size > k for k in range(4)])


class Lattice:
    """Marginal log probabilities of words under weights, and expected counts of pieces.

    Words of one length are worked on together: positions are rows, words are columns.
    """

    def __init__(self, pieces: Pieces, weights: np.ndarray):
        self.pieces, self.log = pieces, np.log(weights)

    def arcs(self, codes: np.ndarray, starts: int):
        """(weights of code points as bytes: starts x words, per start the arcs (length, words, pieces), per length the same as flat arrays)."""
        if codes.max() < 0x80:
            as_bytes = self.log[self.pieces.bytes_at + codes[:starts].astype(np.int64)]
        else:
            values, there = _utf8(codes[:starts])
            as_bytes = np.einsum("kij,kij->ij", self.log[self.pieces.bytes_at + values], there)
        wide, h, flat, by_start = codes.astype(np.uint64), np.zeros((starts, codes.shape[1]), np.uint64), [], [[] for _ in range(starts)]
        for k in range(1, min(self.pieces.longest, len(codes)) + 1):
            m = min(starts, len(codes) - k + 1)
            h = _extended(h[:m], wide[k - 1 : k - 1 + m])
            j, i, piece = self.pieces.find(h)
            flat.append((k, j, i, piece))
            at = np.searchsorted(j, np.arange(m + 1)).tolist()
            for start in range(m):
                if at[start] < at[start + 1]:
                    own = slice(at[start], at[start + 1])
                    by_start[start].append((k, i[own], piece[own]))
        return as_bytes, by_start, flat

    def _forward(self, as_bytes: np.ndarray, by_start: list, sums: np.ndarray) -> np.ndarray:
        """Log sums over all ways to each position; sums: what is known of the first ones (longest + 1 rows)."""
        out = np.concatenate([sums, np.full(as_bytes.shape, -np.inf)])
        for j, own in enumerate(by_start):
            out[j + 1] = np.logaddexp(out[j + 1], out[j] + as_bytes[j])
            for k, i, piece in own:
                out[j + k, i] = np.logaddexp(out[j + k, i], out[j, i] + self.log[piece])
        return out

    def _start(self, n: int) -> np.ndarray:
        sums = np.full((self.pieces.longest + 1, n), -np.inf)
        sums[0] = 0
        return sums

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for at, codes in _by_length(words):
            length, n = codes.shape
            sums = self._start(n)
            # A long word goes stretch by stretch; arcs that reach over a border leave their part in sums.
            for a in range(0, length, CELLS):
                steps = min(CELLS, length - a)
                as_bytes, by_start, _ = self.arcs(codes[a : a + steps + self.pieces.longest], steps)
                sums = self._forward(as_bytes, by_start, sums)[steps:]
            out[at] = sums[0]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is drawn in these words, over all segmentations."""
        out = np.zeros(len(self.log))
        for at, codes in _by_length(words):  # none without words
            length, n = codes.shape
            as_bytes, by_start, flat = self.arcs(codes, length)
            ahead = self._forward(as_bytes, by_start, self._start(n))
            behind = np.zeros((length + 1, n))
            for j in range(length - 1, -1, -1):
                behind[j] = behind[j + 1] + as_bytes[j]
                for k, i, piece in by_start[j]:
                    behind[j, i] = np.logaddexp(behind[j, i], behind[j + k, i] + self.log[piece])
            total = ahead[length] - np.log(counts[at])
            k = np.repeat([f[0] for f in flat], [len(f[1]) for f in flat])
            j, i, piece = (np.concatenate([f[c] for f in flat]) for c in (1, 2, 3))
            out += np.bincount(piece, np.exp(ahead[j, i] + self.log[piece] + behind[j + k, i] - total[i]), len(out))
            here = np.exp(ahead[:length] + as_bytes + behind[1:] - total)
            if codes.max() < 0x80:
                out += np.bincount(self.pieces.bytes_at + codes.ravel().astype(np.int64), here.ravel(), len(out))
            else:
                values, there = _utf8(codes)
                out += np.bincount((self.pieces.bytes_at + values)[there], np.broadcast_to(here, there.shape)[there], len(out))
        return out


def _by_length(words: list[str], marks: list[str] | None = None):
    """(numbers of words, their code points with the mark in front: positions x words) for words of one length, so many at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes = code_points("".join(map("".join, zip(marks, words))) if marks else _MARK + _MARK.join(words))
    first = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    for length in np.unique(size):
        own = order[np.searchsorted(size[order], length) : np.searchsorted(size[order], length, "right")]
        step = max(1, CELLS // int(length))
        for k in range(0, len(own), step):
            yield own[k : k + step], codes[np.arange(length)[:, None] + first[own[k : k + step]]]


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A to Z as lower case; bytes split at the six ASCII white-space characters alone."""
    return raw.lower().split() if raw else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of training rows; the end is the empty word."""

    def run(batches):
        seen: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for raw in _raw(batch.column(0)):
                seen.update(tokens(raw))
                seen[b""] += 1
                if len(seen) > HELD:
                    yield flushed()
        yield flushed()

    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    # Tasks have summed their words already. Few bytes are much work in the rounds, so partitions are not to be merged by size.
    dealt = rows.mapInArrow(run, "word string, n long").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return dealt.groupBy("word").agg(F.sum("n").alias("n"))


def parts(word: str) -> list[str]:
    return [word[k : k + PART] for k in range(0, len(word), PART)]


def estimated(pieces: Pieces, counts: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Weights after rounds of expected counts over all distinct words of counts (word, n).

    A task returns a row per piece it met, so what is collected is bounded by the vocabulary. Sums are
    decimals, whose order does not matter.
    """
    spark, weights = counts.sparkSession, pieces.start
    words = counts.where("word <> ''")
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, weights))

        def run(batches):
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.log))
            some, n = [], []
            for batch in batches:
                for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = parts(word)
                    some += own
                    n += [count] * len(own)
                if len(some) > WORDS_AT_ONCE:
                    total += lattice.expected(some, np.array(n, np.float64))
                    some, n = [], []
            total += lattice.expected(some, np.array(n, np.float64))
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["piece", "n"])

        found = words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,12)")).cast("double").alias("n")).toArrow()
        expected = np.zeros(len(weights))
        expected[found["piece"].to_numpy()] = found["n"].to_numpy()
        expected[pieces.end] = ends
        expected += prior * pieces.start
        weights = expected / expected.sum()
        shared.unpersist()
    return weights


def key_of(word: bytes) -> bytes:
    """A word, or a space and its digest where it is long."""
    return word if len(word) <= KEY_BYTES else b" " + hashlib.md5(word).digest()


def key_column(word: Column) -> Column:
    return F.when(F.octet_length(word) <= KEY_BYTES, word.cast("binary")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5(word.cast("binary")))))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<key:binary,n:long>>"


def scores(docs: DataFrame, pieces: Pieces | None = None, rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    spark = docs.sparkSession
    pieces = pieces or public_pieces()
    counts = cut(token_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = math.log10(n + 0.1 * (v + 1))
    base_of = lambda c: math.log10(c + 0.1) - below
    often = (F.col("n") * share >= n) | (F.col("word") == "")
    head = counts.where(often).select(key_column(F.col("word")).alias("key"), "n").toArrow()
    weights = estimated(pieces, counts, rounds)
    shared = spark.sparkContext.broadcast((pieces, weights, dict(zip(head["key"].to_pylist(), map(base_of, head["n"].to_pylist())))))
    end = base_of(0)

    def run(batches):
        pieces, weights, base = shared.value
        lattice, known = Lattice(pieces, weights), {}
        ending = base.get(b"", end), int(b"" in base), float(lattice.log[pieces.end])
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, max(1, b.num_rows), AT_ONCE)):
            held, rows = [Counter(tokens(raw)) for raw in _raw(batch.column(2))], []
            new = {w for own in held for w in own if w not in known}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {w for own in held for w in own}
            new = list(new)
            logs = lattice.log_probabilities([w.decode() for w in new]).tolist()
            known.update((w, (p, base.get(w if len(w) <= KEY_BYTES else key_of(w)))) for w, p in zip(new, logs))
            keys, times, ends = [], [], [0]
            for own in held:
                total, sure, found = ending[2], ending[0], ending[1]
                for w, k in own.items():
                    p, b = known[w]
                    total += k * p
                    if b is None:
                        keys.append(w)
                        times.append(k)
                    else:
                        sure += k * b
                        found += k
                ends.append(len(keys))
                rows.append((own.total() + 1, found, sure, total / _LOG10))
            rest = pa.StructArray.from_arrays([pa.array([w if len(w) <= KEY_BYTES else key_of(w) for w in keys], pa.binary()), pa.array(times, pa.int64())], ["key", "n"])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.mapInArrow(run, _SCORED).withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode("rest").alias("w")).select("row", "w.key", F.col("w.n").alias("times"))
    seldom = counts.where(~often).select(key_column(F.col("word")).alias("key"), F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    joined = rest.join(seldom, "key", "left").groupBy("row").agg(F.sum(F.col("times") * (F.log10(c + 0.1) - below)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("met"))
    out = rows.drop("rest").join(joined, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
