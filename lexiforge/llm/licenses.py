"""License scans by a positional index of rare words.

For each notice, the index holds postings (notice, position) of its rarest words over all files: as many as
carry more than the weight that a match may lack. So every place where a notice stands agrees in one of
them, and no place is missed. A file's words are looked up there; a word at p in the file and at q in a
notice proposes that the notice starts at p - q. Proposals of notices whose mandatory phrases the file has are
compared word by word, and the notice counts if the rarity-weighted share of its words that agree reaches
MATCH and its mandatory phrases stand inside the aligned stretch. Base phrases are found at every place
besides. Long licences are indexed by paragraph, so that words added between them do not matter.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned row
by row; a null doc_id keeps its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.llm.common import table

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Notice:
    """words of a licence notice in order; each phrase of `must` has to stand in the matched stretch."""

    label: str
    text: str
    must: tuple[str, ...]


# Notices as they are commonly placed in files, and paragraphs of whole licences, by public licence.
NOTICES = (
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "licensed under the mit license", ("mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Notice("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    Notice("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    Notice("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    Notice("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license", "redistribute it")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Notice("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Notice("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("without restriction", "free of charge")),
    Notice("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions of the software",)),
    Notice("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("noninfringement", "other dealings in the software")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("appear in all copies",)),
    Notice("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("disclaims all warranties", "tortious action")),
    Notice("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code",)),
    Notice("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form",)),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Notice("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("required by applicable law", "governing permissions and limitations")),
    Notice("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "gnu general public license")),
    Notice("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl",)),
    Notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable for any damages",)),
    Notice("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    Notice("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: The share of a notice's weight that must agree.
MATCH = 0.75
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and characters beyond ASCII."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TABLE).split()


def rarest(weights: list[float], line: list[bytes], slack: float) -> list[int]:
    """Positions of the rarest words of a notice, as few as weigh more than slack together."""
    taken, so_far = [], 0.0
    for q in sorted(range(len(line)), key=lambda q: (-weights[q], line[q], q)):
        taken.append(q)
        so_far += weights[q]
        if so_far > slack + 1e-6:
            break
    return taken


@dataclass
class Index:
    """idf: rarity over all files of each word of a notice or base phrase."""

    notices: tuple[Notice, ...]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self) -> None:
        self.lines = [words(n.text) for n in self.notices]
        self.weights = [sum(self.idf[w] for w in line) or 1.0 for line in self.lines]
        self.musts = [[b" " + b" ".join(words(m)) + b" " for m in n.must] for n in self.notices]
        self.phrases = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in BASE.items()]
        for t, line in enumerate(self.lines):
            for q in rarest([self.idf[w] for w in line], line, (1 - MATCH) * self.weights[t]):
                self.postings[line[q]].append((t, q))
        self.vocabulary = frozenset(self.idf)
        # Without the rarest-looking word of some must phrase or base phrase, no label can come about.
        least = lambda phrase: max(phrase.split(), key=lambda w: (self.idf.get(w, 0.0), w))
        self.needed = frozenset(least(m) for must in self.musts for m in must[:1]) | frozenset(least(p) for p, _ in self.phrases)

    def base(self, joined: bytes) -> tuple[int, int | None, int | None, set[str]]:
        """Places of all base phrases: how many, first and last word, labels. joined: b" w w w "."""
        n, first, last, labels = 0, None, None, set()
        for phrase, label in self.phrases:
            at, word, before = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", before, at)
                before = at
                n += 1
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
                labels.add(label)
                at = joined.find(phrase, at + 1)
        return n, first, last, labels

    def agreement(self, t: int, start: int, own: list[bytes]) -> float:
        """The share of notice t's weight that agrees if it starts at a word of the file; 0 without its mandatory phrases."""
        line, low, high = self.lines[t], max(0, -start), min(len(self.lines[t]), len(own) - start)
        share = sum(self.idf[line[q]] for q in range(low, high) if own[start + q] == line[q]) / self.weights[t]
        if share >= MATCH:
            stretch = b" " + b" ".join(own[start + low : start + high]) + b" "
            if not all(m in stretch for m in self.musts[t]):
                return 0.0
        return min(1.0, share)

    def aligned(self, own: list[bytes], present: frozenset[bytes], joined: bytes) -> dict[str, float]:
        """Labels of the notices found and their best share; joined: b" w w w "."""
        # A notice whose mandatory phrases stand nowhere in the file can't be found.
        open_notices = {t for t, must in enumerate(self.musts) if all(m in joined for m in must)}
        at = {w: own_at for w in present if (own_at := [x for x in self.postings.get(w, ()) if x[0] in open_notices])}
        starts = {(t, p - q) for p, w in enumerate(own) for t, q in at.get(w, ())}
        found: dict[str, float] = {}
        for t, start in starts:
            share = self.agreement(t, start, own)
            if share >= MATCH:
                label = self.notices[t].label
                found[label] = max(found.get(label, 0.0), share)
        return found

    def scan(self, raw: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        own = words(raw)
        present = self.vocabulary.intersection(own)
        if present.isdisjoint(self.needed):
            return len(own), 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(own) + b" "
        n, first, last, labels = self.base(joined)
        more = self.aligned(own, present, joined)
        score = max([0.5 if n else 0.0, *more.values()])
        return len(own), n, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | set(more))), score


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of files, and for each notice word in how many of them it stands; counted over all files."""

    def run(batches):
        count, n = Counter(), 0
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                count.update(vocabulary.intersection(words(raw)))
        rows = [(w.decode(), k) for w, k in count.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()))], ["word", "n"])

    found = {r["word"].encode(): r["n"] for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def build_index(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> Index:
    """The index, its size given by the notices alone."""
    vocabulary = frozenset(w for text in [*(n.text for n in notices), *BASE] for w in words(text))
    total, df = frequencies(docs, vocabulary)
    return Index(notices, {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary})


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, notices))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def run(batches):
        for batch in batches:
            found = list(zip(*map(shared.value.scan, batch.column(1).cast(pa.binary()).to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
