"""Files in several encodings, dictionaries, stores on disk, and the corpus as a stream."""

import json
import zipfile

import pytest

from lexiforge.operators import lexicons as L, neighbours as V, store
from lexiforge.sources import files
from lexiforge.streaming import accumulate


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Слово\r\nдва".encode())
    (tmp_path / "b.txt").write_bytes("Слово".encode("cp1251"))
    (tmp_path / "c.txt").write_bytes(b"\x98" + "Слово".encode("cp866"))
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("Первый", " ", "Второй")) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>в таблице</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    paths = [str(tmp_path / n) for n in ("b.txt", "a.txt", "d.docx", "c.txt", "a.txt")]
    got = [r.text for r in files.read_texts(spark, paths).orderBy("ord").collect()]
    assert got[:3] == ["Слово", "Слово\nдва", "Первый\nВторой"] and got[3].endswith("Слово") and len(got) == 4
    with pytest.raises(ValueError):
        files.read_texts(spark, ["x.pdf"])


def test_dictionaries(spark, tmp_path):
    p = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    assert sorted(r.word for r in files.json_words(spark, p("a.json", '[" Суд ", "закон"]'), "law").collect()) == ["закон", "суд"]
    assert [r.word for r in files.json_words(spark, p("b.json", '{"Суд": 1}'), "law").collect()] == ["суд"]
    assert files.json_frequencies(spark, p("c.json", '{"и": [1, 36209.75, "misc"]}')).first().ipm == 36209.75
    assert files.json_layers(spark, p("l.json", json.dumps({"б": ["x", "obscene"], "а": "archaic"}))).orderBy("ord").first().surface == "б"
    got = files.csv_frequencies(spark, p("d.csv", "Rank,Lemma,PoS,Freq\n1,и,conj,\"10,5\"\n0,zero,s,0\nx,bad,s,1\n,#c,s,1\n")).collect()
    assert [(r.lemma, r.rank, r.ipm) for r in got] == [("и", 1, 10.5)]
    got = files.tsv_frequencies(spark, p("e.tsv", "lemma\tpos\tipm\trank\nОн\tspro\t1,5\t4\nx\ts\tbad\t0\n")).collect()
    assert [(r.lemma, r.pos, r.ipm, r.rank) for r in got] == [("он", "pron", 1.5, 4)]
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("list.txt", "1 36209.75 и conj\n2 5 он\nbad\n".encode("cp1251"))
    assert [(r.lemma, r.rank) for r in files.zip_lines(spark, str(tmp_path / "f.zip")).collect()] == [("и", 1), ("он", 2)]
    twice = spark.createDataFrame([(0, "a", 5, 1.0, "s"), (1, "a", 3, 9.0, "v"), (2, "a", 1, 9.0, "x")], "ord long, lemma string, rank int, ipm double, pos string")
    assert L.best_by_ipm(twice).first().pos == "v"


def test_layer_conflicts(spark):
    entries = spark.createDataFrame([(0, "Слово", ["archaic"]), (1, "слово", ["obscene", "nonsense"]), (2, "слово", ["obscene"]), (3, "как бы", ["vernacular"]), (4, "дом", ["vernacular"])], "ord int, surface string, layers array<string>")
    white = spark.createDataFrame([("дом",)], "lemma string")
    assert {(r.phrase, r.layer) for r in L.build_layers(entries, white).collect()} == {("слово", "obscene"), ("как бы", "vernacular")}


def test_stream_appends_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Он читал новую книгу. " * 30, "ru", "s", 10) for i in range(4)] + [(9, "  ", "ru", "s", 2)], accumulate.DOCUMENTS)
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    ready = []
    for _ in range(2):
        q = accumulate.accumulate(accumulate.arriving(spark, str(tmp_path / "in")), str(tmp_path / "corpus"), str(tmp_path / "checkpoint"), on_ready=lambda c: ready.append(c.count()))
        q.awaitTermination()
    s = store.corpus_stats(spark.read.parquet(str(tmp_path / "corpus"))).first()
    assert (s.n_texts, s.n_words, s.ready) == (4, 480, False) and not ready


def test_neighbours(spark):
    v = spark.createDataFrame([("aaa", [1.0, 0.0]), ("bbb", [0.9, 0.1]), ("ccc", [0.0, 1.0]), ("ddd", [0.0, 0.0])], "word string, vec array<double>")
    got = V.nearest(v.where("word = 'aaa'"), v, 2, block=2).orderBy("no").collect()
    assert [r.neighbour for r in got] == ["bbb", "ccc"] and got[0].similarity == pytest.approx(0.9 / (0.82**0.5))


def test_neighbours_tie_by_name(spark):
    """Of many equal vectors the first by name are kept, however rows fall into blocks."""
    rows = [(f"n{i * 37 % 211:03d}", [1.0, 0.5]) for i in range(211)] + [("best", [1.0, 0.0]), ("far", [-1.0, 0.1]), ("zero", [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "word string, vec array<double>")
    query = spark.createDataFrame([("q", [1.0, 0.0]), ("n000", [1.0, 0.5])], "word string, vec array<double>")
    for block in (20, 4096):
        got = sorted((r.query, r.no, r.neighbour) for r in V.nearest(query, frame, 4, block=block).collect())
        assert got == [("n000", i, f"n{i:03d}") for i in range(1, 5)] + [("q", 1, "best"), *(("q", i + 2, f"n{i:03d}") for i in range(3))]
    assert V.nearest(query, frame, 500).count() == 214 + 213
