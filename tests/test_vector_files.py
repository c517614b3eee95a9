"""Binary word vectors: any number of splits gives the same rows."""

import numpy as np
import pytest

from lexiforge.sources import vector_files as V


def written(path, words, x, newline=True):
    rows = V.row_bytes(words, x)
    if not newline:
        rows = b"".join(w.encode() + b" " + v.astype("<f4").tobytes() for w, v in zip(words, x))
    path.write_bytes(f"{len(words)} {x.shape[1]}\n".encode() + rows)
    return str(path)


@pytest.mark.parametrize("newline", [True, False])
def test_any_split_gives_the_rows(spark, tmp_path, newline):
    rng = np.random.default_rng(1)
    words = [f"слово{i}_NOUN" if i % 3 else "w" * (1 + i % 40) for i in range(400)]
    x = rng.normal(size=(400, 7)).astype(np.float32)
    x[::5] = np.frombuffer(b"a b\n" * 7, "<f4")  # numbers whose bytes look like names and blanks
    path = written(tmp_path / "v.bin", words, x, newline)
    want = sorted((w, v.tolist()) for w, v in zip(words, x))
    for split in (64, 333, 5000, 1 << 20):
        reader = V._Reader(path, split)
        assert sorted(r for p in reader.partitions() for r in reader.read(p)) == want
    got = V.read_vectors(spark, path, 1000)
    assert got.rdd.getNumPartitions() > 5 and sorted((r.word, r.vec) for r in got.collect()) == want


def test_text_empty_and_broken_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("2 3\nслово 1 2.5 -3\nx 0 0 1e-3\n", encoding="utf-8")
    assert sorted((r.word, [round(v, 4) for v in r.vec]) for r in V.read_vectors(spark, str(tmp_path / "t.txt")).collect()) == [("x", [0, 0, 0.001]), ("слово", [1, 2.5, -3])]
    assert V.read_vectors(spark, written(tmp_path / "e.bin", [], np.zeros((0, 4)))).count() == 0
    path = tmp_path / "b.bin"
    written(path, ["a", "b", "c"], np.ones((3, 4)), True)
    path.write_bytes(path.read_bytes()[:-6])
    with pytest.raises(Exception, match="no row at byte"):
        V.read_vectors(spark, str(path)).collect()
