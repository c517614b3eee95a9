"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import math

import duckdb
import pytest

from lexiforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["agg_diversity", "agg_sentences", "agg_inet_profile", "agg_pos_bigrams", "agg_idx20", "win_pattern", "agg_freq_profile", "agg_senti", "agg_tfidf_cosine", "lex_build", "cmp_pipeline", "snk_upsert_ann", "snk_upsert_dict", "agg_skill_level", "topk_neighbors", "src_text", "src_local_enc", "src_paste", "sort_hits", "set_error_union", "join_overlap_dedup", "orc_lt_http_check", "src_ext_speller", "lex_user_inject_strat", "snk_cache"]


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = catalog.queries()[name](spark, sf).toArrow(), con.execute(catalog.oracle_sql()[name]).to_arrow_table()
    cols = sorted(a.column_names)
    assert cols == sorted(b.column_names)
    rows = lambda t: sorted(map(repr, zip(*[[plain(x) for x in t[c].to_pylist()] for c in cols])))
    assert rows(a) == rows(b)


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_works_without_the_llm_folders(tmp_path):
    """A copy without them must import, keep the other queries, and fail loudly on other import errors."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lexiforge", tmp_path / "lexiforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, has_ops = said.stdout.split()
    assert int(n) > 100 and has_ops == "False"


def test_models_are_registered_with_the_reference_parameters(spark, sf):
    rows = catalog.queries()["ml_lda_topics"](spark, sf).limit(5).collect()
    assert rows and all(len(r.topics) == 10 for r in rows)
    assert catalog.queries()["ml_lda_update"](spark, sf).select("topic").distinct().count() == 10
    vectors = catalog.queries()["ml_embed_train"](spark, sf)
    assert len(vectors.first().vec) == 100


def test_annotator_sees_whole_texts(spark, sf):
    """The contexts that train and are judged are whole texts; a prediction follows from a text's end as well."""
    from lexiforge.plans import vector_plans

    rows = vector_plans.annotations(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows.collect()
    assert got and all(r.context == texts[r.doc_id] for r in got) and any(len(r.context or "") > 120 for r in got)
    assert catalog.queries()["ml_annotator_train"](spark, sf).count() == len(got)
