"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_merkle_fixity": "fixity",
    "op2_license_scans": "licenses",
    "op3_image_copies": "images",
    "op4_packing": "packing",
    "op5_quality": "quality",
    "op6_toxicity": "toxicity",
    "op7_simhash_near_dedup": "simhash",
    "op8_mixing": "mixing",
    "op9_embedding_near_dedup": "vectors",
    "op10_secret_scans": "secrets",
    "op11_hard_negatives": "negatives",
    "op12_centroid_clusters": "centroids",
    "op13_lm_scores": "language",
}
_SQL = {
    "op1_merkle_fixity": ("fixity", "OP1_SQL"),
    "op10_secret_scans": ("secrets", "OP10_SQL"),
    "op11_hard_negatives": ("negatives", "OP11_SQL"),
    "op12_centroid_clusters": ("centroids", "OP12_SQL"),
}


def _load(module: str):
    return importlib.import_module(f"lexiforge.llm.{module}")


def queries() -> dict:
    return {name: getattr(_load(module), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_load(module), constant) for name, (module, constant) in _SQL.items()}
