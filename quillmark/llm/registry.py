"""Registered queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage that defines it.
MODULES = {
    "op1_bpe": "bpe",
    "op2_token_store": "store",
    "op3_url_filter": "urls",
    "op4_simhash": "simhash",
    "op5_packing": "packing",
    "op6_suffix_dedup": "suffix",
    "op7_quality": "quality",
    "op8_sharding": "sharding",
    "op9_embedding_neardup": "embed",
    "op10_topk": "topk",
    "op11_decontamination": "decontaminate",
    "op12_whitening": "whiten",
    "op13_clusters": "centroids",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
        found |= {k: v for k, v in sql.items() if k == name}
    return found
