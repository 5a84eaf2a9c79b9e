"""All queries of the core, by name, and their SQL counterparts."""

from __future__ import annotations

from weftline.plans import general, pages, stores, vectors

_MODULES = [general, vectors, pages, stores]


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return queries()["cosine_topk"](spark, sf_dir)
