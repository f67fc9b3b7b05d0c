"""The dealt operators' queries: name -> fn(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import q_corpus


def queries():
    return dict(q_corpus.QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    sql = dict(q_corpus.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
