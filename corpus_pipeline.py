"""The corpus pipeline: five of the dealt operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept; its result is written as Parquet and read again as the next
stage's ``docs``. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskflow.llm import decontaminate, language, mixing, simhash_dedup, token_output
from deskflow.llm.common import materialize, read_docs
from deskflow.llm.q_corpus import MIX, TOKENIZER
from deskflow.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: null texts and texts without a letter."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id."""
    return simhash_dedup.keep_one(docs, shingle=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of ``benchmark``."""
    return decontaminate.clean(docs, read_docs(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents sampled by their raked probabilities."""
    return mixing.sample(docs, **MIX)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns what it holds of each document."""
    path = scratch_path(spark, "token-file")
    token_output.write_tokens(docs, path, TOKENIZER)
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

# A trained network and fingerprint links have no SQL form: see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_docs(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{STAGES.index((name, stage))}")
    return STAGES[-1][1](spark, docs, sf_dir)
