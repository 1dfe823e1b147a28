"""A corpus pipeline from five operators: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of `documents`.

Defined cases: null texts are scored as empty, never near duplicates of anything, hold no personal
data and no words, so the mix leaves them out; rows that share an id, or have none, are documents of their
own in every stage, and of rows with one id and text one stays after the near-duplicate stage; rows that the
mix takes more than once are repeated; an empty table passes through empty; columns besides those of
`documents` are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import bpe, jaccard, mixing, pii, quality
from umbra.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores at KEEP_SCORE or more."""
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine, keep=[F.col(c) for c in COLUMNS[1:]])
    return scored.where(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by n-gram similarity."""
    return jaccard.first_of_groups(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans replaced by their kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, repeated as often as it takes them."""
    size = mixing.words(F.col("text"))
    taken = mixing.mix(docs, F.col("source"), size, F.md5("text"), keep=COLUMNS[1:]).where("taken > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, exact) of every document of the mix."""
    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("source",))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]
#: A trained classifier, a similarity join, a flow and a tokenizer: SQL can't express them; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
