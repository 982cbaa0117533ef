"""The corpus pipeline: from raw documents to a mixed, deduplicated, tokenised corpus."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from solarweave.llm import bpe, mixing, neardup, secretscan, toxicity
from solarweave.storage import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of confirmed and unlabelled texts does not find toxic, with all columns.

    Null and empty texts stay, and so do all where no label confirms any; repeated rows are
    judged alike; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with all columns.

    Documents without words stay, one for each id; rows without id all stay; of rows equal in id
    and text one stays.
    """
    return neardup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced and n_chars set anew where a text changed.

    Null texts stay null; repeated rows are redacted alike; an empty table stays empty.
    """
    return secretscan.redacted(docs, secretscan.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says, with all columns.

    Null sources are one source; null and empty texts have no words and follow their source's
    rate; repeated rows get the same copies; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and copy, and the digest of the text that they decode to.

    Null and empty texts have no tokens; a row comes out for each row, also without id.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained classifier decides in the first stage, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
