"""From raw documents to token files: five stages, each one operator over all that the stage before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs. All but
the last return the columns of documents. Texts go to Python in small batches (``common.in_small_batches``), so that what
executors hold beside their heaps stays small in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelake.llm import common, decontaminate, mixing, simhash, token_output, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict as toxic; it is trained on labelled rows of docs outside the held-out
    fold."""
    docs = common.in_small_batches(docs)
    return toxicity.clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the lowest id) of each group of about 0.8 similarity or more on five-word shingles."""
    return simhash.deduplicate(common.in_small_batches(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return decontaminate.clean(common.in_small_batches(docs), common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix draws their words: a document drawn 1.4 times stands once, and with a seeded chance
    of 0.4 twice."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_documents(common.in_small_batches(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None
