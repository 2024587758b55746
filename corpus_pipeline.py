"""The training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared checkpoint folder and read again as the next
stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho.llm.bpe import encode_texts
from tallyho.llm.common import load
from tallyho.llm.jaccard_join import keep_one_of_each
from tallyho.llm.queries import tokenizer_path
from tallyho.llm.secret_links import redact_secrets
from tallyho.llm.temperature_mix import mix_documents
from tallyho.llm.weak_rules import keep_quality
from tallyho.session import checkpoint_dir

#: No source is repeated more often than this by the mixing stage.
MAX_REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-supervision rules reject."""
    return keep_quality(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every reported secret in the texts; keeps all documents."""
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources to the target weights; every document
    stands at least once, in the order of the blocks' permutations."""
    return mix_documents(docs, max_repeats=MAX_REPEATS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids``: the token ids of every text."""
    return (encode_texts(docs.select("doc_id", "source", "text"), tokenizer_path())
            .select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join), ("secret scan", secret_scan),
          ("mixing sources", mix_sources), ("BPE encoding", bpe_encode)]

#: SQL cannot express the label model, the components or the automaton; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
