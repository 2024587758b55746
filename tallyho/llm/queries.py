"""The registered queries of the llm operators: key -> fn(spark, sf_dir), and
the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyho.llm import collocations, metric_tree, reputation, resample
from tallyho.llm.bpe import bpe_digests
from tallyho.llm.common import load
from tallyho.llm.jaccard_join import jaccard_query
from tallyho.llm.multiprobe import ann_query
from tallyho.llm.pii_boost import pii_query
from tallyho.llm.quality_gbt import quality_query
from tallyho.llm.secret_links import secrets_query
from tallyho.llm.temperature_mix import mix_query
from tallyho.llm.toxicity import toxicity_query
from tallyho.llm.weak_rules import weak_rules_query


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(load(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_query(load(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_query(load(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules_query(load(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(load(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_query(load(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_query(load(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_query(load(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(load(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.exact_query(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality, op3_bpe, op4_mixing, op5_ann, op6_quality_rules,
                            op7_url_filters, op8_jaccard_join, op9_pii, op10_secret_scan, op11_resample, op12_phrases, op13_exact_topk)}
ORACLES: dict[str, str] = {"op7_url_filters": reputation.ORACLE, "op11_resample": resample.ORACLE,
                           "op12_phrases": collocations.ORACLE, "op13_exact_topk": metric_tree.ORACLE}
