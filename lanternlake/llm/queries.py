"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, mixing, negatives, quality, secrets, simhash, spelling, substrings, tokens, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    return quality.op1(table(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets.op2(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.op3(table(spark, sf_dir, "pages"))


def op4_tokens(spark, sf_dir):
    return tokens.op4(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_urls(spark, sf_dir):
    return urls.op6(table(spark, sf_dir, "pages"))


def op7_extraction(spark, sf_dir):
    return extract.op7(table(spark, sf_dir, "pages"))


def op8_simhash(spark, sf_dir):
    return simhash.op8(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.op9(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_negatives(spark, sf_dir):
    return negatives.op11(table(spark, sf_dir, "embeddings"))


def op12_substrings(spark, sf_dir):
    return substrings.op12(table(spark, sf_dir, "documents"))


def op13_spelling(spark, sf_dir):
    return spelling.op13(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_tokens": op4_tokens,
    "op5_decontamination": op5_decontamination,
    "op6_urls": op6_urls,
    "op7_extraction": op7_extraction,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_substrings": op12_substrings,
    "op13_spelling": op13_spelling,
}
ORACLES = {
    "op1_quality": quality.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op6_urls": urls.OP6_SQL,
    "op11_negatives": negatives.OP11_SQL,
}
