"""The queries of this subpackage over the driver's tables, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packrow.llm import crf, hdlang, iblt, linededup, mixing, pieces, quality, simhash, substrings, tokenstore
from packrow.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compared(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdlang.identified(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_fingerprints, op3_pieces, op4_quality, op5_rules, op6_lines, op7_language, op8_tokens, op9_substrings, op10_mixing)}
ORACLE_SQL = {"op6_lines": linededup.ORACLE, "op9_substrings": substrings.ORACLE, "op10_mixing": mixing.ORACLE}
