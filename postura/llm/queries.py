"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postura.llm import (collocations, decontaminate, embeddings, files, line_dedup, packing, pages, periodic_runs, pii, quality,
                         secret_scan, simhash, token_files, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_simhash")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query("op2_pii")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(read(spark, sf, "documents"))


@query("op3_token_files")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write(read(spark, sf, "documents"), token_files.new_folder(spark),
                                 public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digest(manifest)


@query("op4_line_dedup", line_dedup.SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(read(spark, sf, "documents"), counted=True)
    return cut.select("doc_id", "text", "n_lines", "n_dropped")


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score(quality.fit_corpus(read(spark, sf, "documents"), read(spark, sf, "labels")))


@query("op7_decontamination")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op10_pages")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(read(spark, sf, "pages"))


@query("op9_embeddings")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.link(read(spark, sf, "embeddings"))


@query("op6_secrets")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.report(read(spark, sf, "documents"))


@query("op11_warc")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return warc.digest(warc.write(read(spark, sf, "pages"), files.new_folder(spark)))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_planted(read(spark, sf, "documents"))))


@query("op13_collocations")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.top(collocations.collocations(read(spark, sf, "documents")))
