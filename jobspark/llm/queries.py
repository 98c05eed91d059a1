"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    common, conversation_repair, decontamination, embedding_dedup, html_wrappers, language_cnn,
    merkle, packing, pseudonyms, quality_mil, secret_scan, simhash_dedup,
    suffix_dedup, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the folds of the classifiers."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


@query
def op1_decontamination(spark, sf_dir):
    return decontamination.matches(common.table(spark, sf_dir, "documents", "doc_id", "text"),
                                   common.table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE["op1_decontamination"] = decontamination.ORACLE_SQL


@query
def op2_html_wrappers(spark, sf_dir):
    return html_wrappers.extract(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op3_quality_mil(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality_mil.train(docs, labels.filter(remainder("doc_id", 5) != 0))
    return quality_mil.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op4_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_language_cnn(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_cnn.train(docs.filter(remainder("doc_id", 4) != 2))
    return language_cnn.identify(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


# Pseudonyms can be linked only by who holds the key; a run of one's own takes a secret one.
KEY = "example key of the registered query"


@query
def op6_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(common.table(spark, sf_dir, "documents", "doc_id", "text"), KEY)


@query
def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan(common.table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")


@query
def op8_warc(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archive(pages, common.shared_dir(spark, "warc"))


@query
def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(
        common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query
def op10_packing(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


@query
def op11_merkle(spark, sf_dir):
    return merkle.audit(common.table(spark, sf_dir, "documents", *merkle.FIELDS))


ORACLE["op11_merkle"] = merkle.ORACLE_SQL


@query
def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(common.table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.report(
        common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLE["op13_conversation_repair"] = conversation_repair.ORACLE_SQL
