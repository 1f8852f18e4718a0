"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, langid, linededup, mixing, neardup
from gaugeworks.llm.common import load, materialise, scratch_path
from gaugeworks.storage import scratch

#: Share of all words that mixing takes, at most once each, and the weights of its tree.
MIX_SHARE, MIX_SEED = 0.8, 11
MIX_WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1, (None, "en"): 4, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 2}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of their own corpus reject go: no letters, or letters in no language's order."""
    model = langid.learn(docs)
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    judged = langid.identify(rows, model, inner, inner[docs.columns.index("text")])
    return judged.filter("not rejected").select(*inner).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has as well go; documents stay, with what is left of their text."""
    return linededup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    return neardup.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken once at most, to the weights of the domain-language-source tree; those without words go."""
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    rows = docs.toDF(*inner).withColumn("_domain", mixing.domain_of(F.col(at["source"]))).withColumn("_words", mixing.word_count(F.col(at["text"])))
    rows = rows.withColumn("_lang", F.col(at["lang"])).withColumn("_source", F.col(at["source"])).withColumn("_doc", F.col(at["doc_id"]))
    taken = mixing.select(rows, ["_domain", "_lang", "_source"], id_col="_doc", token_col="_words", weights=MIX_WEIGHTS, total_share=MIX_SHARE, seed=MIX_SEED, keep=inner)
    return taken.select(*inner).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and digests of ids and decoded text."""
    return bpe.encode_decode(docs, ["doc_id"], "text", public_tokenizers.path("byte_bpe_50k.json"), outputs=True).drop("decoded")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL can't express these stages; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage writes on its way goes once its result is written
            docs = materialise(stage(spark, docs, sf_dir), name, path=path)
    return docs
