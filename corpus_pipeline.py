"""A training corpus from `documents`: language ID, near-duplicate removal, repeated-passage removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. Defined results follow from the operators' own; rows that are equal in all columns count once in stage 2.
Rows travel packed as one column, so extra columns pass whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import bpe, jaccard, language, mixing, substring
from strandwise.llm._common import Folder, checkpoint


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"), 3, 1)))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return language.predict(packed, model, ["row"]).where("lang_pred <> 'und'").select("row.*")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like 5-word shingle sets stays, that of the smallest id."""
    return jaccard.distinct_documents(docs)


def drop_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier elsewhere go; a text that loses words is its other words joined by blanks."""
    packed = docs.select(F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row"), "doc_id", "text")
    kept = substring.deduplicate(packed, 20, ("row",))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice comes twice."""
    return mixing.mixed_documents(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: a fitted classifier, near-duplicate groups and BPE aren't expressed in SQL; tests/llm has a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    folder = Folder.new(spark, "pipeline")
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder.uri}/{k}")
            docs = spark.read.parquet(f"{folder.uri}/{k}")
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        folder.drop()
