"""Corpus pipeline over ``documents``: quality, repeated lines, near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's docs. All stages but the last return the columns
of ``documents``. Null and empty texts, repeated rows and ties are treated as the operators say; a document without text
passes the quality score like any other, and goes with the lines or near copies if it has nothing to keep. Decisions on near
copies and benchmark passages are taken for each pair of id and text, null or repeated ids included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotables.llm.bpe import encode_bpe, n_tokens
from geotables.llm.common import held_out, table, written
from geotables.llm.decontaminate import contamination
from geotables.llm.line_dedup import dedup_lines
from geotables.llm.quality import fit_quality, score_documents, with_statistics
from geotables.llm.queries import CONTAMINATED, LINE_CHARS, LINE_EDITS, SIMHASH_BITS, SIMHASH_WORDS, tokenizer_path
from geotables.llm.simhash import simhash_components

QUALITY = 0.7
#: Key of a row: equal for rows with equal id and text only, which get the same decisions.
ROW = "xxhash64(doc_id, doc_id is null, text, text is null)"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by the classifier, learned from the labelled ones that aren't held out."""
    columns = docs.columns
    labelled = table(spark, sf_dir, "labels")
    model = fit_quality(with_statistics(docs.select("doc_id", "text")), labelled, where=f"not {held_out()}")
    return score_documents(docs, model, out="__score").where(F.col("__score") >= QUALITY).select(*columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur, equal or nearly so, earlier; those left without any word by that go."""
    out = dedup_lines(docs, LINE_EDITS, LINE_CHARS).where(r"n_removed = 0 or rlike(text, '[^\\x20\\x09-\\x0D]')")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (null ids last, then by a hash of the row)."""
    found = simhash_components(docs.selectExpr(f"{ROW} as doc_id", "text"), SIMHASH_WORDS, SIMHASH_BITS)
    ids = docs.selectExpr(f"{ROW} as __row", "doc_id as __id").distinct()
    of = found.selectExpr("doc_id as __row", "component_id").distinct().join(ids, "__row")
    kept = of.groupBy("component_id").agg(F.min(F.expr("struct(__id is null as last, __id, __row)")).alias("x")).select("x.__row")
    whole = docs.withColumn("__row", F.expr(ROW)).join(kept, "__row", "left_semi").drop("__row")
    return whole.dropDuplicates(["doc_id", "text"])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    found = contamination(docs.selectExpr(f"{ROW} as doc_id", "text"), table(spark, sf_dir, "benchmark"), size=13)
    bad = found.where(CONTAMINATED).select(F.col("doc_id").alias("__row")).distinct()
    return docs.withColumn("__row", F.expr(ROW)).join(bad, "__row", "left_anti").drop("__row")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document kept: doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    out = encode_bpe(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), keep_text=False)
    return out.select("doc_id", "lang", "source", n_tokens().alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_copies", simhash_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
