"""The queries opN of this subpackage over the synthetic tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.llm import decontamination, jaccard, lexical, lines, mixing, neighbours, oracle, packing, periodic, scoring, substrings, toxicity, urls, vectordups


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as tokenizers

    return {"json_path": tokenizers.path("byte_bpe_50k.json"), "ranks_path": tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": tokenizers.PATTERN}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Texts are long: fewer rows in a batch keep the memory of Python workers, and of what feeds them, small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), with_text=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"), short=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), **tokenizer_files())


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_vectordups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordups.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("longest")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapse_runs(periodic.with_planted(read(spark, sf_dir, "documents"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_mixing": op2_mixing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_lines": op5_lines,
    "op6_packing": op6_packing,
    "op7_neighbours": op7_neighbours,
    "op8_vectordups": op8_vectordups,
    "op9_urls": op9_urls,
    "op10_ppm": op10_ppm,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {"op11_decontamination": oracle.CONTAMINATION, "op12_periodic_runs": oracle.RUNS, "op13_lexical_search": oracle.SEARCH}
