"""From raw documents to token ids, in five stages, each written and read again.

1. toxicity: documents that score a half or more as toxic go.
2. line dedup: repeated chunks of lines go from the texts, but for their first occurrence.
3. n-gram Jaccard join: of documents whose sets of five-word shingles share 80 percent or more, the one with the smallest id stays.
4. benchmark decontamination: documents with a twentieth of their words in test windows go.
5. BPE: texts become ids; the decoded text goes with them.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from doseframe.llm.common import fresh_path
from doseframe.llm.queries import table, toxicity_model, vocabulary


#: What near duplicates share: the contract of the query ``op9_`` has another rule.
SHINGLE_WORDS = 5
LIKENESS_PERCENT = 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, toxicity_model(spark, docs, sf_dir))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, shingle=SHINGLE_WORDS, threshold=LIKENESS_PERCENT)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, vocabulary())
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", remove_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Nearest examples, text vectors and BPE have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
