"""One query per operator of this subpackage, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.llm import decontaminate as dec
from doseframe.llm import bpe, collocations, langid, line_dedup, mixing, ngram_join, order_minhash, phrases, secrets, toxicity, warc, whitening
from doseframe.llm.common import bucket5, fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def vocabulary() -> str:
    """The vocabulary file for op4 and the pipeline; every worker has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dec.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        dec.n_hit().alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        dec.contaminated(dec.n_hit(), F.col("n_words")).alias("contaminated"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    labels = table(spark, sf_dir, "labels").where(bucket5(F.col("doc_id")) != 0)
    return toxicity.fit_toxicity(docs, labels)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return found.select(
        "doc_id", (bucket5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def listed(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return secrets.find_secrets(docs).select(
        "doc_id", *[count(k) for k in secrets.KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language_model(docs.where(bucket5(F.col("doc_id")) != 0))
    found = langid.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket5(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


@query
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_next(table(spark, sf_dir, "documents"))


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on all documents. The module lies at the repository's top and imports from here."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
