"""The queries that apply the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import (
    decontaminate,
    exact_dedup,
    langid,
    ngram_join,
    packing,
    pii,
    substring_dedup,
    toxicity,
    url_filter,
    warc,
)

#: Fixed rules of the URL query.
URL_RULES = ("block com/en/", "allow example.com/en/7", "block net/de/", "block example.net/de/8", "block org/es/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether nothing may be learned from a row; a row without an id is held out."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(True))


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.learn_lexicon(docs.select("doc_id", "text"), labels.filter(~held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_lexicon(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.select("doc_id", "text", "lang").filter(~held_out()))
    judged = langid.predict_language(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), links=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("bigint").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.span_digest(pii.BASE), 256).alias("base_sha256"),
        pii.span_digest(tuple(pii.KINDS)).alias("spans"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    found = index.add(table(spark, sf_dir, "documents"))
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids against the index of those with even ones, opened anew."""
    docs = table(spark, sf_dir, "documents")
    first = exact_dedup.DigestIndex(spark, buckets=8)
    first.add(docs.filter("doc_id % 2 = 0"), batch="even")
    first.close()
    second = exact_dedup.DigestIndex(spark, first.location)
    found = second.add(docs.filter("doc_id % 2 <> 0"), batch="odd")
    second.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.parse_rule(line) for line in URL_RULES]
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup,
            op2_toxicity,
            op3_language,
            op4_ngram_join,
            op5_pii,
            op6_warc,
            op7_exact_dedup,
            op8_packing,
            op9_url_filter,
            op10_decontaminate,
            exact_dedup_batches,
        )
    }
