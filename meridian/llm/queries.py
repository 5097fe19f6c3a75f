"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import sql
from meridian.llm.centroid_clusters import centroid_clusters
from meridian.llm.common import table
from meridian.llm.decontamination import contaminated
from meridian.llm.filter_audit import filter_audit
from meridian.llm.html_text import main_text
from meridian.llm.jaccard_join import near_duplicates
from meridian.llm.lm_scoring import lm_scores
from meridian.llm.packing import pack
from meridian.llm.quality_rules import quality_rules
from meridian.llm.sharding import shard_uniform
from meridian.llm.substring_dedup import remove_repeats
from meridian.llm.token_counts import token_counts
from meridian.llm.toxicity import score_toxicity
from meridian.llm.url_filters import judge_urls

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls whose path number is a labelled document; bad: of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("url", F.expr("try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) AS BIGINT)").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(labels, "doc_id")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir), URL_RULES)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scores = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return pack(table(spark, sf_dir, "documents"), tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_uniform(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scores = lm_scores(table(spark, sf_dir, "documents"), ~held, tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_quality_rules": op2_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op4_html_text": op4_html_text,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_token_counts": op8_token_counts,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clusters": sql.clustering(), "op13_filter_audit": sql.FILTER_AUDIT}
