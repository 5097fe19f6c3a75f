"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of `documents`. The result is a row per piece of the packed sequences.

Any column may be null. Null and empty texts fail the quality rules and so leave in the first stage;
handed to a later stage they stay, as empty texts. Texts are read whole at any length. Columns other
than those of `documents` are dropped, an empty table stays empty. What each stage does with ties,
repeated rows and null ids is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import materialize, near, table
from meridian.llm.decontamination import contaminated
from meridian.llm.jaccard_join import near_duplicates
from meridian.llm.packing import pack
from meridian.llm.quality_rules import quality_rules
from meridian.llm.queries import trusted_ids
from meridian.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of `docs` whose key is not in `gone`; rows without a key stay."""
    gone = materialize(gone.select(key).dropna().distinct(), "gone")
    return docs.join(near(gone), key, "left_anti")


def keyed(docs: DataFrame) -> DataFrame:
    """With `_row`, which tells rows apart by id and text; either may be null."""
    return docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows are told apart by id and text."""
    trusted = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row")).join(trusted_ids(spark, sf_dir), "doc_id", "left_semi")
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    verdicts = quality_rules(docs, trusted, id_col="_row")
    return without(docs, verdicts.where("NOT kept"), "_row").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (nulls last) of each group of near duplicates.

    Rows of one id with different texts are different documents; equal rows are one.
    """
    docs = keyed(docs)
    groups = materialize(near_duplicates(docs, id_col="_row"), "groups")
    several = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    if several.isEmpty():
        return docs.select(*COLUMNS)
    several = near(materialize(several, "components"))
    members = groups.join(several, "component_id").select("_row", "component_id").distinct()
    members = materialize(members.join(docs.select("_row", "doc_id").distinct(), "_row"), "members")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("best"))
    best = near(materialize(best, "best"))
    gone = members.join(best, "component_id").where("_row <> best._row")
    kept = without(docs, gone, "_row")
    again = groups.groupBy("_row").count().where("count > 1")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    return kept.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids have.

    Rows of one id are one document to others; a null id counts as smaller than all. Every row stays,
    with an empty text where all of it repeats.
    """
    cut = remove_repeats(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by id and text, equal rows leave or stay together."""
    docs = keyed(docs)
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(docs, found, "_row").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; repeated rows are packed as often as they come, a null or empty text as its end id."""
    import public_tokenizers as tok

    return pack(docs, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Similarity components, models and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
