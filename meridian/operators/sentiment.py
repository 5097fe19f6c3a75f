"""Token-weighted sentiment of scored text items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.text import TOPICS, speaker_group, topic_flags, topic_matches

SECTIONS = ("item_7_mda", "item_1a_risk_factors")


def scored_items(turns: DataFrame, turn_scores: DataFrame, chunks: DataFrame, chunk_scores: DataFrame) -> DataFrame:
    """Transcript turns and filing chunks with the scores of one model version; operators and blanks are left out."""
    group = F.when(F.lower("speaker_role").contains("analyst"), "analyst").otherwise("management")
    said = turns.where((F.trim("content") != "") & ~F.lower("speaker_role").contains("operator"))
    calls = said.join(turn_scores, "turn_id", "left").select(
        F.concat(F.lit("earnings_call:"), "transcript_id").alias("event_key"), F.lit("earnings_call").alias("event_source"), group.alias("speaker_group"), "content", "status", "sentiment_score", "confidence", "token_count"
    )
    filed = chunks.where(F.col("section_key").isin(*SECTIONS)).join(chunk_scores, "chunk_id", "left").select(
        F.concat(F.lit("sec_filing:"), "accession_number").alias("event_key"), F.lit("sec_filing").alias("event_source"), F.lit("filing").alias("speaker_group"), "content", "status", "sentiment_score", "confidence", "token_count"
    )
    return calls.unionByName(filed)


def weighted(items: DataFrame, keys: list[str], which: Column | None = None, prefix: str = "sentiment_", confidence: bool = True) -> list[Column]:
    """Aggregates of A9 over scored rows (of a subset): mean, confidence, dispersion, items, tokens.

    Weight is the token count, at least 1. Dispersion comes from sum(w s^2) in the same pass.
    """
    ok = (F.col("status") == "SCORED") & F.col("sentiment_score").isNotNull()
    if which is not None:
        ok = ok & which
    w = F.when(ok, F.greatest(F.coalesce("token_count", F.lit(1)), F.lit(1)).cast("double"))
    s = F.col("sentiment_score")
    mean = F.try_divide(F.sum(w * s), F.sum(w))
    out = [mean.alias(f"{prefix}score")]
    if confidence:
        spread = F.try_divide(F.sum(w * s * s), F.sum(w)) - mean * mean
        out += [
            F.try_divide(F.sum(w * F.col("confidence")), F.sum(w)).alias(f"{prefix}confidence"),
            F.sqrt(F.greatest(F.lit(0.0), spread)).alias(f"{prefix}dispersion"),
            F.count_if(ok).alias(f"{prefix}scored_items"),
            F.coalesce(F.sum(w), F.lit(0.0)).cast("long").alias(f"{prefix}token_count"),
        ]
    return out


def event_sentiment(items: DataFrame) -> DataFrame:
    """One row of sentiment features per event."""
    group = F.col("speaker_group")
    agg = items.groupBy("event_key").agg(
        *weighted(items, []),
        F.count(F.lit(1)).alias("_all"),
        *weighted(items, [], group == "management", "management_", False),
        *weighted(items, [], group == "analyst", "analyst_", False),
    )
    return agg.select(
        "event_key", "sentiment_score", "sentiment_confidence", "sentiment_dispersion",
        (F.col("sentiment_scored_items") / F.col("_all")).alias("sentiment_coverage"),
        "sentiment_scored_items", "sentiment_token_count",
        F.col("management_score").alias("management_sentiment_score"), F.col("analyst_score").alias("analyst_sentiment_score"),
        (F.col("management_score") - F.col("analyst_score")).alias("management_analyst_gap"),
    )


def topic_features(items: DataFrame) -> DataFrame:
    """Per event and topic the weighted score and the share of the scored population (null score and share 0 if absent)."""
    pop = items.where("status = 'SCORED' AND (event_source = 'sec_filing' OR speaker_group = 'management')")
    w = F.greatest(F.coalesce("token_count", F.lit(1)), F.lit(1)).cast("double")
    flags = pop.select("event_key", w.alias("w"), (w * F.col("sentiment_score")).alias("ws"), topic_flags(F.col("content")).alias("has"))
    pick = lambda k, c: F.sum(F.when(F.col(f"has.{k}"), F.col(c)))
    scores = [F.try_divide(pick(k, "ws"), pick(k, "w")).alias(f"topic_{k}_sentiment") for k in TOPICS]
    shares = [(F.count_if(F.col(f"has.{k}")) / F.count(F.lit(1))).alias(f"topic_{k}_share") for k in TOPICS]
    found = flags.groupBy("event_key").agg(*scores, *shares)
    out = items.select("event_key").distinct().join(found, "event_key", "left")
    return out.na.fill(0.0, [f"topic_{k}_share" for k in TOPICS])


def service_rows(turns: DataFrame, scores: DataFrame) -> DataFrame:
    """Turns with group, eligibility and class probabilities that follow from score and confidence."""
    x = turns.join(scores, "turn_id", "left").withColumn("speaker_group", speaker_group(F.col("speaker_role")))
    return x.withColumns(probabilities())


def probabilities() -> dict[str, Column]:
    """Three class probabilities of a scored row: the sign's class has the confidence, the others share the rest."""
    s, c = F.col("sentiment_score"), F.col("confidence")
    rest = (1 - c) / 2
    return {
        "p_positive": F.when(s > 0, c).otherwise(F.when(s.isNotNull(), rest)),
        "p_negative": F.when(s < 0, c).otherwise(F.when(s.isNotNull(), rest)),
        "p_neutral": F.when(s == 0, c).otherwise(F.when(s.isNotNull(), rest)),
    }


def summary(which: Column | None = None) -> list[Column]:
    """Aggregates of A12 and A13: token-weighted probabilities, score, confidence, counts and coverage."""
    ok = F.col("status") == "SCORED"
    eligible = F.col("status").isNull() | (F.col("status") != "SKIPPED")
    if which is not None:
        ok, eligible = ok & which, eligible & which
    w = F.when(ok, F.greatest(F.coalesce("token_count", F.lit(1)), F.lit(1)).cast("double"))
    mean = lambda c: F.floor(F.try_divide(F.sum(w * F.col(c)), F.sum(w)) * 1e6 + 0.5) / 1e6
    return [
        mean("p_positive").alias("positive"), mean("p_negative").alias("negative"), mean("p_neutral").alias("neutral"),
        mean("confidence").alias("confidence"), F.count_if(ok).alias("scored"), F.count_if(eligible).alias("eligible"),
    ]


def labelled(df: DataFrame) -> DataFrame:
    """Adds score, label (positive, negative, neutral on ties in this order) and coverage to a summary."""
    p, n, u = F.col("positive"), F.col("negative"), F.col("neutral")
    label = F.when(p.isNull(), None).when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral")
    return df.withColumns({"score": F.floor((p - n) * 1e6 + 0.5) / 1e6, "label": label, "coverage": F.floor(F.try_divide("scored", "eligible") * 1e6 + 0.5) / 1e6})


def by_topic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A14 by keys and topic: summary of matching rows and the sorted distinct terms."""
    x = rows.withColumn("m", F.explode(topic_matches(F.col("content"))))
    agg = x.groupBy(*keys, F.col("m.topic").alias("topic")).agg(*summary(), F.array_sort(F.array_distinct(F.flatten(F.collect_set("m.terms")))).alias("terms"))
    return labelled(agg).withColumn("terms", F.array_join("terms", ","))
