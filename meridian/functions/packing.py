"""Order-dependent folds over bounded groups, as SQL aggregates over sorted arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_turns(turns: DataFrame, limit: int = 700) -> DataFrame:
    """Whole turns appended to a chunk while it holds at most `limit` words; a longer turn is cut into plain pieces.

    Rows (transcript_id, chunk_index, tokens, speakers, content). A transcript is one bounded group;
    its turns are folded in order, and tokens are counted again on the joined text.
    """
    said = F.concat("speaker_role", F.lit(": "), "content")
    ordered = turns.select("transcript_id", "turn_index", "speaker_role", said.alias("text"), F.size(F.filter(F.split(said, r"\s+"), lambda w: w != "")).alias("n"))
    grouped = ordered.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "speaker_role", "text", "n"))).alias("turns"))
    chunk = "named_struct('texts', CAST(array() AS array<string>), 'who', CAST(array() AS array<string>), 'n', 0)"
    pieces = f"transform(sequence(0, CAST(floor((t.n - 1) / {limit}) AS INT)), k -> named_struct('texts', array(array_join(slice(filter(split(t.text, '\\\\s+'), w -> w <> ''), k * {limit} + 1, {limit}), ' ')), 'who', array(t.speaker_role), 'n', least({limit}, t.n - k * {limit})))"
    flushed = "IF(a.open.n > 0, concat(a.done, array(a.open)), a.done)"
    fold = f"""aggregate(turns, named_struct('done', CAST(array() AS array<struct<texts:array<string>,who:array<string>,n:int>>), 'open', {chunk}),
      (a, t) -> CASE WHEN t.n > {limit} THEN named_struct('done', concat({flushed}, {pieces}), 'open', {chunk})
        WHEN a.open.n > 0 AND a.open.n + t.n > {limit} THEN named_struct('done', {flushed}, 'open', named_struct('texts', array(t.text), 'who', array(t.speaker_role), 'n', t.n))
        ELSE named_struct('done', a.done, 'open', named_struct('texts', concat(a.open.texts, array(t.text)), 'who', concat(a.open.who, array(t.speaker_role)), 'n', a.open.n + t.n)) END,
      a -> {flushed})"""
    out = grouped.selectExpr("transcript_id", f"posexplode({fold}) AS (chunk_index, c)")
    content = F.array_join("c.texts", "\n\n")
    return out.select("transcript_id", "chunk_index", F.size(F.filter(F.split(content, r"\s+"), lambda w: w != "")).alias("tokens"), F.array_join(F.array_sort(F.array_distinct("c.who")), ",").alias("speakers"), content.alias("content"))


def bounded_batches(rows: DataFrame, group: str, most_items: int, most_tokens: int) -> DataFrame:
    """Batch number of each row in id order within its group: at most so many items and tokens.

    Rows (group, chunk_id, tokens, batch). Groups are key ranges of bounded size, so no task holds all rows.
    """
    grouped = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "tokens"))).alias("items"))

    def add(a, x):
        full = (a["n"] > 0) & ((a["n"] >= most_items) | (a["t"] + x["tokens"] > most_tokens))
        starts = F.when(full, F.concat(a["starts"], F.array(a["k"]))).otherwise(a["starts"])
        return F.struct(starts.alias("starts"), (a["k"] + 1).alias("k"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, x["tokens"].cast("long")).otherwise(a["t"] + x["tokens"]).alias("t"))

    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"))
    folded = grouped.select(group, "items", F.aggregate("items", none, add, lambda a: a["starts"]).alias("starts"))  # only the batches' first places are kept
    placed = folded.select(group, "starts", F.posexplode("items").alias("k", "x"))
    return placed.select(group, "x.chunk_id", "x.tokens", F.size(F.filter("starts", lambda s: s <= F.col("k"))).alias("batch"))
