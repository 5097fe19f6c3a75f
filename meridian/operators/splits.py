"""Purged chronological splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Validation windows of the walk-forward folds: half-years, strictly increasing.
FOLDS = [(1, "1998-01-01", "1998-07-01"), (2, "1998-07-01", "1999-01-01"), (3, "1999-01-01", "1999-07-01"), (4, "1999-07-01", "2000-01-01")]


def check_windows(folds=FOLDS) -> None:
    for (_, a, b), nxt in zip(folds, [*folds[1:], None]):
        if a >= b or (nxt and nxt[1] < b):
            raise ValueError("fold windows must increase")


def with_folds(rows: DataFrame, feature: str, target: str, folds=FOLDS) -> DataFrame:
    """Every row by fold with its role: train, validation or purged."""
    check_windows(folds)
    every = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for k, a, b in folds))
    x = rows.withColumn("_f", F.explode(every))
    f, t, a, b = F.col(feature), F.col(target), F.col("_f.a"), F.col("_f.b")
    role = F.when((f < a) & (t < a), "train").when((f >= a) & (f < b) & (t < b), "validation").otherwise("purged")
    return x.withColumns({"fold": F.col("_f.fold"), "role": role}).drop("_f")


def purged_split(rows: DataFrame, validation: str, test: str, feature: str, target: str) -> DataFrame:
    """train, validation, test or purged, so that no label crosses a border."""
    f, t, v, e = F.col(feature), F.col(target), F.lit(validation).cast("date"), F.lit(test).cast("date")
    role = F.when((f < v) & (t < v), "train").when((f >= v) & (f < e) & (t < e), "validation").when(f >= e, "test").otherwise("purged")
    return rows.withColumn("role", role)


def fold_of(rows: DataFrame, date: str, folds=FOLDS) -> DataFrame:
    """The fold whose window holds a date; null outside."""
    d, fold = F.col(date), F.lit(None).cast("int")
    for k, a, b in folds:
        fold = F.when((d >= F.lit(a).cast("date")) & (d < F.lit(b).cast("date")), k).otherwise(fold)
    return rows.withColumn("fold", fold)
