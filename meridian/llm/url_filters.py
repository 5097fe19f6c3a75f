"""URL filters: fixed allow and block rules, and association rules mined by FP-growth.

Transactions are the distinct tokens of labelled urls (host labels, registered suffix, path words,
query keys, fragment, scheme) with a token for the label `bad`. Tokens that occur in the same labelled
urls form a class: within it no set of two could tell more than one of them. Spark's FP-growth finds
frequent sets of classes; a rule `classes -> bad` stands for all rules with one token of each. It stays if
its support and confidence reach their limits and no smaller set from it is as sure. Rules match by an
inverted index: each is filed under its rarest class, the classes of every url look their rules up,
and a rule fits if the url has a token of each of its classes. A url with a fitting rule is blocked, any
other is allowed, unless a fixed rule decides: the longest one that fits host (or a parent domain) and path.

The number of sets is bounded by 2 ** m - 1 for m classes that meet in a url and reach the support; only
classes that nearly always meet, yet not always, reach it.

Null urls and urls without `://` have empty host and path and are allowed. Repeated rows are judged
each on its own; of fitting rules of equal confidence the greatest token list is named, with the greatest token that the url has of each class. Urls of any
length are read whole. An empty table gives no rows; without labels there are no mined rules. Columns
not named are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialize, near, tasks_for

BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers in the path are no tokens, a host suffix is one token."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")))
    label_tokens = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    words = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)="), F.lit(1))
    some = [F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")), F.when(F.coalesce(url, F.lit("")).startswith("http://"), F.lit("plain"))]
    every = F.concat(suffixes, label_tokens, F.transform(words, lambda w: F.concat(F.lit("path:"), w)), F.transform(query, lambda q: F.concat(F.lit("query:"), q)), F.array_compact(F.array(*some)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def token_classes(transactions: DataFrame, least: float) -> DataFrame:
    """Rows (token, cls) of the tokens in at least `least` bad transactions (row, items): tokens that occur in the same rows share a class.

    Rows are compared by their number and by two 64-bit hashes of them, put together by exclusive or. A class is
    called by its least token.
    """
    bad = F.array_contains("items", BAD)
    rows = transactions.select("row", bad.alias("bad"), F.explode(F.array_distinct("items")).alias("token")).where(F.col("token") != BAD)
    where = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"h{k}") for k in (1, 2)]
    facts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *where).where(F.col("n_bad") >= least)
    names = facts.groupBy("n", "n_bad", "h1", "h2").agg(F.min("token").alias("cls"))
    return facts.join(names, ["n", "n_bad", "h1", "h2"]).select("token", "cls")


def mine_rules(transactions: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (antecedent, confidence, support) for BAD from rows with an array `items` (of classes).

    A rule stays if no set of fewer tokens from it is as sure, itself a rule or not: the best confidence
    in a set is its own or the best of its sets less one item, found by a join on equality a size.
    """
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=tasks_for(transactions.sparkSession)).fit(transactions)
    n, found = transactions.count(), model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    joint = found.where(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("both"))
    sure = found.select(F.col("items").alias("antecedent"), "freq").join(joint, "antecedent").where(F.size("antecedent") > 0)
    sure = sure.select("antecedent", F.size("antecedent").alias("k"), (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(n)).alias("support"))
    sure = materialize(sure, "candidates")
    longest = sure.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    best = sure.where("k = 1").withColumn("within", F.lit(0.0))
    levels = [best]
    for k in range(2, longest + 1):
        less = sure.where(F.col("k") == k).select("antecedent", F.explode("antecedent").alias("out")).select("antecedent", F.array_remove("antecedent", F.col("out")).alias("rest"))
        known = best.select(F.col("antecedent").alias("rest"), F.greatest("confidence", "within").alias("c"))
        within = less.join(known, "rest").groupBy("antecedent").agg(F.max("c").alias("within"))
        best = materialize(sure.where(F.col("k") == k).join(within, "antecedent").select(*levels[0].columns), "rules-by-size")
        levels.append(best)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("within"))).select("antecedent", "confidence", "support")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    fixed: list[tuple[str, str, str]],
    min_support: float = 0.002,
    min_count: int = 20,
    min_confidence: float = 0.8,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, mined, confidence) for every row of `pages`.

    `labelled` has (url, bad); `fixed` are rules (verdict, host, path). A mined rule needs a share
    of `min_support` and `min_count` of the labelled urls.
    """
    url = F.col(url_col)
    facts = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), url.alias("_url"))
    facts = facts.withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    facts = materialize(facts.withColumn("tokens", url_tokens(F.col("_url"), F.col("host"), F.col("path"))), "urls")

    bad = labelled.select(url.alias("_url"), F.col("bad").cast("boolean").alias("_bad")).dropna()
    bad = bad.withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    tokens = url_tokens(F.col("_url"), F.col("host"), F.col("path"))
    transactions = bad.select(F.when(F.col("_bad"), F.array_union(tokens, F.array(F.lit(BAD)))).otherwise(tokens).alias("items")).where(F.size("items") > 0)
    transactions = materialize(transactions.withColumn("row", F.monotonically_increasing_id()), "transactions")
    mined = facts.select("row", F.lit(None).cast("array<string>").alias("mined"), F.lit(None).cast("double").alias("confidence")).limit(0)
    n = transactions.count()
    if not transactions.where(F.array_contains("items", BAD)).isEmpty():
        support = min(1.0, max(min_support, min_count / n))
        classes = near(materialize(token_classes(transactions, support * n), "classes"))
        known = transactions.select("row", F.explode("items").alias("token")).join(classes.unionByName(classes.sparkSession.createDataFrame([(BAD, BAD)], "token string, cls string")), "token")
        grouped = materialize(known.groupBy("row").agg(F.collect_set("cls").alias("items")), "classed")
        grouped = transactions.select("row").join(grouped, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        rules = materialize(mine_rules(grouped, support, min_confidence), "rules")
        frequency = known.groupBy("cls").count()
        filed = rules.select("antecedent", "confidence", F.explode("antecedent").alias("cls")).join(frequency, "cls")
        index = near(materialize(filed.groupBy("antecedent", "confidence").agg(F.min_by("cls", F.struct("count", "cls")).alias("cls")), "index"))
        have = facts.select("row", F.explode("tokens").alias("token")).join(classes, "token").groupBy("row", "cls").agg(F.max("token").alias("token"))
        have = have.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("cls", "token"))).alias("have"))
        hits = have.select("row", "have", F.explode(F.map_keys("have")).alias("cls")).join(index, "cls").where(F.size(F.array_except("antecedent", F.map_keys("have"))) == 0)
        hits = hits.withColumn("tokens", F.array_sort(F.transform("antecedent", lambda c: F.element_at("have", c))))
        mined = hits.groupBy("row").agg(F.max_by("tokens", F.struct("confidence", "tokens")).alias("mined"), F.max("confidence").alias("confidence"))

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(fixed, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    out = facts.join(mined, "row", "left").withColumns({"rule": rule, "fixed": verdict})
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), F.array_join("mined", " ").alias("mined"), "confidence")
