"""The run memory: upserts, votes, joins over tables of runs, mappings and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """All of new, and those of old whose key isn't there."""
    return old.join(new, key, "left_anti").unionByName(new)


def count_up(old: DataFrame, new: DataFrame, keys: list[str], counter: str = "usage_count") -> DataFrame:
    """Merges counters: keys of either side, counts added."""
    return old.select(*keys, counter).unionByName(new.select(*keys, counter)).groupBy(keys).agg(F.sum(counter).alias(counter))


def keep_recent(df: DataFrame, time: str, days: int, now: str) -> DataFrame:
    return df.where(F.col(time) >= F.date_sub(F.lit(now).cast("date"), days))


def vote(df: DataFrame, key: str, choice: str, weight: str, confidence: str) -> DataFrame:
    """The choice of each key with the largest total weight, then mean confidence, then name."""
    v = df.groupBy(key, choice).agg(F.sum(weight).alias("votes"), F.avg(confidence).alias("confidence"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), F.desc("confidence"), choice)
    return v.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rules_in_reach(rules: DataFrame, runs: DataFrame, rule_time: str, run_time: str, by: str, days: int = 30, most: int = 10) -> DataFrame:
    """Rules used no earlier than days before a run, counted over all such pairs, the most frequent first.

    The range join counts without making pairs: rules and runs are counted by day, and a running sum over days gives the
    runs that each rule's day reaches. A day's row is all that the global window holds.
    """
    u = rules.groupBy(F.col(by), F.col(rule_time).cast("date").alias("day")).agg(F.count("*").alias("n"))
    r = runs.select(F.date_sub(F.col(run_time).cast("date"), days).alias("day")).groupBy("day").agg(F.count("*").alias("r"))
    days_of = u.select("day").distinct().join(r, "day", "full_outer").withColumn("reached", F.sum(F.coalesce("r", F.lit(0))).over(Window.orderBy("day")))
    out = u.join(days_of.select("day", "reached"), "day").groupBy(by).agg(F.sum(F.col("n") * F.col("reached")).alias("pairs"))
    return out.where("pairs > 0").orderBy(F.desc("pairs"), by).limit(most)


def anti_union(first: DataFrame, second: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """All of first, then those of second whose key isn't there."""
    out = first.withColumn("_o", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("_o", F.lit(1)))
    out = out.orderBy("_o", key).limit(most) if most else out
    return out.drop("_o")


def domain_statistics(runs: DataFrame, domain: str, scores: list[str]) -> DataFrame:
    """Runs and mean scores by domain."""
    return runs.groupBy(domain).agg(F.count("*").alias("runs"), *[F.avg(s).alias(f"avg_{s}") for s in scores])


def recent_successes(runs: DataFrame, domain: str, success, time: str, now: str, days: int = 30) -> DataFrame:
    """Successful runs by domain within the last days."""
    return runs.where(success & (F.col(time) > F.date_sub(F.lit(now).cast("date"), days))).groupBy(domain).agg(F.count("*").alias("successes"))


def most_frequent(df: DataFrame, domain: str, issue: str, most: int = 5) -> DataFrame:
    """The most frequent issues of each domain, ties by name."""
    n = df.groupBy(domain, issue).agg(F.count("*").alias("frequency"))
    w = Window.partitionBy(domain).orderBy(F.desc("frequency"), issue)
    return n.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def most_effective(df: DataFrame, domain: str, remediation: str, effect: str, most: int = 3) -> DataFrame:
    """The remediations with the best mean effect in each domain, ties by name."""
    n = df.groupBy(domain, remediation).agg(F.avg(effect).alias("effectiveness"))
    w = Window.partitionBy(domain).orderBy(F.desc("effectiveness"), remediation)
    return n.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


# Parts of column names by which mappings of similar columns are sought, in this order.
NAME_PARTS = ["date", "time", "id", "name", "amount", "count", "total", "district", "mandal", "village"]


def suggest_by_pattern(mappings: DataFrame, names: list[str], original: str, choice: str, confidence: str) -> DataFrame:
    """(name, choice, confidence, pattern): for each new column name, by the first part that it shares with known names, the choice
    of the best mean confidence among these, at 0.8 of it. Names without such a part are left out."""
    low = F.lower(F.col(original))
    known = mappings.select(F.explode(F.filter(F.lit(NAME_PARTS), lambda p: low.contains(p))).alias("pattern"), F.col(choice).alias("choice"), F.col(confidence).cast("double").alias("confidence"))
    votes = known.groupBy("pattern", "choice").agg(F.avg("confidence").alias("confidence"))
    best = votes.withColumn("_r", F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("confidence"), "choice"))).where("_r = 1")
    asked = [F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"), F.lit(i).alias("at")) for n in names for i, p in enumerate(NAME_PARTS) if p in n.lower()]
    if not asked:
        return best.select(F.lit(None).cast("string").alias("name"), "choice", "confidence", "pattern").where(F.lit(False))
    # one row a pattern in best, few names
    out = best.withColumn("a", F.explode(F.filter(F.array(*asked), lambda a: a["pattern"] == F.col("pattern"))))
    first = out.groupBy(F.col("a.name").alias("name")).agg(F.min_by(F.struct("choice", "confidence", "pattern"), "a.at").alias("b"))
    return first.select("name", "b.choice", (0.8 * F.col("b.confidence")).alias("confidence"), "b.pattern")


def suggest(mappings: DataFrame, names: list[str], original: str, choice: str, confidence: str, weight: str | None = None) -> DataFrame:
    """(name, choice, confidence, rule): for each new column name the choice that columns of exactly that name (case aside) were given most often,
    ties by mean confidence and choice; for names that no column has borne, suggest_by_pattern(). Names without either are left out."""
    asked = mappings.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string").coalesce(1)
    known = mappings.select(F.lower(F.col(original)).alias("_low"), F.col(choice).alias("_choice"), F.col(confidence).cast("double").alias("_confidence"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_weight"))
    exact = asked.withColumn("_low", F.lower("name")).join(vote(known, "_low", "_choice", "_weight", "_confidence"), "_low")
    exact = exact.select("name", F.col("_choice").alias("choice"), "confidence", F.lit("exact").alias("rule"))
    pattern = suggest_by_pattern(mappings, list(dict.fromkeys(names)), original, choice, confidence).select("name", "choice", "confidence", F.lit("pattern").alias("rule"))
    return exact.unionByName(pattern.join(exact.select("name"), "name", "left_anti"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of several tables."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Makes tables of the run memory readable from SQL."""
    for name, t in tables.items():
        t.createOrReplaceTempView(name)


def similar_runs(runs: DataFrame, key: str, schema: str, domain: str, columns: str, time: str, run, fingerprint, of, width: int, exact: int = 5, near: int = 5, most: int = 5) -> DataFrame:
    """At most five runs: those of the same schema, the latest first, then those of the domain nearest in number of columns."""
    others = runs.where(F.col(key) != F.lit(run))
    same = others.where(F.col(schema) == F.lit(fingerprint)).orderBy(F.desc(time), key).limit(exact)
    same = same.withColumns({"similarity": F.lit("exact_schema_match"), "_gap": F.lit(0).cast("double"), "_o": F.lit(0)})
    gap = F.abs(F.col(columns) - width).cast("double")
    like = others.where(F.col(domain) == F.lit(of)).orderBy(gap, F.desc(time), key).limit(near)
    like = like.join(same.select(key), key, "left_anti").withColumns({"similarity": F.lit("domain_similarity"), "_gap": gap, "_o": F.lit(1)})
    return same.unionByName(like).orderBy("_o", "_gap", F.desc(time), key).limit(most).drop("_o", "_gap")


def insights(runs: DataFrame, patterns: DataFrame, domain: str, quality: str, issue: str, low: float = 70.0, experienced: int = 5) -> DataFrame:
    """(domain, runs, quality, low_quality, experienced, top_issue): what the memory knows of each domain."""
    known = runs.groupBy(domain).agg(F.count("*").alias("runs"), F.avg(quality).alias("quality"))
    top = most_frequent(patterns, domain, issue, 1).select(domain, F.col(issue).alias("top_issue"))
    return known.join(top, domain, "left").select(domain, "runs", "quality", (F.col("quality") < low).alias("low_quality"), (F.col("runs") > experienced).alias("experienced"), "top_issue")


def latest(df: DataFrame, time: str, key: str, most: int = 100) -> DataFrame:
    """The newest rows: a bounded history is its purpose."""
    return df.orderBy(F.desc(time), key).limit(most)
