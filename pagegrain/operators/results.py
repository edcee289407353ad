"""Reports over runs of prompts: totals, confusion, ranking, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_totals(parts: dict[str, DataFrame]) -> DataFrame:
    """Elements of several kinds as one table, counted by kind and over all."""
    rows = None
    for kind, df in parts.items():
        tagged = df.select(F.lit(kind).alias("content_type"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return rows.rollup("content_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("content_type", F.lit("all")).alias("content_type"), "n")


def confusion(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(page, kind, label): what should be and was found, and not."""
    both = expected.join(found, ["page", "kind"], "full")
    should, did = F.coalesce("expected", F.lit(0)) > 0, F.coalesce("found", F.lit(0)) > 0
    label = F.when(should & did, "true positive").when(should, "false negative").when(did, "false positive").otherwise("true negative")
    return both.select("page", "kind", label.alias("label"))


def confusion_table(labels: DataFrame) -> DataFrame:
    kinds = ["true positive", "false negative", "false positive", "true negative"]
    return labels.groupBy("kind").agg(*[F.count_if(F.col("label") == k).alias(k.replace(" ", "_")) for k in kinds])


def expected_empty(tests: DataFrame) -> DataFrame:
    """Whether a test's description says that nothing is to be found, and whether that held."""
    none = F.lower("description").rlike("no |without|empty|none")
    return tests.select("test_id", none.alias("expected_empty"), F.when(none, F.col("found") == 0).otherwise(F.col("found") > 0).alias("as_expected"))


def summary(runs: DataFrame) -> DataFrame:
    ok = F.col("success")
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, F.col("seconds"))).alias("mean_seconds"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def by_size(runs: DataFrame) -> DataFrame:
    """Successful runs by request size: under 50, to 150, and more kilobytes."""
    bucket = F.when(F.col("kilobytes") < 50, "small").when(F.col("kilobytes") < 150, "medium").otherwise("large")
    return runs.where("success").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds"))


def extremes(runs: DataFrame, fastest: int = 5, slowest: int = 3) -> DataFrame:
    """The fastest and the slowest successful runs, ranked from the fastest."""
    ok = runs.where("success")
    quick = ok.orderBy("seconds", "run_id").limit(fastest).withColumn("kind", F.lit("fastest"))
    slow = ok.orderBy(F.desc("seconds"), F.desc("run_id")).limit(slowest).withColumn("kind", F.lit("slowest"))
    return quick.unionByName(slow).select("kind", "run_id", "seconds")


def spread(runs: DataFrame) -> DataFrame:
    return runs.where("success").agg((F.max("seconds") / F.nullif(F.min("seconds"), F.lit(0.0))).alias("slowest_to_fastest"))


def scaling(runs: DataFrame) -> DataFrame:
    """Efficiency of n objectives at once against the first run, by group."""
    w = Window.partitionBy("group_no").orderBy("objectives")
    return runs.select("group_no", "objectives", (F.first("seconds").over(w) / F.col("seconds") * F.col("objectives")).alias("efficiency"))


def until_failure(runs: DataFrame) -> DataFrame:
    """Run counts of each size group up to the first that had a failure, that one included."""
    groups = runs.groupBy("group_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed"))
    before = F.coalesce(F.sum("failed").over(Window.orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("_before", before).where("_before = 0").drop("_before")


def accuracy(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    share = F.when(F.col("expected") > 0, F.col("found") * 100.0 / F.col("expected")).otherwise(F.lit(0.0))
    return found.join(expected, key).select(key, "found", "expected", share.alias("accuracy"))


def multi_to_single(rows: DataFrame, target: float = 0.7) -> DataFrame:
    """Accuracy on many pages against that on one, and whether it is enough."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("accuracy")))
    ratio = pick("multi") / F.nullif(pick("single"), F.lit(0.0))
    return rows.agg(ratio.alias("ratio"), (ratio >= target).alias("enough"))


def same_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs' metrics side by side and whether they agree, nulls too."""
    both = left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), "metric", "full")
    return both.withColumn("same", F.col("left_value").eqNullSafe(F.col("right_value")))


def overwritten(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of ``more`` in place of those of one key."""
    return base.join(more.select(key), key, "left_anti").unionByName(more)


def token_totals(calls: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    return calls.agg(zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), (zero("prompt_tokens") + zero("completion_tokens")).alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


def matrix(templates: DataFrame, pages: DataFrame) -> DataFrame:
    """Every template with every page; both are short lists of a test set-up."""
    return templates.join(pages, how="cross")
