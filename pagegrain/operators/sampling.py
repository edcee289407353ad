"""Page samples. Random choice is order by md5 of seed and page, which every
engine computes alike, so samples are reproducible and need no shuffle but the
rank of a document's pages."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mixed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _ranked(pages: DataFrame, seed: int, *within: str) -> DataFrame:
    return pages.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id", *within).orderBy(mixed(seed, "doc_id", "page"), "page")))


def first_and_random(pages: DataFrame, first: int = 30, more: int = 10, seed: int = 42) -> DataFrame:
    """The first pages and some later ones at random."""
    late = _ranked(pages.where(F.col("page") > first), seed).where(F.col("_rank") <= more).drop("_rank")
    return pages.where(F.col("page") <= first).unionByName(late)


def contents_sample(pages: DataFrame, first: int = 20, seed: int = 42) -> DataFrame:
    """The first pages, where contents stand, and a tenth of the others, one at least."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    late = _ranked(pages.where(F.col("page") > first), seed).join(total, "doc_id").where(F.col("_rank") <= F.greatest(F.lit(1), F.floor((F.col("_n") - first) / 10)))
    return pages.where(F.col("page") <= first).unionByName(late.select(pages.columns))


def sections_sample(pages: DataFrame, seed: int = 42, share: float = 0.15, least: int = 10) -> DataFrame:
    """At least ten pages or 15 %: 60, 30 and 10 % of them from the thirds."""
    n = F.col("_n")
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    third = F.when(F.col("page") <= F.floor(n / 3), 0).when(F.col("page") <= F.floor(n * 2 / 3), 1).otherwise(2)
    rows = pages.join(total, "doc_id").withColumn("third", third.cast("int"))
    target = F.greatest(F.lit(least), F.floor(n * share))
    early, middle = F.floor(target * 0.6), F.floor(target * 0.3)
    quota = F.when(F.col("third") == 0, early).when(F.col("third") == 1, middle).otherwise(target - early - middle)
    return _ranked(rows, seed, "third").where(F.col("_rank") <= quota).select(*pages.columns, "third")


def unused_pages(pages: DataFrame, used: DataFrame, most: int = 10, seed: int = 42) -> DataFrame:
    """Up to ten pages that no sample has used yet."""
    left = pages.join(used.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return _ranked(left, seed).where(F.col("_rank") <= most).drop("_rank")


def front_back_random(matches: DataFrame, ends: int = 3, random: int = 3, seed: int = 42) -> DataFrame:
    """Of each pattern the first, the last and some other matches."""
    w = Window.partitionBy("doc_id", "pattern_name")
    order = ["page", "line_number", "match_no"]
    rows = matches.withColumn("_up", F.row_number().over(w.orderBy(*order))).withColumn("_down", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])))
    part = F.when(F.col("_up") <= ends, "front").when(F.col("_down") <= ends, "back").otherwise("random")
    ranked = rows.withColumn("part", part).withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "pattern_name", "part").orderBy(mixed(seed, "doc_id", *order), *order)))
    return ranked.where((F.col("part") != "random") | (F.col("_r") <= random)).drop("_up", "_down", "_r")


def batches(pages: DataFrame, initial: int = 8, increment: int = 6, threshold: int = 30) -> DataFrame:
    """Adds batch_no: the first eight pages, then six at a time; documents of
    fewer than thirty pages are one batch."""
    total = pages.groupBy("doc_id").agg(F.max("page").alias("_n"))
    number = F.when((F.col("_n") < threshold) | (F.col("page") <= initial), 1).otherwise(2 + F.floor((F.col("page") - initial - 1) / increment))
    return pages.join(total, "doc_id").withColumn("batch_no", number.cast("int")).drop("_n")


def groups_sample(pages: DataFrame, groups: int = 3, length: int = 4, singles: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, page, kind, group_no): runs of consecutive pages that don't
    overlap and single pages of the rest, for every document whose pages run
    from 1; all pages are singles where there are too few."""
    total = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    large = total.where(F.col("n") > groups * length + singles)
    # the pages outside the runs are shared out before and between them
    offsets = large.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - groups * length)).alias("at"))
    drawn = offsets.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(mixed(seed, "doc_id", "at"), "at"))).where(F.col("_rank") <= groups)
    placed = drawn.withColumn("group_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))
    start = F.col("at") + (F.col("group_no") - 1) * length + 1
    runs = placed.select("doc_id", F.explode(F.sequence(start, start + length - 1)).alias("page"), F.lit("group").alias("kind"), "group_no")
    rest = pages.join(large.select("doc_id"), "doc_id", "left_semi").join(runs.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    alone = _ranked(rest, seed + 1).where(F.col("_rank") <= singles)
    few = pages.join(large.select("doc_id"), "doc_id", "left_anti")
    one = lambda d: d.select("doc_id", "page", F.lit("individual").alias("kind"), F.lit(None).cast("int").alias("group_no"))
    return runs.unionByName(one(alone)).unionByName(one(few))


def groups_and_singles(total: int, groups: int = 3, length: int = 4, singles: int = 4, seed: int = 42) -> tuple[list[list[int]], list[int]]:
    """Runs of consecutive pages that don't overlap, and single pages of the
    rest; all pages are singles if there are too few. Bounded by one document's pages."""
    if total <= groups * length + singles:
        return [], list(range(1, total + 1))
    order = lambda p: hashlib.md5(f"{seed}:{p}".encode()).hexdigest()
    # the pages outside the runs, shared out before and between them
    free = range(total - groups * length + 1)
    offsets = sorted(sorted(free, key=order)[:groups])
    runs = [list(range(o + k * length + 1, o + (k + 1) * length + 1)) for k, o in enumerate(offsets)]
    taken = {p for r in runs for p in r}
    return runs, sorted(sorted(set(range(1, total + 1)) - taken, key=lambda p: order(-p))[:singles])


def group_ranges(runs: list[list[int]]) -> list[str]:
    return [f"{r[0]}-{r[-1]}" for r in runs]
