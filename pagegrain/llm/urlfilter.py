"""URL filter: logistic regression on hashed character n-grams, with rules.

Only built-in functions run. The labelled table is small, so the regression is
trained in one row and in its dual form: gradient descent from zero keeps the
weights a combination of the examples, one coefficient each, and an example's
margin is a sum over shared buckets. The weights of all buckets, a bounded
array, then become a constant of the scoring plan, which needs no shuffle.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased. Path: from there up to ``?``, ``#`` or the end. A null URL, or one
without ``://``, has both empty and is judged by the bias alone. A score of
zero blocks. Repeated rows are judged each for itself. A rule fits
its host and all subdomains if the path starts with the rule's; the longest
fitting rule wins over the regression.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import quoted

BUCKETS = 4096
GRAMS = (3, 4)
STEPS = 200
RATE = 0.5
DECAY = 0.001

#: (verdict, rule): a host, then the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled URL table: hosts under which nothing is wanted, and others.
BLOCKED = (
    "casino-win", "best-casino", "online-casino", "lucky-slots", "poker-win", "free-bets", "cheap-pills", "cheap-meds", "pills-shop",
    "diet-pills", "cheap-watches", "ads-track", "ads-server", "ad-track", "click-ads", "track-clicks", "popup-ads", "spam-farm", "link-farm",
    "spam-mail", "spam-links", "seo-farm", "malware-load", "phish-login", "free-iphone", "win-prize", "get-rich", "quick-loans", "payday-loans",
    "hot-singles", "adult-cams", "xxx-video", "warez-crack", "keygen-free", "fake-news-farm", "bitcoin-win",
)
ALLOWED = (
    "wiki", "news", "docs", "library", "university", "recipes", "weather", "history", "science", "museum", "gardening", "travel", "music",
    "school", "health", "photos", "books", "sports", "films", "maps", "forum", "parks", "council", "theatre", "cycling", "birds", "railway",
    "chess", "cooking", "physics", "language", "poetry", "archive", "journal", "review", "market-town",
)
PREFIXES = ("", "www.", "blog.", "m.")
DOMAINS = ("example.com", "example.org", "example.net")
LANGUAGES = ("en", "de", "fr", "es")
TAILS = ("", "/", ".html", "?page=2&ref=x", "#top", "?utm_source=feed")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block): each host once, prefixes, domains and paths in turn
    for both classes alike."""
    made = []
    for label, hosts in ((1, BLOCKED), (0, ALLOWED)):
        for i, host in enumerate(hosts):
            scheme = ("https", "http")[i % 2]
            made.append((f"{scheme}://{PREFIXES[i % 4]}{host}.{DOMAINS[i % 3]}/{LANGUAGES[(i // 2) % 4]}/{i * 37 + 11}{TAILS[i % 6]}", label))
    return made


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of ``^host$`` and of the path."""

    def grams(mark: str, text: Column, n: int) -> Column:
        letters = F.split(text, "")
        cut = F.transform(
            F.sequence(F.lit(0), F.length(text) - n),
            lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(mark), *[F.get(letters, i + k) for k in range(n)])), 1, 4), 16, 10).cast("int") % BUCKETS,
        )
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<int>"))

    whole = F.concat(F.lit("^"), host, F.lit("$"))
    return F.array_distinct(F.concat(*[grams(m, t, n) for m, t in (("h", whole), ("p", path)) for n in GRAMS]))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """The bias and then the weight of every bucket."""
    if not labelled:
        return [0.0] * (BUCKETS + 1)
    rows = ", ".join(f"({n}, '{u.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', {int(y)})" for n, (u, y) in enumerate(labelled))
    given = spark.sql(f"SELECT * FROM VALUES {rows} AS t(n, url, y)")
    cut = given.select("n", "y", buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("x"))
    packed = cut.agg(F.array_sort(F.collect_list(F.struct("n", "y", "x"))).alias("e"))
    # row i: 1 for the bias plus the buckets that i shares with each example
    kernel = packed.selectExpr("e", "transform(e, a -> transform(e, b -> CAST(1 + size(array_intersect(a.x, b.x)) AS DOUBLE))) AS k")
    margin = "aggregate(zip_with(r, c, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    stepped = kernel.selectExpr(
        "e",
        f"aggregate(sequence(1, {steps}), array_repeat(0D, size(e)), (c, t) -> "
        f"transform(k, (r, i) -> get(c, i) * {1 - rate * decay}D - {rate}D / size(e) * (1 / (1 + exp(-{margin})) - get(e, i).y))) AS c",
    )
    held = stepped.selectExpr("explode(arrays_zip(e.x, c)) AS z").selectExpr("z.c", "explode(concat(array(-1), z.x)) AS b")
    weights = [0.0] * (BUCKETS + 1)
    for r in held.groupBy("b").agg(F.sum("c").alias("w")).collect():  # as many rows as buckets at most
        weights[r["b"] + 1] = r["w"]
    return weights


def score(weights: Sequence[float], found: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    return F.aggregate(found, F.lit(weights[0]), lambda s, b: s + F.get(table, b + 1))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict); else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit(f".{site}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Adds host, path, rule, score (the regression's log-odds of block) and
    verdict to every row; input columns of those names are replaced."""
    weights = train(df.sparkSession, labelled_urls() if labelled is None else labelled)
    made = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in df.columns if c.lower() not in made or c == url]
    at = F.col(quoted(url))
    # the input's columns ride in one struct, so that none clashes with one in between
    cut = df.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), host_of(at).alias("host"), path_of(at).alias("path"))
    told = cut.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("found"), score(weights, buckets(F.col("host"), F.col("path"))).alias("score"))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= 0, "block").otherwise("allow"))
    return told.select("row.*", "host", "path", F.col("found.rule").alias("rule"), "score", verdict.alias("verdict"))


def oracle() -> str:
    """DuckDB SQL of the query, training included."""
    rows = ", ".join(f"({n}, '{u}', {y})" for n, (u, y) in enumerate(labelled_urls()))
    host = f"translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract(coalesce(url, ''), '{PARTS}', 2)"
    gram = "list_transform(range(1, length({t}) - {n} + 2), lambda i: CAST('0x' || left(md5('{m}' || substr({t}, CAST(i AS BIGINT), {n})), 4) AS INTEGER) % {b})"
    found = "list_distinct(" + " || ".join(gram.format(t=t, m=m, n=n, b=BUCKETS) for m, t in (("h", "('^' || host || '$')"), ("p", "path")) for n in GRAMS) + ")"
    cases = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES)
    return f"""
WITH RECURSIVE given(n, url, y) AS (VALUES {rows}),
gp AS (SELECT n, y, {host} AS host, {path} AS path FROM given),
gx AS (SELECT n, y, {found} AS x FROM gp),
k AS (SELECT list(r ORDER BY n) AS k, list(y ORDER BY n) AS y FROM (
  SELECT a.n, a.y, list(CAST(1 + len(list_intersect(a.x, b.x)) AS DOUBLE) ORDER BY b.n) AS r FROM gx a, gx b GROUP BY a.n, a.y)),
gd(t, c) AS (
  SELECT 0, list_transform(y, lambda v: CAST(0 AS DOUBLE)) FROM k
  UNION ALL
  SELECT t + 1, list_transform(k.k, lambda r, i: c[i] * {1 - RATE * DECAY} - CAST({RATE} AS DOUBLE) / len(c) * (1 / (1 + exp(-list_dot_product(r, c))) - k.y[i]))
  FROM gd, k WHERE t < {STEPS}),
c AS (SELECT unnest(c) AS c, unnest(range(len(c))) AS n FROM gd WHERE t = {STEPS}),
w AS (SELECT b, sum(c) AS w FROM (SELECT c, unnest(x) AS b FROM c JOIN gx USING (n)) GROUP BY b),
pp AS (SELECT row_number() OVER () AS pos, page_id, {host} AS host, {path} AS path FROM pages),
px AS (SELECT pos, unnest({found}) AS b FROM pp),
s AS (SELECT pos, sum(w) AS s FROM px JOIN w USING (b) GROUP BY pos),
r AS (SELECT pp.*, CASE {cases} END AS rule, coalesce(s.s, 0) + (SELECT sum(c) FROM c) AS s FROM pp LEFT JOIN s USING (pos))
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN s >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
