import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import reshard


def slow_cost(supply, demand, cost):
    """Least cost over all integral flows of tiny problems."""
    best = None
    ways = [[c for c in itertools.product(range(s + 1), repeat=len(demand)) if sum(c) == s] for s in supply]
    for rows in itertools.product(*ways):
        if all(sum(r[j] for r in rows) == demand[j] for j in range(len(demand))):
            total = sum(r[j] * cost[i][j] for i, r in enumerate(rows) for j in range(len(demand)))
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_cheapest(seed):
    rng = np.random.default_rng(seed)
    supply = rng.integers(0, 4, 3).tolist()
    demand = reshard.even(sum(supply), 3)
    cost = rng.integers(0, 5, (3, 3)).tolist()
    flow = reshard.min_cost_flow(supply, demand, cost)
    assert [sum(r) for r in flow] == supply and [sum(r[j] for r in flow) for j in range(3)] == demand
    assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == slow_cost(supply, demand, cost)


@pytest.mark.parametrize("seed", range(6))
def test_transfers_cost_as_little_as_the_flow_over_all_pairs(seed):
    rng = np.random.default_rng(seed)
    supply, homeless = rng.integers(0, 90, rng.integers(1, 7)).tolist(), int(rng.integers(0, 50)) * (seed % 2)
    demand = reshard.even(sum(supply) + homeless, int(rng.integers(1, 7)))
    got = reshard.transfers(supply, demand, homeless)
    assert [sum(a for i, _, a in got if i == n) for n in range(len(supply))] == supply and sum(a for i, _, a in got if i is None) == homeless
    assert [sum(a for _, j, a in got if j == n) for n in range(len(demand))] == demand
    cost = [[int(i != j) for j in range(len(demand))] for i in range(len(supply))] + [[1] * len(demand)]
    flow = reshard.min_cost_flow([*supply, homeless], demand, cost)
    assert sum(a for i, j, a in got if i != j) == sum(f * c for fs, cs in zip(flow, cost) for f, c in zip(fs, cs))
    assert len(got) <= len(supply) + 2 * len(demand)


def test_unequal_totals_are_refused():
    with pytest.raises(ValueError):
        reshard.min_cost_flow([1], [2], [[0]])
    with pytest.raises(ValueError):
        reshard.transfers([1], [2])


def check(rows, texts, shards=16):
    sizes = dict.fromkeys(range(shards), 0)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        sizes[r.shard] += r.size
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return sizes


def test_query_evens_out_and_moves_little(spark, sf):
    from pagegrain.llm.queries import op8_flow_reshard

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_flow_reshard(spark, sf).collect()
    assert len(rows) == len(texts) == len({r.doc_id for r in rows})
    sizes = check(rows, texts)
    mean = sum(sizes.values()) / 16
    assert max(abs(v - mean) for v in sizes.values()) <= max(r.size for r in rows)
    old = dict.fromkeys(range(12), 0)
    for r in rows:
        old[r.old_shard] += r.size
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= sum(max(0, v - mean) for v in old.values()) + 16 * max(r.size for r in rows)


def laid(spark, tmp_path, df, shard="home", files=1, name="old"):
    path = f"file://{tmp_path}/{name}"
    reshard.write_shards(df.repartition(files), F.col(shard), path)
    return path


def names(path):
    import glob
    import os

    root = path.removeprefix("file://")
    return {os.path.relpath(f, root) for f in glob.glob(f"{root}/shard=*/*.parquet")}


def test_untouched_files_keep_their_names(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (10 + i % 7), i % 4) for i in range(4000)], "doc_id long, text string, home int")
    old = laid(spark, tmp_path, df, files=5)
    before = names(old)
    sizes = {r.home: r.n for r in df.selectExpr("home", "length(text) + 1 AS n").groupBy("home").agg(F.sum("n").alias("n")).collect()}
    # shard 0 gives a third to a new one, the others neither give nor take
    give = sizes[0] // 3
    new = f"file://{tmp_path}/new"
    rows = reshard.reshard(spark, old, df.schema, 4, [sizes[0] - give, sizes[1], sizes[2], sizes[3], give], new).collect()
    assert names(old) == before and len(rows) == 4000
    assert sorted(r.row.doc_id for r in rows) == list(range(4000))
    for home in (1, 2, 3):
        assert all(r.kept and r.shard == home for r in rows if r.home == home)
    kept = {r.file for r in rows if r.kept}
    assert {f for f in before if not f.startswith("shard=0/")} < kept < before
    assert {f for f in names(new)} == {r.file for r in rows if not r.kept}
    got = {s: sum(r.size for r in rows if r.shard == s) for s in range(5)}
    assert all(abs(got[s] - w) <= 17 for s, w in enumerate([sizes[0] - give, sizes[1], sizes[2], sizes[3], give]))
    # what was rewritten is what moves and at most one file that is cut
    rewritten = {r.row.doc_id for r in rows if not r.kept}
    moved = {r.row.doc_id for r in rows if r.shard != r.home}
    assert moved <= rewritten and len(rewritten) <= len(moved) + 1000 // 5 + 20
    check_slots(rows)


def check_slots(rows):
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_even_layout_stays_where_it_is(spark, tmp_path):
    df = spark.createDataFrame([(i, "xxxx", i % 2) for i in range(40)], "doc_id long, text string, home int")
    rows = reshard.reshard(spark, laid(spark, tmp_path, df), df.schema, 2, 2).collect()
    assert len(rows) == 40 and all(r.shard == r.home and r.kept for r in rows)


def test_large_files_are_cut_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reshard, "BLOCKS", 10)
    df = spark.createDataFrame([(i, "y" * (i % 11), 0) for i in range(500)], "doc_id long, text string, home int")
    rows = reshard.reshard(spark, laid(spark, tmp_path, df), df.schema, 1, 3).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(3)]
    assert len(rows) == 500 and max(sizes) - min(sizes) <= 2 * 50 * 11
    check_slots(rows)


@pytest.mark.parametrize("broadcast, listed", [(500_000, 2000), (0, 0)])
def test_nulls_repeats_names_and_nothing(spark, tmp_path, monkeypatch, broadcast, listed):
    monkeypatch.setattr(reshard, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(reshard, "LISTED_FILES", listed)
    shape = "doc_id long, text string, home int, shard int, slot long, b int, o int, file string, size long, row string, block int"
    rows = [(None, None, 0), (1, "", 1), (1, "", 1), (2, "a" * 50, None), (3, "long " * 30_000, 1), (4, "b", 7), (5, "c", -1)]
    df = spark.createDataFrame([(*r, 9, 9, 9, 9, "f", 9, "r", 9) for r in rows], shape)
    got = reshard.reshard(spark, laid(spark, tmp_path, df), df.schema, 2, 3).collect()
    assert got[0].asDict().keys() == {"row", "size", "home", "shard", "slot", "file", "kept"}
    assert sorted((str(tuple(r.row)) for r in got)) == sorted(str(tuple(r)) for r in df.collect())
    assert all(r.size == len((r.row.text or "").encode()) + 1 and r.home == r.row.home for r in got)
    assert all(not r.kept for r in got if r.home not in (0, 1))
    check_slots(got)
    none = df.limit(0)
    assert reshard.reshard(spark, laid(spark, tmp_path, none, name="none"), none.schema, 2, 3).count() == 0
