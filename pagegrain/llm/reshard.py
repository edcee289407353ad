"""Resharding of files by minimum-cost flow.

A layout is a folder of Parquet files, each in the folder of its shard. The old
shards' sizes are supplies, the new shards' capacities demands; a byte that
stays costs nothing, a byte that moves costs one. The flow says how many bytes
go from where to where at the least cost.

Whole files realise it. A shard's files, largest first, are laid over what the
flow takes from that shard, what stays first. A file within one target goes
there whole. One that lies across a bound, of which there are no more than the
flow has amounts, is cut into at most ``BLOCKS`` runs of rows, and of these the
largest goes in turn to the target with most still to get. Files of which a
row moves are rewritten, all others stay where they are.

The driver sees one size a shard and the flow's amounts. Sizes are the UTF-8
bytes of the text (null: none) plus one. Rows whose old shard is null or no
shard's number lie nowhere, so each of them moves. Repeated rows are rows like
any other; an empty table gives an empty layout. The columns of a row are one
struct, so none can clash with a layout's own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagegrain.llm.common import quoted, scratch_path, written

#: Runs of rows that a file across a bound is cut into.
BLOCKS = 1024
#: Rows of the tables of files and runs that are broadcast at most; larger ones join by shuffle.
BROADCAST_ROWS = 500_000
#: Paths that are listed to read changed files alone; of more, all files are read.
LISTED_FILES = 2000


class Network:
    """Directed edges with room and price, each with its twin."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = []  # [to, room, price]; an edge's twin is its number xor 1
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def link(self, a: int, b: int, room: int, price: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, room, price])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -price])
        return len(self.edges) - 2

    def amount(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]

    def fill(self, source: int, sink: int) -> None:
        """Cheapest augmenting paths, as long as there is one."""
        edges, out = self.edges, self.out
        while True:
            far, via = {source: 0}, {}
            waiting, inside = deque([source]), {source}
            while waiting:
                a = waiting.popleft()
                inside.discard(a)
                for e in out[a]:
                    b, room, price = edges[e]
                    if room and far[a] + price < far.get(b, 1 << 62):
                        far[b], via[b] = far[a] + price, e
                        if b not in inside:
                            inside.add(b)
                            waiting.append(b)
            if sink not in far:
                return
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = edges[via[b] ^ 1][0]
            push = min(edges[e][1] for e in path)
            for e in path:
                edges[e][1] -= push
                edges[e ^ 1][1] += push


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j] of the least total cost that empties the supplies into the
    demands, by successive cheapest augmenting paths. Totals must be equal."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    net, source, sink = Network(n + m + 2), n + m, n + m + 1
    for i, amount in enumerate(supply):
        net.link(source, i, amount, 0)
    names = [[net.link(i, n + j, min(supply[i], demand[j]), cost[i][j]) for j in range(m)] for i in range(n)]
    for j, amount in enumerate(demand):
        net.link(n + j, sink, amount, 0)
    net.fill(source, sink)
    return [[net.amount(e) for e in row] for row in names]


def transfers(supply: Sequence[int], demand: Sequence[int], homeless: int = 0) -> list[tuple[int | None, int, int]]:
    """(old shard, new shard, bytes) of the cheapest flow, where what stays in
    shard i is free and any move costs one a byte; None: from nowhere.

    All moves have one price, so they pass through one node in between, and the
    network has a few edges a shard in place of one for each pair of shards.
    """
    if sum(supply) + homeless != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    net, hub, source, sink = Network(n + m + 3), n + m, n + m + 1, n + m + 2
    stays, gives = [], []
    for i, amount in enumerate(supply):
        net.link(source, i, amount, 0)
        stays.append(net.link(i, n + i, min(amount, demand[i]), 0) if i < m else None)
        gives.append(net.link(i, hub, amount, 1))
    net.link(source, hub, homeless, 1)
    takes = [net.link(hub, n + j, amount, 0) for j, amount in enumerate(demand)]
    for j, amount in enumerate(demand):
        net.link(n + j, sink, amount, 0)
    net.fill(source, sink)
    out: list[tuple[int | None, int, int]] = [(i, i, net.amount(e)) for i, e in enumerate(stays) if e is not None and net.amount(e)]
    wanted = deque([j, net.amount(e)] for j, e in enumerate(takes) if net.amount(e))
    for i, left in [*((i, net.amount(e)) for i, e in enumerate(gives)), (None, homeless)]:
        while left:
            some = min(left, wanted[0][1])
            out.append((i, wanted[0][0], some))
            left -= some
            wanted[0][1] -= some
            if not wanted[0][1]:
                wanted.popleft()
    return out


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 1


def write_shards(docs: DataFrame, shard: Column, path: str, text: str = "text") -> None:
    """Writes a layout under ``path``: each task one file a shard that it meets."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    docs.select(row.alias("row"), size_of(F.col(quoted(text))).alias("size"), shard.cast("int").alias("shard")).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    """(row, size, home, file, at) of a layout: the shard, the file's path from
    its shard's folder on and the row's place in it."""
    shape = StructType([StructField("row", row), StructField("size", LongType()), StructField("shard", IntegerType())])
    return spark.read.schema(shape).parquet(path).select(
        "row", "size", F.col("shard").alias("home"), F.substring_index(F.col("_metadata.file_path"), "/", -2).alias("file"), F.col("_metadata.row_index").alias("at")
    )


def assign(sizes: Sequence[int], wanted: Sequence[int]) -> list[int]:
    """For each block the number of the target it goes to: the largest blocks
    first, each to the target with most still to get (ties: the first)."""
    left, out = list(wanted), [0] * len(sizes)
    for b in sorted(range(len(sizes)), key=lambda b: (-sizes[b], b)):
        out[b] = max(range(len(left)), key=lambda t: (left[t], -t))
        left[out[b]] -= sizes[b]
    return out


def _deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow map over (file, home, step, blocks, wanted), one file a row."""
    for frame in frames:
        for r in frame.itertuples():
            blocks = sorted((b["block"], b["bytes"], b["n"]) for b in r.blocks)
            wanted = sorted((w["lo"], w["target"], w["bytes"]) for w in r.wanted)
            to = assign([b for _, b, _ in blocks], [w for *_, w in wanted])
            yield pd.DataFrame({
                "file": r.file, "home": pd.array([r.home] * len(blocks), dtype="Int32"), "step": r.step, "block": [b for b, *_ in blocks],
                "target": [wanted[t][1] for t in to], "bytes": [b for _, b, _ in blocks], "n": [n for *_, n in blocks],
            })


PIECES = "file string, home int, step long, block long, target int, bytes long, n long"


def plan(rows: DataFrame, old_shards: int, capacities: Sequence[int] | int) -> tuple[DataFrame, list[tuple[int | None, int, int]]]:
    """(the pieces, the flow) for rows as ``read_shards`` gives them.

    A piece: (file, home, step, block, target, bytes, n, slot_from, changed).
    Block b of a file has its rows from b * step on; a file in one piece has
    block 0. slot_from: the piece's first slot in its target; changed: whether
    a row of its file moves. An int asks for so many shards of equal bytes.
    """
    spark = rows.sparkSession
    home = F.when(F.col("home").between(0, old_shards - 1), F.col("home"))
    files, _ = written(rows.groupBy("file", home.alias("home")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-files")
    held = {r["home"]: r["bytes"] for r in files.groupBy("home").agg(F.sum("bytes").alias("bytes")).collect()}  # one row a shard
    supply, homeless = [held.get(i, 0) for i in range(old_shards)], held.get(None, 0)
    demand = even(sum(supply) + homeless, capacities) if isinstance(capacities, int) else list(capacities)
    flow = transfers(supply, demand, homeless)
    bounds, upto = [], {}
    for i, j, amount in flow:
        bounds.append((i, j, upto.get(i, 0), upto.get(i, 0) + amount))
        upto[i] = upto.get(i, 0) + amount
    columns = [pa.array(c, t) for c, t in zip(zip(*bounds) if bounds else [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
    amounts = spark.createDataFrame(pa.table(dict(zip(("giver", "target", "lo", "hi"), columns))))
    by_size = Window.partitionBy("home").orderBy(F.desc("bytes"), "file")
    laid = files.withColumn("end", F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("bytes"))
    overlap = F.least("end", "hi") - F.greatest("start", "lo")
    # the amounts are fewer than old and new shards together
    met = laid.join(F.broadcast(amounts), F.col("home").eqNullSafe(F.col("giver")) & (F.col("start") < F.col("hi")) & (F.col("lo") < F.col("end")))
    wanted = met.groupBy("file", "home", "bytes", "n").agg(F.collect_list(F.struct("lo", "target", overlap.alias("bytes"))).alias("wanted"))
    wanted, _ = written(wanted, "shard-wanted")
    whole = wanted.where(F.size("wanted") == 1).selectExpr("file", "home", "n AS step", "0L AS block", "wanted[0].target AS target", "bytes", "n")
    cut = wanted.where(F.size("wanted") > 1).select("file", "home", "wanted", F.ceil(F.col("n") / BLOCKS).alias("step"))
    within = rows.select("file", "at", "size").join(F.broadcast(cut.select("file", "step")), "file")
    blocks = within.groupBy("file", F.floor(F.col("at") / F.col("step")).alias("block")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    packed = blocks.groupBy("file").agg(F.collect_list(F.struct("block", "bytes", "n")).alias("blocks"))
    dealt = packed.join(F.broadcast(cut), "file").select("file", "home", "step", "blocks", "wanted").mapInPandas(_deal, PIECES)
    pieces = whole.unionByName(dealt)
    moves = ~F.col("target").eqNullSafe(F.col("home"))
    in_shard = Window.partitionBy("target").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("slot_from", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
    return written(numbered.withColumn("changed", F.max(moves).over(Window.partitionBy("file"))), "shard-pieces")[0], flow


def reshard(spark: SparkSession, old: str, row: StructType, old_shards: int, capacities: Sequence[int] | int, new: str | None = None) -> DataFrame:
    """Moves the layout under ``old``, whose shards are 0..old_shards-1, to the
    given capacities. Files of which a row moves are rewritten under ``new``;
    all others stay under ``old``. Shard numbers of old and new name the same
    places.

    Gives the new layout: (row, size, home, shard, slot, file, kept). home: the
    old shard; slot: gapless from 0 in each shard; file: where the row now lies,
    from its shard's folder on; kept: whether that is an old file.
    """
    new = new or scratch_path(spark, "shards")
    rows = read_shards(spark, old, row)
    pieces, _ = plan(rows, old_shards, capacities)
    found = pieces.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("changed"), F.col("file"))).alias("files")).first()
    small = F.broadcast if found["n"] <= BROADCAST_ROWS else (lambda x: x)

    def placed(changed: bool) -> DataFrame:
        some = pieces.where(F.col("changed") == F.lit(changed))
        source = rows
        if changed and found["files"] <= LISTED_FILES:
            names = [r["file"] for r in some.select("file").distinct().collect()]
            source = rows.where(F.col("file").isin(names)) if names else rows.limit(0)
        steps = some.select("file", "step").distinct()
        at_block = some.select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("target").alias("shard"), "slot_from")
        stepped = source.join(small(steps), "file").withColumn("block", F.floor(F.col("at") / F.col("step")))
        told = stepped.join(small(at_block), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
        return told.select("row", "size", "home", "shard", (F.col("slot_from") + F.col("at") - F.col("block") * F.col("step")).alias("slot"), "file")

    moved = placed(True).drop("file")
    moved.hint("rebalance", "shard").write.partitionBy("shard").parquet(new)
    back = spark.read.schema(StructType([*[f for f in moved.schema.fields if f.name != "shard"], StructField("shard", IntegerType())])).parquet(new)
    want = {r["target"]: (r["bytes"], r["n"]) for r in pieces.where("changed").groupBy("target").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()}
    got = {r["shard"]: (r["bytes"], r["n"]) for r in back.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    if got != want:
        raise RuntimeError(f"planned (bytes, rows) by shard {want}, wrote {got}")
    columns = ["row", "size", "home", "shard", "slot", "file"]
    now = back.withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/", -2)).select(*columns, F.lit(False).alias("kept"))
    return placed(False).select(*columns, F.lit(True).alias("kept")).unionByName(now)
