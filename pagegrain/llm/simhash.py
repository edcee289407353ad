"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into segments, one more than half the bits that
may differ, so at least one segment differs in at most one bit: two halves for
three bits, quarters for seven. Each segment is indexed whole, and once more
for each of its bits with that bit left out: segments that are equal meet under
the first key, segments one bit apart under exactly one of the others, on
opposite sides of the bit left out. Pairs that meet are verified on all 64 bits.

Only distinct fingerprints are indexed, so copies cost nothing. Each sorted
run of equal keys is reduced at once to a spanning forest, so what leaves a
task is linear in what entered it. A run over ``RUN_LIMIT`` is not compared
pairwise: it is indexed again by the same rule on the remaining bits.

``near_duplicates`` links fingerprints. ``one_of_each`` links texts: where
fingerprints of their distinct words are near, the share of five-word shingles
that two texts have in common decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pagegrain.llm.common import map_columns, quoted, remove, written
from pagegrain.llm.components import connected_components

SEED = 42
BITS = 64
MAX_BITS = 3
#: Above this, segments are too short to tell texts apart.
MOST_BITS = 15
RUN_LIMIT = 512
CHUNK = 1 << 16

#: Of ``one_of_each``: words of a shingle, the least Jaccard similarity, and the
#: bits in which fingerprints of distinct words may differ for it to be computed.
WIDTH = 5
SIMILARITY = 0.8
WORD_BITS = 7
#: Texts and shingles of one family that are compared in one group, about.
GROUP_TEXTS = 256
GROUP_SHINGLES = 1 << 19


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles in turn, repeats included.

    A-Z are lower-cased, words are runs of other characters than space and
    ``\\t``..``\\r``. Fewer words than ``width`` make one shingle; none, and
    nulls, give nothing.
    """
    # bytes.split() parts at exactly 0x20 and 0x09-0x0D, bytes.lower() maps exactly A-Z
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(gaps) + 1
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    if n > width:
        starts, ends = starts[: n - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())), np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The number whose bits are those set in over half of the hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for some in hashes:
        ones += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The SimHash of the text's word shingles, which count as often as they
    occur, unsigned; zero without words."""
    return majority(shingle_hashes(text, width, seed))


def word_fingerprint(text: str | None, seed: int = SEED) -> int:
    """The SimHash of the text's distinct words."""
    digest = xxhash.xxh64_intdigest
    return majority(iter([np.fromiter((digest(w, seed) for w in set((text or "").encode().lower().split())), np.uint64)]))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "simhash", of=fingerprint) -> DataFrame:
    """Adds ``out``: the 64 bits of each text's fingerprint ``of`` as a long. An
    input column of that name is replaced."""

    def make():
        def work(texts: pa.Array):
            made = np.fromiter((of(x) for x in texts.to_pylist()), np.uint64, len(texts))
            return [pa.array(made.view(np.int64))]

        return work

    return map_columns(df, [text], [(out, LongType(), pa.int64())], make, weigh=text)


def segments(most: int) -> list[range]:
    """Runs of bit positions, of which one differs in at most one bit where no
    more than ``most`` of all do."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"most must be from 0 to {MOST_BITS}")
    n = max(2, most // 2 + 1)
    return [range(BITS * i // n, BITS * (i + 1) // n) for i in range(n)]


#: A variant's key holds the segment's bits below this place, its number above.
KEY_PLACE = 32
KEY_STRIDE = 33


def variants(prints: DataFrame, column: str, most: int = MAX_BITS) -> DataFrame:
    """(key, side, print): each segment whole and with each one bit left out.

    key: segment number, the bit left out (the segment's length: none) and the
    segment's other bits. side: the bit left out, which must differ for a pair
    to count there.
    """
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(cut.start).alias("at"), F.lit(len(cut)).alias("size")) for n, cut in enumerate(segments(most))])
    bit = F.when(F.col("p") < F.col("c.size"), F.expr("shiftleft(1L, p)")).otherwise(F.lit(0).cast("long"))
    return (
        prints.select(F.col(column).alias("print"))
        .withColumn("c", F.explode(cuts))
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("c.size"))))
        .withColumn("value", F.expr("shiftrightunsigned(print, c.at)").bitwiseAND(F.expr("shiftleft(1L, c.size) - 1")))
        .select(
            (F.col("value").bitwiseAND(F.bitwise_not(bit)) + F.expr(f"shiftleft(CAST(c.n * {KEY_STRIDE} + p AS BIGINT), {KEY_PLACE})")).alias("key"),
            F.col("value").bitwiseAND(bit).__ne__(F.lit(0)).alias("side"),
            "print",
        )
    )


class Forest:
    """Disjoint sets of the numbers that met in one task, by smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def pairs_in_run(prints: np.ndarray, free: np.ndarray, most: int = MAX_BITS, again: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``most`` bits among distinct prints that can differ
    only in the bit positions ``free``, as aligned arrays.

    Up to RUN_LIMIT prints are compared directly. More are parted once by the
    bits of each of some groups of the free positions, whole or with one bit
    left out: at least one group differs in at most one bit. What still stays
    together is close in most bits, so its pairs are compared directly as well.
    """
    n = len(prints)
    if n <= RUN_LIMIT or not again:
        for lag in range(1, n):
            hit = _near(prints[lag:], prints[:-lag], most)
            if hit.any():
                yield prints[lag:][hit], prints[:-lag][hit]
        return
    for group in np.array_split(free, max(2, most // 2 + 1)):
        mask = np.bitwise_or.reduce(np.uint64(1) << group.astype(np.uint64))
        for out in (None, *group):
            wild = np.uint64(0) if out is None else np.uint64(1) << np.uint64(out)
            part = prints & mask & ~wild
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            for run in np.split(order, edges):
                if len(run) > 1:
                    yield from pairs_in_run(prints[run], free, most, False)


def link_runs(most: int):
    """Arrow map over rows sorted by key: edges of a spanning forest."""
    cuts = segments(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, edges = Forest(), []
        # rows of the last key, whose run may go on, in parts
        tail: list[tuple[np.ndarray, ...]] = []

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()):
                if forest.link(x, y):
                    edges.append((x, y))

        def settle(key: np.ndarray, side: np.ndarray, prints: np.ndarray) -> None:
            """Compares within runs of whole keys."""
            if len(key) < 2:
                return
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            sizes = np.diff(bounds)
            small = np.repeat(sizes <= RUN_LIMIT, sizes)
            number, left_out = np.divmod(key >> KEY_PLACE, KEY_STRIDE)
            whole = left_out == np.array([len(c) for c in cuts])[number]
            for lag in range(1, int(min(sizes.max(), RUN_LIMIT))):
                hit = small[lag:] & (key[lag:] == key[:-lag])
                if not hit.any():
                    break
                hit &= whole[lag:] | (side[lag:] != side[:-lag])
                hit &= _near(prints[lag:], prints[:-lag], most)
                if hit.any():
                    keep(prints[lag:][hit], prints[:-lag][hit])
            for i in np.flatnonzero(sizes > RUN_LIMIT):
                at = slice(bounds[i], bounds[i + 1])
                own, p = np.array(cuts[number[bounds[i]]]), int(left_out[bounds[i]])
                free = np.setdiff1d(np.arange(BITS), own)
                if p < len(own):
                    free = np.sort(np.append(free, own[p]))
                for a, b in pairs_in_run(prints[at], free, most):
                    keep(a, b)

        def settle_tail() -> None:
            if tail:
                settle(*(np.concatenate(x) for x in zip(*tail)))
                tail.clear()

        for batch in batches:
            key, side, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            prints = prints.view(np.uint64)
            if tail and tail[0][0][0] != key[0]:
                settle_tail()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                tail.append((key[:last], side[:last], prints[:last]))
                settle_tail()
            tail.append((key[last:], side[last:], prints[last:]))
            if edges:
                yield _edges(edges)
                edges.clear()
        settle_tail()
        if edges:
            yield _edges(edges)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_edges(prints: DataFrame, column: str, most: int = MAX_BITS) -> DataFrame:
    """(a, b): links that join exactly the prints that a chain of pairs within
    ``most`` bits joins. ``prints`` holds each print once."""
    rows = variants(prints, column, most)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(link_runs(most), "a long, b long")


def components(spark: SparkSession, prints: DataFrame, column: str, most: int = MAX_BITS) -> tuple[DataFrame, str]:
    """(print, component) for every print with a near one; others are absent."""
    edges, edges_at = written(near_edges(prints, column, most), "simhash-edges")
    found, found_at = connected_components(edges)
    remove(spark, edges_at)
    return found.select(F.col("node").alias("print"), "component"), found_at


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_BITS) -> DataFrame:
    """One row per input row: its key, ``simhash`` and ``component_id``, the
    smallest key that links of at most ``most`` differing bits reach.

    Empty and null texts have fingerprint zero and link like any other. A null
    key takes part but never names a component unless all its keys are null.
    Repeated rows stay repeated. Other columns do not follow.
    """
    spark = df.sparkSession
    prints, _ = written(with_fingerprint(df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))).select("key", "simhash"), "simhash")
    classes, classes_at = written(prints.groupBy("simhash").agg(F.min("key").alias("least")), "simhash-classes")
    linked, linked_at = components(spark, classes, "simhash", most)
    joined = classes.join(linked, classes["simhash"] == linked["print"], "left").select("simhash", "least", F.coalesce("component", "simhash").alias("component"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print, _ = written(joined.join(named, "component").select(F.col("simhash").alias("print"), "component_id"), "simhash-components")
    remove(spark, classes_at)
    remove(spark, linked_at)
    return prints.join(by_print, prints["simhash"] == by_print["print"]).select(F.col("key").alias(key), "simhash", "component_id")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of hashes, each sorted and distinct, have at least the
    Jaccard similarity ``least``; sets without members are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if not len(a):
        return True
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _link_group(rows: list[tuple[int, int, int, np.ndarray]], same_block: bool, most: int, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of similar texts, (block, text, print,
    shingles) each; of two blocks only pairs across are compared."""
    forest, edges = Forest(), []
    block = np.array([r[0] for r in rows])
    prints = np.array([r[2] for r in rows], np.int64).view(np.uint64)
    for i in range(1, len(rows)):
        near = _near(prints[:i], prints[i], most)
        if not same_block:
            near &= block[:i] != block[i]
        for j in np.flatnonzero(near).tolist():
            if forest.top(rows[i][1]) != forest.top(rows[j][1]) and similar(rows[i][3], rows[j][3], least):
                forest.link(rows[i][1], rows[j][1])
                edges.append((rows[i][1], rows[j][1]))
    return edges


def _compare(most: int, least: float):
    """Arrow map over (family, first block, second block, block, text, print,
    shingles), each group of the first three in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shingles = batch.column(6)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if row[:3] != now:
                    if edges := _link_group(held, now is not None and now[1] == now[2], most, least):
                        yield _edges(edges)
                    now, held = row[:3], []
                held.append((*row[3:], shingles[i].values.to_numpy()))
        if edges := _link_group(held, now is not None and now[1] == now[2], most, least):
            yield _edges(edges)

    return run


def similar_edges(texts: DataFrame, most: int = WORD_BITS, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links that join exactly the texts of a family that a chain of
    similar pairs joins. ``texts``: (family, name, print, shingles), each name once.

    A large family is dealt into blocks, and each pair of blocks is compared in
    a group of its own; pairs that are joined already are not compared.
    """
    sizes = texts.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("held"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_TEXTS), F.ceil(F.col("held") / GROUP_SHINGLES), F.lit(1)).cast("int")
    told = texts.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    each = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = each.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "print", "shingles")
    group = ("family", "i", "j")
    return dealt.repartition(*group).sortWithinPartitions(*group, "name").mapInArrow(_compare(most, least), "a long, b long")


def _with_shingles(df: DataFrame, width: int) -> DataFrame:
    def make():
        def work(texts: pa.Array):
            return [[np.unique(np.concatenate([*shingle_hashes(x, width), np.empty(0, np.uint64)])).view(np.int64) for x in texts.to_pylist()]]

        return work

    # sorted as unsigned, so that sets stay sorted when they are read back
    return map_columns(df, ["text"], [("shingles", ArrayType(LongType()), pa.list_(pa.int64()))], make, weigh="text")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = SIMILARITY, most: int = WORD_BITS) -> DataFrame:
    """The rows of ``df``, one of each group of near-duplicates: that of the
    smallest key, null keys last; all columns kept.

    Texts are linked whose distinct words have fingerprints at most ``most``
    bits apart and whose shingles of ``width`` words have at least the Jaccard
    similarity ``least``, or that are equal. Fewer words make one shingle; texts
    without words, nulls among them, are equal. Rows are told by key and text,
    and of rows that agree in both one stays. Equal texts are one text
    throughout, told by 128 bits of hash, shingles by 64.
    """
    spark = df.sparkSession
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    digest = F.unhex(F.md5(F.coalesce(F.col(quoted(text)), F.lit(""))))
    # never null, and structs with equal nulls are equal
    own = F.struct(F.col(quoted(key)).alias("k"), digest.alias("d")).alias("own")
    told = df.select(own, row.alias("row"))
    bare = df.select(own, F.col(quoted(text)).alias("text"))
    pairs, pairs_at = written(with_fingerprint(bare, of=word_fingerprint).groupBy("own").agg(F.first("simhash").alias("print"), F.count(F.lit(1)).alias("n")).select("own.*", "print", "n"), "simhash-texts")
    # the smallest key of each text, null only if there is no other
    classes, classes_at = written(
        pairs.groupBy("d").agg(F.first("print").alias("print"), F.min("k").alias("least")).withColumn("name", F.monotonically_increasing_id()), "simhash-classes"
    )
    prints = classes.groupBy("print").agg(F.count(F.lit(1)).alias("texts"))
    linked, linked_at = components(spark, prints, "print", most)
    family = prints.join(linked.withColumnRenamed("print", "p"), F.col("print") == F.col("p"), "left").where("texts > 1 OR component IS NOT NULL")
    family = family.select(F.col("print").alias("p"), F.coalesce("component", "print").alias("family"))
    members, members_at = written(classes.join(family, F.col("print") == F.col("p")).select("d", "least", "name", "print", "family"), "simhash-members")
    # members and what is told apart grow with the corpus: they are joined to the texts by
    # shuffle at every size, never broadcast
    at = members.select(F.struct(F.col("least").alias("k"), "d").alias("other"), "name", "print", "family").hint("merge")
    some = bare.join(at, F.col("own") == F.col("other")).select("family", "name", "print", "text")
    shingles, shingles_at = written(_with_shingles(some, width).select("family", "name", "print", "shingles").dropDuplicates(["name"]), "simhash-shingles")
    edges, edges_at = written(similar_edges(shingles, most, least), "simhash-edges")
    groups, groups_at = connected_components(edges)
    # of texts of one group, the one of the smallest key; of equal keys the smallest text
    rank = F.struct(F.col("least").isNull(), F.col("least"), F.col("d"))
    grouped = members.join(groups, F.col("name") == F.col("node")).groupBy("component").agg(F.min(rank).alias("first"))
    chosen = members.join(groups, F.col("name") == F.col("node")).join(grouped, "component").select(F.col("d").alias("gd"), F.col("first.d").alias("stays"))
    stays = F.col("gd").isNull() | (F.col("stays") == F.col("d"))
    by_text = classes.join(chosen, F.col("d") == F.col("gd"), "left").select(F.col("d").alias("cd"), "least", stays.alias("stays"))
    kept = F.col("stays") & F.col("k").eqNullSafe(F.col("least"))
    known = pairs.join(by_text, F.col("d") == F.col("cd")).select(F.struct("k", "d").alias("other"), kept.alias("kept"), "n")
    told_apart, _ = written(known.where("NOT kept OR n > 1"), "simhash-dropped")
    for path in (pairs_at, classes_at, linked_at, members_at, shingles_at, edges_at, groups_at):
        remove(spark, path)
    # the rows are dealt once for both joins
    same = F.col("own") == F.col("other")
    alone = told.join(told_apart.select("other").hint("merge"), same, "left_anti").select("row.*")
    repeated = told.join(told_apart.where("kept").select("other").hint("merge"), same, "left_semi").dropDuplicates(["own"]).select("row.*")
    return alone.unionByName(repeated)
