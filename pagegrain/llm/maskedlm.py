"""Masked pseudo-likelihood by a bidirectional window network.

Every token is predicted from ``SIDE`` tokens on either side. The vocabulary
comes from counts over all texts: the most frequent words, told by 64-bit hash,
have a symbol of their own, the others share hashed ones. The network adds an embedding for
each place of the window, applies tanh, and gives the probability of the
token's class times that of the token within its class. A word of a shared
symbol has that symbol's probability times its share of the symbol's count,
from the counts of all words, which are joined in Spark; one count of each
symbol is kept for the words that were never seen.

Training is numpy on the executors. Texts, as symbols, are dealt by their own
hash into groups of about ``GROUP_TOKENS``, copies evenly over all groups, and
stand in each in the order of their hash, so neither the input's order nor its
partitions matter. In each of ``ROUNDS`` rounds every group starts from the same
parameters, masks its round's share of the positions of all its texts and fits
them. Positions are dealt to ``MASK`` shares and these to the rounds, so together
the rounds mask every position once (more than ``MASK`` rounds begin again). The
parameters' mean, weighted by examples and summed in whole numbers, is the next
round's start. What leaves a group is the model's size, whatever the text.

A text of the corpus itself is scored as the rest of the corpus has it: its own
occurrences of a word don't count towards that word's share, so words that stand
in no other text have ``UNSEEN`` of a count, however often this one repeats them.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-
cased. Texts without words, nulls among them, score 0 with a null mean.
Repeated rows are scored and counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from pagegrain.llm.common import map_columns, quoted, remove, slices, written
from pagegrain.llm.wordhash import word_hashes

SIDE = 2
CLASSES = 32
MEMBERS = 32
SYMBOLS = CLASSES * MEMBERS
SHARED = 128
TABLE_BITS = 20
WIDTH = 16
ROUNDS = 2
MASK = 16
BATCH = 4096
RATE = 0.2
CHUNK = 1 << 14
SCALE = 1 << 16
SHARE_SCALE = 1 << 24
GROUP_TOKENS = 1 << 20
UNSEEN = 1 / 64

_SHAPES = {
    "window": (2 * SIDE, SYMBOLS, WIDTH), "lift": (WIDTH,), "class_of": (WIDTH, CLASSES), "class_bias": (CLASSES,),
    "member_of": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS),
}


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, in order, and each text's count."""
    return word_hashes([(x or "").encode().lower() for x in texts])


class Vocabulary:
    """Symbol 0 is the space beyond a text's ends, then come shared symbols,
    then those of ``own``, the hashes of the most frequent words. ``counts``
    and ``wholes`` are the driver's tables of the other words' counts, (word,
    n), and of what all words of a symbol count and one more, (symbol, whole)."""

    def __init__(self, own: Sequence[int], counts: DataFrame | None = None, wholes: DataFrame | None = None) -> None:
        self.own, self.counts, self.wholes = list(own), counts, wholes
        # a table on the top bits finds a word's only candidate
        self._hash = np.zeros(SYMBOLS, np.uint64)
        self._hash[SHARED + 1 : SHARED + 1 + len(self.own)] = self.own
        self._at = np.zeros(1 << TABLE_BITS, np.int16)
        for symbol in range(SHARED + len(self.own), SHARED, -1):
            self._at[int(self._hash[symbol]) >> 64 - TABLE_BITS] = symbol

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None, "wholes": None}

    def ids(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' symbols, in order, and each text's count."""
        h, sizes = words(texts)
        return self.symbols(h), sizes

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbols of words told by hash."""
        found = self._at[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        shared = (h & np.uint64(SHARED - 1)).astype(np.int64) + 1
        return np.where((found > 0) & (self._hash[found] == h), found, shared)


Parameters = dict[str, np.ndarray]


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def unflat(values: np.ndarray) -> Parameters:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def start(frequency: np.ndarray, seed: int = 11) -> Parameters:
    """Small random embeddings; biases that give the symbols' frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(0, 0.1, s) if k in ("window", "class_of", "member_of") else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}
    share = (frequency + 0.5).reshape(CLASSES, MEMBERS)
    p["class_bias"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    p["member_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return p


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _log_sum(z: np.ndarray, tall: bool) -> np.ndarray:
    """Logarithm of the columns' summed exponentials; ``tall``: they may overflow."""
    top = z.max(axis=0) if tall else np.float32(0)
    return np.log(np.exp(z - top if tall else z).sum(axis=0)) + top


def _runs(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if cuts[c] < cuts[c + 1]:
            yield c, order[cuts[c] : cuts[c + 1]]


def log_probabilities(p: Parameters, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | context) of each token; context: (2 * SIDE, tokens)."""
    out = np.empty(len(target))
    # the hidden layer is within one, so logits are within the weights' sums
    most = max(np.abs(p[w]).sum(axis=-2).max() + np.abs(p[b]).max() for w, b in (("class_of", "class_bias"), ("member_of", "member_bias")))
    tall, class_of, member_of = bool(most > 80), p["class_of"].T.copy(), p["member_of"].transpose(0, 2, 1).copy()
    for at in range(0, len(target), CHUNK):
        order = np.argsort((target[at : at + CHUNK] // MEMBERS).astype(np.uint8), kind="stable")
        c, t = context[:, at : at + CHUNK][:, order], target[at : at + CHUNK][order]
        h = np.take(p["window"][0], c[0], axis=0)
        for k in range(1, 2 * SIDE):
            h += np.take(p["window"][k], c[k], axis=0)
        h += p["lift"]
        h = np.tanh(h, out=h).T
        z = class_of @ h + p["class_bias"][:, None]
        kind, member = t // MEMBERS, t % MEMBERS
        log = z[kind, np.arange(len(t))] - _log_sum(z, tall)
        cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            z = member_of[k] @ h[:, a:b] + p["member_bias"][k][:, None]
            log[a:b] += z[member[a:b], np.arange(b - a)] - _log_sum(z, tall)
        out[at + order] = log
    return out


def slopes(p: Parameters, context: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None) -> Parameters:
    """Gradient of the weighted mean negative log-probability."""
    n, g = len(target), {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    part = (np.full(n, 1 / n) if weight is None else weight / weight.sum()).astype(p["lift"].dtype)[:, None]
    h = np.tanh(p["lift"] + sum(p["window"][k][context[k]] for k in range(2 * SIDE)))
    kind, member = target // MEMBERS, target % MEMBERS
    d = _softmax(h @ p["class_of"] + p["class_bias"])
    d[np.arange(n), kind] -= 1
    d *= part
    g["class_of"], g["class_bias"] = h.T @ d, d.sum(0)
    back = d @ p["class_of"].T
    for k, rows in _runs(kind):
        d = _softmax(h[rows] @ p["member_of"][k] + p["member_bias"][k])
        d[np.arange(len(rows)), member[rows]] -= 1
        d *= part[rows]
        g["member_of"][k], g["member_bias"][k] = h[rows].T @ d, d.sum(0)
        back[rows] += d @ p["member_of"][k].T
    back *= 1 - h**2
    g["lift"] = back.sum(0)
    columns = np.ascontiguousarray(back.T)
    for k in range(2 * SIDE):
        for w in range(WIDTH):
            g["window"][k][:, w] = np.bincount(context[k], columns[w], SYMBOLS)
    return g


def windows(ids: np.ndarray, sizes: np.ndarray, turn: int | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context by place, target, number of the text) of every token, or of
    those that are masked in round ``turn`` of ``rounds``, which depend on
    their own text alone."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    here = np.arange(len(ids)) + SIDE * (text + 1)
    line = np.zeros(len(ids) + SIDE * (len(sizes) + 1), np.int64)
    line[here] = ids
    if turn is not None:
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        salt = np.bincount(text, ids, len(sizes)).astype(np.int64)[text]
        mix = (place + salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        some = mix % np.uint64(MASK) % np.uint64(min(rounds, MASK)) == turn % min(rounds, MASK)
        here, text = here[some], text[some]
    sides = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    return np.stack([line[here + s] for s in sides]) if len(here) else np.empty((2 * SIDE, 0), np.int64), line[here], text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), summed within each slice."""
    for batch in batches:
        for part in slices(batch, "t"):
            word, n = np.unique(words(part.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def _scaled(share: Column) -> Column:
    """A share's logarithm as a whole number, whose sums don't depend on order."""
    return F.rint(F.log(share) * SHARE_SCALE).cast("long")


def _symbol(word: Column) -> Column:
    """The shared symbol of a word without its own, as in ``Vocabulary.symbols``."""
    return (word.bitwiseAND(F.lit(SHARED - 1)) + 1).cast("int")


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, with the counts of all other words, and each symbol's count, from every text."""
    spark = docs.sparkSession
    counts, counts_at = written(
        docs.select(F.col(quoted(text)).alias("t")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    top, taken = [], set()
    for r in counts.orderBy(F.desc("n"), "word").limit(SYMBOLS - SHARED - 1).collect():  # bounded by the vocabulary
        # of words that one place of the table would have to hold, the rarer stays shared
        if (place := r["word"] % (1 << 64) >> 64 - TABLE_BITS) not in taken:
            taken.add(place)
            top.append(r)
    frequency = np.zeros(SYMBOLS)
    frequency[SHARED + 1 : SHARED + 1 + len(top)] = [r["n"] for r in top]
    own = spark.createDataFrame([(r["word"],) for r in top], "word long")
    others, _ = written(counts.join(F.broadcast(own), "word", "left_anti"), "shared-words")
    held = others.groupBy(_symbol(F.col("word")).alias("symbol")).agg(F.sum("n").alias("held"))
    every = spark.range(1, SHARED + 1).select(F.col("id").cast("int").alias("symbol")).join(held, "symbol", "left")
    wholes, _ = written(every.select("symbol", (F.coalesce("held", F.lit(0)) + 1).alias("whole")), "symbol-counts")
    frequency[1 : SHARED + 1] = wholes.agg(F.sum(F.col("whole") - 1)).first()[0] / SHARED
    remove(spark, counts_at)
    return Vocabulary([r["word"] % (1 << 64) for r in top], others, wholes), frequency


def _symbols(known: Vocabulary):
    """Arrow map from texts to (symbols, n): each text's symbols, packed, and
    how often it is one of its slice's texts; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                ids, sizes = known.ids(part.column(0).to_pylist())
                ends = np.cumsum(sizes)
                counts: dict[bytes, int] = {}
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    if a < b:
                        packed = ids[a:b].astype("<u2").tobytes()
                        counts[packed] = counts.get(packed, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["symbols", "n"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (group, weight, symbols) in order to one row a group: the symbols,
    sizes and weights of its texts."""
    now, held = None, []

    def row() -> pa.RecordBatch:
        sizes = np.array([len(x) // 2 for x, _ in held], np.int64)
        weights = np.array([w for _, w in held], np.int64)
        columns = [pa.array([x], pa.binary()) for x in (b"".join(x for x, _ in held), sizes.tobytes(), weights.tobytes())]
        return pa.RecordBatch.from_arrays(columns, names=["symbols", "sizes", "weights"])

    for batch in batches:
        for group, weight, symbols in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if group != now:
                if held:
                    yield row()
                now, held = group, []
            held.append((symbols, weight))
    if held:
        yield row()


def groups(docs: DataFrame, known: Vocabulary, text: str = "text") -> tuple[DataFrame, str]:
    """Written table of the training groups and its path."""
    spark = docs.sparkSession
    made = docs.select(F.col(quoted(text)).alias("t")).mapInArrow(_symbols(known), "symbols binary, n long")
    texts, texts_at = written(made.groupBy("symbols").agg(F.sum("n").alias("n")), "symbols")
    tokens = texts.agg(F.sum(F.col("n").cast("double") * F.octet_length("symbols") / 2)).first()[0] or 0
    count = max(1, int(-(-tokens // GROUP_TOKENS)))
    key = F.xxhash64("symbols")
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(count)) - 1))
    dealt = texts.select("symbols", "n", key.alias("h"), turn.alias("turn")).select(
        F.pmod(F.col("h") + F.col("turn"), F.lit(count)).alias("group"),
        (F.floor(F.col("n") / count) + (F.col("turn") < F.col("n") % count).cast("long")).alias("weight"), "symbols", "h",
    )
    sorted_ = dealt.repartition(count, "group").sortWithinPartitions("group", "h", "symbols").select("group", "weight", "symbols")
    packed = written(sorted_.mapInArrow(_pack, "symbols binary, sizes binary, weights binary"), "training-groups")
    remove(spark, texts_at)
    return packed


def fit_group(values: np.ndarray, ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, turn: int, rounds: int) -> tuple[np.ndarray, float]:
    """Parameters after a group's share of a round, and how much they weigh."""
    p = unflat(values)
    squares = {k: np.full(s, 1e-6, np.float32) for k, s in _SHAPES.items()}
    context, target, text = windows(ids, sizes, turn, rounds)
    weight = weights[text].astype(np.float64)
    for at in range(0, len(target), BATCH):
        part = slice(at, at + BATCH)
        for k, g in slopes(p, context[:, part], target[part], weight[part]).items():
            squares[k] += g * g
            p[k] -= RATE * g / np.sqrt(squares[k])
    return flat(p), float(weight.sum())


def _train(values: np.ndarray, turn: int, rounds: int):
    """Arrow map from groups to (place, sum): their parameters times their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbols, sizes, weights in zip(*(batch.column(i) for i in range(3))):
                ids = np.frombuffer(symbols.as_py(), "<u2").astype(np.int64)
                fitted, weight = fit_group(values, ids, np.frombuffer(sizes.as_py(), np.int64), np.frombuffer(weights.as_py(), np.int64), turn, rounds)
                if not weight:
                    continue
                total = np.rint(np.append(fitted.astype(np.float64), 1.0) * weight * SCALE).astype(np.int64)
                for at in range(0, len(total), 10_000):
                    some = total[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some)], names=["place", "total"])

    return run


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the network's parameters, trained on every text."""
    known, frequency = vocabulary(docs, text)
    values = flat(start(frequency))
    packed, packed_at = groups(docs, known, text)
    for turn in range(rounds):
        sums = packed.mapInArrow(_train(values, turn, rounds), "place int, total long").groupBy("place").agg(F.sum(F.col("total").cast("double")).alias("total")).toArrow()
        if not sums.num_rows:
            continue
        means = np.empty(len(values) + 1)
        means[sums.column("place").to_numpy()] = sums.column("total").to_numpy()
        values = (means[:-1] / means[-1]).astype(np.float32)
    remove(docs.sparkSession, packed_at)
    return known, values


def _shared_words(known: Vocabulary):
    """Arrow map from (key, t) to (key, word, n, copies): how often each word
    without its own symbol occurs in a text, for each text of a slice and the
    number of its copies there; and a row of each text with a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                keys, first, copies = np.unique(part.column(0).to_numpy(), return_index=True, return_counts=True)
                h, sizes = words(part.column(1).take(pa.array(first)).to_pylist())
                text = np.repeat(np.arange(len(sizes)), sizes)
                shared = known.symbols(h) <= SHARED
                h, text = h[shared], text[shared]
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.empty(0, np.int64)
                n = np.diff(np.append(begin, len(h)))
                nulls = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((keys[text[begin]], keys))), pa.concat_arrays([pa.array(h[begin].view(np.int64)), nulls]),
                        pa.array(np.concatenate((n, np.zeros(len(keys), np.int64)))), pa.array(np.concatenate((copies[text[begin]], copies))),
                    ],
                    names=["key", "word", "n", "copies"],
                )

    return run


def _share_sums(texts: DataFrame, known: Vocabulary, of_corpus: bool) -> DataFrame:
    """(__same, __within): for every key the summed logarithms of the shares that
    the words of one of its equal texts have of their symbols."""
    rows = texts.mapInArrow(_shared_words(known), "key long, word long, n long, copies long")
    table = known.counts.select(F.col("word").alias("w"), F.col("n").alias("held")).hint("shuffle_hash")
    wholes = known.wholes.select(F.col("symbol").alias("s"), "whole")
    said = rows.join(table, F.col("word") == F.col("w"), "left").join(F.broadcast(wholes), _symbol(F.col("word")) == F.col("s"), "left")
    if of_corpus:
        share = F.greatest(F.coalesce("held", F.lit(0)) - F.col("n"), F.lit(UNSEEN)) / (F.col("whole") - F.col("n"))
    else:
        share = F.coalesce("held", F.lit(1)) / F.col("whole")
    each = F.coalesce(F.col("copies") * F.col("n") * _scaled(share), F.lit(0))
    number = F.sum(F.when(F.col("word").isNull(), F.col("copies")))
    return said.groupBy(F.col("key").alias("__same")).agg((F.sum(each) / number / SHARE_SCALE).alias("__within"))


def with_pseudo_likelihood(df: DataFrame, known: Vocabulary, values: np.ndarray, text: str = "text", of_corpus: bool = False) -> DataFrame:
    """Adds n_tokens, pll (the sum of log-probabilities of all tokens) and
    pll_mean; input columns of those names are replaced. ``of_corpus``: the
    texts are those of the corpus, each as often as there."""

    def make():
        p = unflat(values)

        def work(texts: pa.Array):
            ids, sizes = known.ids(texts.to_pylist())
            c, t, at = windows(ids, sizes)
            return [sizes.tolist(), np.bincount(at, log_probabilities(p, c, t), len(sizes)).tolist()]

        return work

    key = F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit("")))
    scored = map_columns(df.withColumn("__key", key), [text], [("n_tokens", LongType(), pa.int64()), ("pll", DoubleType(), pa.float64())], make, weigh=text)
    pll = F.col("pll")
    if known.counts is not None:
        sums = _share_sums(df.select(key.alias("key"), F.col(quoted(text)).alias("t")), known, of_corpus)
        scored = scored.join(sums, F.col("__key") == F.col("__same"), "left").withColumn("pll", pll + F.coalesce("__within", F.lit(0.0))).drop("__same", "__within")
    return scored.drop("__key").withColumn("pll_mean", F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")))
