"""Preference formatting of chosen and rejected conversations.

A pair's conversations are aligned turn by turn. The turns before the first
that differs are the prompt, rendered once; from there on each side's turns
are its completion. Each rendered turn is one row with the span that counts in
the loss: text and end mark of assistant turns in completions, nothing else.
A pair of any number of turns is never gathered: ``assembled`` joins the rows to
one prompt and two completions for every ``PIECE_TURNS`` turns of a pair, so a
conversation of fewer turns is one row and a longer one has some, in order.

Of several rows for one side, pair and turn the least (role, text) counts, so
repeated rows count once. Null roles and texts count as empty, a null turn as
turn -1, a null pair is a pair. A pair without any difference is all prompt;
a pair with one side only has that side's turns as completion and no prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import quoted

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
PIECE_TURNS = 512


def _turns(side: DataFrame, name: str, pair: str, turn: str, role: str, text: str) -> DataFrame:
    said = F.struct(F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    return side.select(F.col(quoted(pair)).alias("pair_id"), F.coalesce(F.col(quoted(turn)).cast("long"), F.lit(-1)).alias("turn"), F.lit(name).alias("side"), said.alias("said"))


def aligned(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, turn, c, r): what either side said at each turn, else null."""
    both = _turns(chosen, "c", pair, turn, role, text).unionByName(_turns(rejected, "r", pair, turn, role, text))
    return both.groupBy("pair_id", "turn").agg(*[F.min(F.when(F.col("side") == s, F.col("said"))).alias(s) for s in ("c", "r")])


def formatted(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, part, turn, role, rendered, loss_from, loss_to): part is
    prompt, chosen or rejected; the span is in characters of ``rendered``, from
    the first to before the last, null where nothing counts."""
    rows = aligned(chosen, rejected, pair, turn, role, text)
    cuts = rows.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy(F.col("pair_id").alias("p")).agg(F.min("turn").alias("cut"))
    told = rows.join(cuts, F.col("pair_id").eqNullSafe(F.col("p")), "left")
    prompt = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))

    def entry(part: str, said: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), said.alias("said"))

    parts = F.when(prompt, F.array(entry("prompt", F.col("c")))).otherwise(F.array(entry("chosen", F.col("c")), entry("rejected", F.col("r"))))
    each = told.select("pair_id", "turn", F.explode(parts).alias("e")).select("pair_id", "turn", "e.part", "e.said").where(F.col("said").isNotNull())
    head = F.concat(F.lit(OPEN), F.col("said.role"), F.lit(BREAK))
    counts = (F.col("part") != "prompt") & (F.col("said.role") == ASSISTANT)
    return each.select(
        "pair_id", "part", "turn", F.col("said.role").alias("role"), F.concat(head, F.col("said.text"), F.lit(CLOSE)).alias("rendered"),
        F.when(counts, F.length(head)).alias("loss_from"), F.when(counts, F.length(head) + F.length("said.text") + len(CLOSE)).alias("loss_to"),
    )


def assembled(rows: DataFrame) -> DataFrame:
    """(pair_id, piece, prompt, chosen, rejected, chosen_loss, rejected_loss):
    the strings of each piece of a pair and the spans of both completions that
    count, in characters, in order. A null turn, which is -1, is in piece 0."""
    entry = F.struct("part", "turn", "rendered", "loss_from", "loss_to")
    piece = F.floor((F.col("turn") + 1) / PIECE_TURNS).alias("piece")
    packed = rows.groupBy("pair_id", piece).agg(F.array_sort(F.collect_list(entry)).alias("turns"))

    def string(part: str) -> Column:
        return F.expr(f"array_join(transform(filter(turns, t -> t.part = '{part}'), t -> t.rendered), '')").alias(part)

    def spans(part: str) -> Column:
        return F.expr(
            f"filter(aggregate(filter(turns, t -> t.part = '{part}'), struct(0 AS at, CAST(array() AS array<struct<a: int, b: int>>) AS spans), "
            "(s, t) -> struct(s.at + length(t.rendered) AS at, concat(s.spans, array(struct(s.at + t.loss_from AS a, s.at + t.loss_to AS b))) AS spans)).spans, x -> x.a IS NOT NULL)"
        ).alias(f"{part}_loss")

    return packed.select("pair_id", "piece", *[string(p) for p in ("prompt", "chosen", "rejected")], *[spans(p) for p in ("chosen", "rejected")])


def drafted(turns: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rejected counterparts of conversations, which part from them at another
    turn for each pair: by the pair's number modulo ``PARTINGS`` at turn 0, 1
    and so on, or, for the last remainder and null pairs, nowhere. From there on
    the assistant's texts are reversed, and at turn 0 all, up to ``MORE`` turns
    later, where the counterpart ends."""
    p, t, r, x = (F.col(quoted(c)) for c in (pair, turn, role, text))
    begin = F.pmod(p.cast("long"), F.lit(PARTINGS))
    parts = (begin < PARTINGS - 1) & (F.coalesce(t.cast("long"), F.lit(-1)) >= begin)
    worse = F.when(F.coalesce(parts & ((r == ASSISTANT) | (begin == 0)), F.lit(False)), F.reverse(x)).otherwise(x)
    ends = F.coalesce((begin < PARTINGS - 1) & (t.cast("long") > begin + MORE), F.lit(False))
    return turns.where(~ends).select(p.alias(pair), t.alias(turn), r.alias(role), worse.alias(text))


#: Of ``drafted``: how many ways to part there are, and turns that follow.
PARTINGS, MORE = 7, 3


def loss_text(spans: Column) -> Column:
    """Spans as text, such as ``3-17,40-62``."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"))), ",")


def oracle() -> str:
    """DuckDB SQL of the query over ``conversations``."""
    open_, close = OPEN, CLOSE.replace("\n", "' || chr(10) || '")
    sides = ", ".join(f"coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = '{p}'), '') AS {p}" for p in ("prompt", "chosen", "rejected"))
    spans = ", ".join(f"coalesce(string_agg(span, ',' ORDER BY turn) FILTER (WHERE part = '{p}'), '') AS {p}_loss" for p in ("chosen", "rejected"))
    return f"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ((conv_id % {PARTINGS}) + {PARTINGS}) % {PARTINGS} AS begin FROM conversations),
r AS (SELECT conv_id, turn, role, CASE WHEN begin < {PARTINGS - 1} AND turn >= begin AND (role = '{ASSISTANT}' OR begin = 0) THEN reverse(text) ELSE text END AS text
      FROM t WHERE coalesce(NOT (begin < {PARTINGS - 1} AND turn > begin + {MORE}), true)),
c1 AS (SELECT conv_id, turn, min((role, text)) AS c FROM t GROUP BY ALL),
r1 AS (SELECT conv_id, turn, min((role, text)) AS r FROM r GROUP BY ALL),
a AS (SELECT c1.conv_id, c1.turn, c, r FROM c1 LEFT JOIN r1 ON c1.conv_id IS NOT DISTINCT FROM r1.conv_id AND c1.turn = r1.turn),
k AS (SELECT conv_id, min(turn) FILTER (WHERE c IS DISTINCT FROM r) AS cut FROM a GROUP BY conv_id),
p AS (SELECT a.conv_id, a.turn, unnest(CASE WHEN cut IS NULL OR a.turn < cut THEN ['prompt'] ELSE ['chosen', 'rejected'] END) AS part, c, r
      FROM a JOIN k ON a.conv_id IS NOT DISTINCT FROM k.conv_id),
s AS (SELECT conv_id, turn, part, CASE WHEN part = 'rejected' THEN r ELSE c END AS s FROM p),
h AS (SELECT *, '{open_}' || s[1] || chr(10) AS head, CAST(floor((turn + 1) / {PIECE_TURNS}) AS BIGINT) AS piece FROM s WHERE s IS NOT NULL),
m AS (SELECT conv_id, piece, turn, part, s, length(head) AS head, head || s[2] || '{close}' AS rendered FROM h),
w AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, piece, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM m),
x AS (SELECT *, CASE WHEN s[1] = '{ASSISTANT}' THEN CAST(upto + head AS VARCHAR) || '-' || CAST(upto + length(rendered) AS VARCHAR) END AS span FROM w)
SELECT conv_id AS pair_id, piece, {sides}, {spans} FROM x GROUP BY conv_id, piece
"""
