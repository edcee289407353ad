import random

from pagegrain.llm import preference

TURN = "conv_id long, turn long, role string, text string"


def slow(chosen, rejected):
    """Rendered strings and spans of each pair, in plain Python."""

    def sides(rows):
        out = {}
        for key, turn, role, text in rows:
            said = (role or "", text or "")
            seen = out.setdefault(key, {})
            t = -1 if turn is None else turn
            seen[t] = min(seen.get(t, said), said)
        return out

    a, b = sides(chosen), sides(rejected)
    result = {}
    for key in a.keys() | b.keys():
        x, y = a.get(key, {}), b.get(key, {})
        turns = sorted(x.keys() | y.keys())
        cut = next((t for t in turns if x.get(t) != y.get(t)), None)

        def render(side, keep):
            text, spans = "", []
            for t in turns:
                if keep(t) and t in side:
                    role, said = side[t]
                    head = f"<|im_start|>{role}\n"
                    if role == "assistant":
                        spans.append((len(text) + len(head), len(text) + len(head) + len(said) + len("<|im_end|>\n")))
                    text += head + said + "<|im_end|>\n"
            return text, spans

        before = lambda t: cut is None or t < cut
        after = lambda t: not before(t)
        result[key] = (render(x, before)[0], *render(x, after), *render(y, after))
    return result


def got(spark, chosen, rejected):
    rows = preference.formatted(spark.createDataFrame(chosen, TURN), spark.createDataFrame(rejected, TURN))
    out = preference.assembled(rows).collect()
    return {r.pair_id: (r.prompt, r.chosen, [tuple(s) for s in r.chosen_loss], r.rejected, [tuple(s) for s in r.rejected_loss]) for r in out}


def test_random_pairs(spark):
    rng = random.Random(4)
    chosen, rejected = [], []
    for key in range(60):
        turns = [(key, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "b é", ""])) for t in range(rng.randrange(0, 7))]
        cut = rng.randrange(0, len(turns) + 1)
        chosen += turns
        rejected += turns[:cut] + [(key, t, "assistant", f"r{t}") for t in range(cut, cut + rng.randrange(0, 3))]
    rng.shuffle(chosen)
    assert got(spark, chosen, rejected) == slow(chosen, rejected)


def test_nulls_repeats_one_side_and_nothing(spark):
    chosen = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "n"), (2, None, "assistant", "z"), (2, 0, "user", "u"), (3, 0, "assistant", "only")]
    rejected = [(1, 0, "user", ""), (1, 1, "assistant", "y"), (None, 0, "user", "n"), (2, None, "assistant", "w"), (2, 0, "user", "u")]
    assert got(spark, chosen, rejected) == slow(chosen, rejected)
    assert got(spark, [], []) == {}


def test_drafts_part_at_every_turn_and_nowhere(spark):
    turns = [(key, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {key}") for key in range(14) for t in range(8)]
    turns += [(None, 0, "user", "no key"), (None, 1, "assistant", "still none"), (21, None, "assistant", "no turn")]
    rejected = [tuple(r) for r in preference.drafted(spark.createDataFrame(turns, TURN)).collect()]
    by = {k: {t: x for c, t, _, x in rejected if c == k} for k in [*range(14), None, 21]}
    for key in range(14):
        begin = key % preference.PARTINGS
        own = {t: x for c, t, _, x in turns if c == key}
        if begin == preference.PARTINGS - 1:
            assert by[key] == own
            continue
        assert max(by[key]) == min(7, begin + preference.MORE)
        assert all((by[key][t] != own[t]) == (t >= begin and (t % 2 == 1 or begin == 0)) for t in by[key])
    assert by[None] == {0: "no key", 1: "still none"} and by[21] == {None: "no turn"}
    assert got(spark, turns, rejected) == slow(turns, rejected)


def test_long_texts_and_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(preference, "PIECE_TURNS", 4)
    turns = [(1, t, ["user", "assistant"][t % 2], "x" * (200_000 if t == 5 else t)) for t in range(11)]
    worse = [(k, t, r, x + "!" if t >= 6 else x) for k, t, r, x in turns]
    rows = preference.assembled(preference.formatted(spark.createDataFrame(turns, TURN), spark.createDataFrame(worse, TURN))).orderBy("piece").collect()
    whole = slow(turns, worse)[1]
    assert [r.piece for r in rows] == [0, 1, 2]
    assert ("".join(r.prompt for r in rows), "".join(r.chosen for r in rows), "".join(r.rejected for r in rows)) == (whole[0], whole[1], whole[3])
    cut = lambda name: [getattr(r, name)[a:b] for r in rows for a, b in getattr(r, name + "_loss")]
    assert cut("chosen") == [whole[1][a:b] for a, b in whole[2]] and cut("rejected") == [whole[3][a:b] for a, b in whole[4]]


def test_clashing_names(spark):
    more = ", pair_id long, c string, r string, side string, part string, cut long, piece int"
    rows = [(1, 0, "user", "q", 9, "c", "r", "s", "p", 3, 4), (1, 1, "assistant", "a", 9, "c", "r", "s", "p", 3, 4)]
    df = spark.createDataFrame(rows, TURN + more)
    pair = preference.assembled(preference.formatted(df, preference.drafted(df))).collect()
    assert [(r.pair_id, r.prompt, r.chosen_loss) for r in pair] == [(1, "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n", [])]
