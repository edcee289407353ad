import numpy as np
import pytest

from pagegrain.llm import maskedlm as lm

TEXTS = ["The cat sat. The cat ran!", "the DOG sat", "", None, "é ü the", "x" * 200_000, "word " * 3000]


def parameters(seed=3):
    rng = np.random.default_rng(seed)
    p = lm.start(rng.integers(0, 50, lm.SYMBOLS).astype(float))
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in p.items()}


def slow_log(p, context, target):
    h = np.tanh(p["lift"] + sum(p["window"][k][c] for k, c in enumerate(context)))
    k, m = divmod(int(target), lm.MEMBERS)
    a = h @ p["class_of"] + p["class_bias"]
    b = h @ p["member_of"][k] + p["member_bias"][k]
    return a[k] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())


def slow_ids(known, text):
    """One text's symbols, from single-word texts."""
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).split()
    return [int(known.ids([w])[0][0]) for w in words]


def known_words():
    h, _ = lm.words(["the cat sat"])
    return lm.Vocabulary([int(x) for x in h])


def test_symbols_do_not_depend_on_what_stands_around():
    known = known_words()
    ids, sizes = known.ids(TEXTS)
    cuts = np.cumsum([0, *sizes])
    for i, t in enumerate(TEXTS):
        if t is None or len(t) < 100_000:
            assert ids[cuts[i] : cuts[i + 1]].tolist() == slow_ids(known, t)
    assert ids[:3].tolist() == [lm.SHARED + 1, lm.SHARED + 2, lm.SHARED + 3]


def test_scores_match_a_plain_loop():
    p, known = parameters(), known_words()
    ids, sizes = known.ids(TEXTS)
    c, t, at = lm.windows(ids, sizes)
    fast = lm.log_probabilities(p, c, t)
    cuts = np.cumsum([0, *sizes])
    for i in range(len(TEXTS)):
        own = ids[cuts[i] : cuts[i + 1]]
        line = [0] * lm.SIDE + own.tolist() + [0] * lm.SIDE
        for j in range(min(len(own), 40)):
            near = line[j : j + lm.SIDE] + line[j + lm.SIDE + 1 : j + 2 * lm.SIDE + 1]
            assert c[:, cuts[i] + j].tolist() == near
            assert fast[cuts[i] + j] == pytest.approx(slow_log(p, near, own[j]), abs=1e-4)
        assert (at[cuts[i] : cuts[i + 1]] == i).all()


def test_probabilities_sum_to_one():
    p = parameters()
    context = np.tile(np.array([[1], [5], [900], [0]]), lm.SYMBOLS)
    assert np.exp(lm.log_probabilities(p, context, np.arange(lm.SYMBOLS))).sum() == pytest.approx(1, abs=1e-4)


def test_slopes_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in parameters().items()}
    c, t = rng.integers(0, lm.SYMBOLS, (2 * lm.SIDE, 50)), rng.integers(0, lm.SYMBOLS, 50)
    g = lm.slopes(p, c, t)
    for name in p:
        spot = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        low, high = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        low[name][spot] -= 1e-4
        high[name][spot] += 1e-4
        slope = -(lm.log_probabilities(high, c, t).mean() - lm.log_probabilities(low, c, t).mean()) / 2e-4
        assert g[name][spot] == pytest.approx(slope, rel=0.02)


def test_training_beats_frequencies_on_texts_it_has_not_seen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, other = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0").dropDuplicates(["text"])
    known, values = lm.train(seen, rounds=4)
    _, frequency = lm.vocabulary(seen)
    total = lambda v: lm.with_pseudo_likelihood(other, known, v).agg({"pll": "sum"}).first()[0]
    assert total(values) > total(lm.flat(lm.start(frequency)))


def test_nulls_repeats_names_and_nothing(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (2, "", 1.0), (None, "the cat", 1.0), (3, "the cat", 1.0)], "doc_id int, text string, pll double")
    known, values = lm.train(df)
    rows = lm.with_pseudo_likelihood(df, known, values).collect()
    assert len(rows) == 5
    assert [(r.n_tokens, r.pll, r.pll_mean) for r in rows if not r.text] == [(0, 0.0, None)] * 3
    a, b = [r for r in rows if r.text]
    assert a.pll == b.pll < 0 and a.pll_mean == a.pll / 2
    none = df.limit(0)
    known, values = lm.train(none)
    assert lm.with_pseudo_likelihood(none, known, values).count() == 0


def test_rare_words_have_their_share_and_unseen_ones_the_floor(spark, monkeypatch):
    # two own symbols: all other words share
    monkeypatch.setattr(lm, "SYMBOLS", lm.SHARED + 3)
    seen = ["a a a a a a a b b b b b b b", "rare rare rare once w1 w2 w3 w4 w5 w6 w7 w8 w9", "rare once two", "rare once two"]
    known, _ = lm.vocabulary(spark.createDataFrame([(t,) for t in seen], "text string").repartition(2))
    monkeypatch.undo()
    values = lm.flat(lm.start(np.ones(lm.SYMBOLS)))
    counts = {}
    for t in seen:
        for h in lm.words([t])[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    own = set(known.own)

    def within(text):
        total = 0.0
        for h in lm.words([text])[0].tolist():
            if h not in own:
                held = sum(n for w, n in counts.items() if w not in own and w % lm.SHARED == h % lm.SHARED)
                total += np.log(counts.get(h, 1) / (held + 1))
        return total

    texts = ["a rare once", "a rare once", "rare rare two w3", "zzqx qqzv", "a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = lm.with_pseudo_likelihood(df, known, values).collect()
    assert len(rows) == len(texts)
    bare = {r.text: r.pll for r in lm.with_pseudo_likelihood(df, lm.Vocabulary(known.own), values).collect()}
    for r in rows:
        assert r.pll == pytest.approx(bare[r.text] + (within(r.text) if r.text else 0), abs=1e-5)
    assert within("a rare once") < 0 and within("a b") == 0


@pytest.mark.parametrize("rounds", [lm.ROUNDS, 3, lm.MASK])
def test_the_rounds_together_mask_every_position_once(rounds):
    texts = ["one", "two words", "", None, "the same text", "a longer text of some more words than sixteen so that it goes round and round again", "x " * 999]
    known = known_words()
    ids, sizes = known.ids(texts)
    masked = [lm.windows(ids, sizes, turn, rounds) for turn in range(rounds)]
    assert (sum(np.bincount(at, minlength=len(sizes)) for _, _, at in masked) == sizes).all()
    assert sorted(np.concatenate([t for _, t, _ in masked]).tolist()) == sorted(ids.tolist())
    # a text's positions don't depend on its neighbours
    alone = [lm.windows(*known.ids(texts[5:6]), turn, rounds) for turn in range(rounds)]
    for (c, t, at), (c1, t1, _) in zip(masked, alone):
        assert (t[at == 5] == t1).all() and (c[:, at == 5] == c1).all()


def test_the_querys_own_rounds_beat_frequencies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, other = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0").dropDuplicates(["text"])
    known, values = lm.train(seen)
    _, frequency = lm.vocabulary(seen)
    total = lambda v: lm.with_pseudo_likelihood(other, known, v).agg({"pll": "sum"}).first()[0]
    assert total(values) > total(lm.flat(lm.start(frequency)))


def slow_query(texts):
    """The query's results in one process: one group, one step after another."""
    counts = {}
    for h in lm.words(texts)[0].tolist():
        counts[h] = counts.get(h, 0) + 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    top, places = [], set()
    for h in sorted(counts, key=lambda h: (-counts[h], signed(h)))[: lm.SYMBOLS - lm.SHARED - 1]:
        if h >> 64 - lm.TABLE_BITS not in places:
            places.add(h >> 64 - lm.TABLE_BITS)
            top.append(h)
    symbol = lambda h: top.index(h) + lm.SHARED + 1 if h in top else h % lm.SHARED + 1
    said = [lm.words([t])[0].tolist() for t in texts]
    held = [0] * (lm.SHARED + 1)
    for h, n in counts.items():
        if h not in top:
            held[h % lm.SHARED + 1] += n
    frequency = np.zeros(lm.SYMBOLS)
    frequency[1 : lm.SHARED + 1] = sum(held) / lm.SHARED
    frequency[lm.SHARED + 1 : lm.SHARED + 1 + len(top)] = [counts[h] for h in top]
    distinct = {}
    for s in said:
        if s:
            distinct[tuple(map(symbol, s))] = distinct.get(tuple(map(symbol, s)), 0) + 1
    return top, symbol, said, counts, held, frequency, distinct


def test_the_query_matches_a_slow_version(spark, tmp_path):
    from pagegrain.llm.queries import op5_masked_pseudo_likelihood

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) if x < 5000) for _ in range(120)]
    texts += texts[:30] + [None, "", "unique words only here", "twice said words", "twice said words", "long " * 3000]
    top, symbol, said, counts, held, frequency, distinct = slow_query(texts)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    packed = {s: np.array(s, "<u2").tobytes() for s in distinct}
    hashes = spark.createDataFrame([(bytearray(b),) for b in packed.values()], "s binary").selectExpr("s", "xxhash64(s) AS h").collect()
    order = {bytes(r.s): (r.h, bytes(r.s)) for r in hashes}
    ordered = sorted(distinct, key=lambda s: order[packed[s]])
    values = lm.flat(lm.start(frequency))
    ids, sizes, weights = np.concatenate([np.array(s) for s in ordered]), np.array([len(s) for s in ordered]), np.array([distinct[s] for s in ordered])
    for turn in range(lm.ROUNDS):
        values, _ = lm.fit_group(values, ids, sizes, weights, turn, lm.ROUNDS)
    p = lm.unflat(values)
    got = {r.doc_id: r for r in op5_masked_pseudo_likelihood(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(said):
        own = [symbol(h) for h in s]
        line = [0] * lm.SIDE + own + [0] * lm.SIDE
        want = sum(slow_log(p, line[j : j + lm.SIDE] + line[j + lm.SIDE + 1 : j + 2 * lm.SIDE + 1], own[j]) for j in range(len(own)))
        for h in s:
            if h not in top:
                want += np.log(max(counts[h] - s.count(h), lm.UNSEEN) / (held[h % lm.SHARED + 1] + 1 - s.count(h)))
        assert got[i].n_tokens == len(s) and got[i].pll == pytest.approx(want, rel=2e-3, abs=1e-2)


def test_partitions_and_order_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 700)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 400, rng.integers(0, 80))) for _ in range(60)] + ["one text many times"] * 50
    made = []
    for some, parts in ((texts, 1), (texts[::-1], 6)):
        known, values = lm.train(spark.createDataFrame([(t,) for t in some], "text string").repartition(parts))
        made.append((known.own, values))
    assert made[0][0] == made[1][0] and made[0][1] == pytest.approx(made[1][1], abs=1e-5)


def test_copies_are_dealt_evenly_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 50)
    texts = ["a b c d"] * 77 + ["e f"] * 2 + ["g"] + ["", None]
    known = known_words()
    packed, _ = lm.groups(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), known)
    total, most = {}, 0
    for r in packed.collect():
        ids, sizes, weights = np.frombuffer(r.symbols, "<u2"), np.frombuffer(r.sizes, np.int64), np.frombuffer(r.weights, np.int64)
        for part, w in zip(np.split(ids, np.cumsum(sizes)[:-1]), weights.tolist()):
            total[tuple(part.tolist())] = total.get(tuple(part.tolist()), 0) + w
            most = max(most, w)
    assert sorted(total.values()) == [1, 2, 77] and most <= 77 // 7 + 1


def test_a_text_does_not_vouch_for_its_own_words(spark):
    texts = ["common words here and there"] * 20 + ["zqa zqb zqc zqd zqe zqf"] + ["yqa yqb yqc yqd yqe yqf"] * 2
    rest = [f"w{i} w{i + 1}" for i in range(2500)]
    df = spark.createDataFrame([(t,) for t in texts + rest * 2], "text string")
    known, values = lm.train(df)
    pll = {r.text: r.pll for r in lm.with_pseudo_likelihood(df, known, values, of_corpus=True).collect()}
    assert pll["yqa yqb yqc yqd yqe yqf"] > pll["zqa zqb zqc zqd zqe zqf"] + 6 * np.log(20)
