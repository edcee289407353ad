import re

import numpy as np
import pytest
import xxhash

from pagegrain.llm import components, simhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slow_fingerprint(text, width=3):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    if not w:
        return 0
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_word_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in set(WORDS.findall((text or "").encode().translate(LOWER)))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_shingles(text, width=5):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def slow_similarity(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def slow_groups(texts, bits=7, least=0.8):
    """For each text the number of the first one of its group, and the pairs
    that are similar, whatever their fingerprints."""
    prints, sets = [slow_word_fingerprint(t) for t in texts], [slow_shingles(t) for t in texts]
    top, pairs = list(range(len(texts))), []

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    held = {}
    for i, s in enumerate(sets):
        for j in sorted({j for x in s for j in held.get(x, ())} | {j for j in range(i) if not s and not sets[j]}):
            if slow_similarity(s, sets[j]) >= least:
                pairs.append((j, i))
                if bin(prints[i] ^ prints[j]).count("1") <= bits:
                    a, b = root(i), root(j)
                    top[max(a, b)] = min(a, b)
        for x in s:
            held.setdefault(x, []).append(i)
    return [root(i) for i in range(len(texts))], pairs


def slow_components(prints, most=3):
    top = {i: i for i in range(len(prints))}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "A", "a b", "One two THREE", "é É x y z " * 30, "w\x0bv\x0cu\x1ct", "the same the same the same the same", "word " * 70000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def random_prints(n, centres, flips, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(base[rng.integers(centres)])
        for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


def test_word_fingerprints():
    for text in (None, "", "A", "one Two two ONE three", "é É\x0bx " * 30):
        assert simhash.word_fingerprint(text) == slow_word_fingerprint(text)


@pytest.mark.parametrize(
    "n, centres, flips, limit, most",
    [(300, 40, 5, 512, 3), (400, 2, 4, 512, 3), (400, 2, 4, 16, 3), (600, 1, 3, 32, 3), (50, 50, 0, 512, 3), (300, 30, 8, 512, 7), (400, 2, 7, 16, 7), (300, 40, 6, 512, 4), (300, 10, 13, 32, 12), (60, 5, 2, 512, 0)],
)
def test_no_link_is_lost(spark, monkeypatch, n, centres, flips, limit, most):
    # a small limit makes long runs be indexed again; tasks read it from the module
    monkeypatch.setattr(simhash, "RUN_LIMIT", limit)
    prints = random_prints(n, centres, flips, n)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = sorted(simhash.variants(spark.createDataFrame([(s,) for s in signed], "p long"), "p", most).toPandas().itertuples(index=False))
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"key": [r.key for r in part], "side": [r.side for r in part], "print": [r.print for r in part]}) for part in (rows[i : i + 997] for i in range(0, len(rows), 997))]
    edges = [e for b in simhash.link_runs(most)(iter(batches)) for e in zip(*[c.to_pylist() for c in b.columns])]
    want = slow_components(prints, most)
    forest = simhash.Forest()
    for a, b in edges:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= most
        forest.link(a, b)
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(forest.top(s), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))
    assert len(edges) <= len(prints)


def test_query_matches_brute_force(spark, sf):
    from pagegrain.llm.queries import op2_simhash_near_dedup

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [slow_fingerprint(t) for _, t in docs]
    want = slow_components(prints)
    got = {r.doc_id: r for r in op2_simhash_near_dedup(spark, sf).collect()}
    assert len(got) == len(docs)
    for (key, _), p, c in zip(docs, prints, want):
        assert (got[key].fingerprint, got[key].component_id) == (f"{p:016x}", docs[c][0])


def test_nulls_empties_repeats_and_names(spark):
    rows = [(5, "", 1), (3, None, 2), (None, "  ", 3), (7, "a b c d e f", 4), (7, "a b c d e f", 4), (9, "a b c d e f", 5), (None, "other words stand in here", 6)]
    df = spark.createDataFrame(rows, "doc_id int, text string, component int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7]
    unique = df.where("doc_id IN (5, 3, 9)")
    assert sorted(r.doc_id for r in simhash.one_of_each(unique).collect()) == [3, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    found, _ = components.connected_components(spark.createDataFrame(chain, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    none, _ = components.connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_bits_that_segments_cannot_tell_apart_are_refused(spark):
    # two bits apart in each half: neither half meets, but one of three segments does
    prints = spark.createDataFrame([(0,), (0b11 << 32 | 0b11,)], "p long")
    assert simhash.near_edges(prints, "p").count() == 0
    assert simhash.near_edges(prints, "p", 4).count() == 1
    for most in (-1, simhash.MOST_BITS + 1):
        with pytest.raises(ValueError, match="most must be"):
            simhash.near_edges(prints, "p", most)


def copies(seed, families=30, least=1, most=12):
    """Texts of random words, some of them edited copies of each other."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(families):
        words = rng.choice(vocabulary, rng.integers(3, 120)).tolist()
        for _ in range(rng.integers(least, most)):
            own = list(words)
            for _ in range(rng.integers(0, max(1, len(words) // 25) + 1)):
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            texts.append(" ".join(own))
            words = own if rng.random() < 0.3 else words
    return texts


@pytest.mark.parametrize("seed, group", [(1, 256), (2, 5)])
def test_one_of_each_matches_brute_force(spark, monkeypatch, seed, group):
    # small groups deal a family into blocks
    monkeypatch.setattr(simhash, "GROUP_TEXTS", group)
    texts = copies(seed) + ["", None, " \t", "a", "A", "a b", "x " * 9000, "x " * 9001]
    want, _ = slow_groups(texts)
    assert len(set(want)) < len(texts) - 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted(set(want))


def test_most_similar_pairs_are_found(spark, sf):
    import os

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{os.path.dirname(sf)}/sf0.01/documents.parquet").collect())
    want, pairs = slow_groups([t for _, t in rows])
    met = sum(want[a] == want[b] for a, b in pairs)
    assert len(pairs) > 50 and met >= 0.9 * len(pairs)
    kept = {r.doc_id for r in simhash.one_of_each(spark.read.parquet(f"{os.path.dirname(sf)}/sf0.01/documents.parquet")).collect()}
    assert kept == {rows[i][0] for i in set(want)}


def test_one_of_each_with_clashing_names_nulls_and_repeats(spark):
    shape = "doc_id long, text string, k int, s int, __k int, name int, d int, print int, row int, simhash int, n int, kept int"
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words stand in here now"), (None, "other words stand in here now"), (None, None), (None, ""), (None, "only without a key"), (None, "only without a key"), (2, "A b c d e f")]
    df = spark.createDataFrame([(*r, *range(10)) for r in rows], shape)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(2, "A b c d e f"), (7, "other words stand in here now"), (None, ""), (None, "only without a key")], key=str)
    assert simhash.one_of_each(df.limit(0)).count() == 0
