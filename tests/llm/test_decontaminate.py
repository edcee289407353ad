import random
import re

import pytest

from pagegrain.llm import decontaminate


def slow(docs, items, width=5, threshold=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for key, text in docs:
        for item, want in items:
            w = cut(want)
            n = min(width, len(w))
            if not n:
                continue
            s = runs(w, n)
            hit = len(s & runs(cut(text), n))
            if hit >= threshold * len(s) - 1e-9:
                out.add((key, item, hit, len(s)))
    return out


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_key, r.item_id, r.matched, r.item_shingles) for r in decontaminate.contaminated(d, i, **how).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 9, 30, 64])))) for i in range(40)]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary, k=rng.randrange(0, 300))
        for _ in range(rng.randrange(0, 3)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = passage
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    want = slow(docs, items)
    assert want and found(spark, docs, items) == want


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = [(1, "x a b c d e f g y"), (2, "a b c d e")], [(1, "a b c d e f g"), (2, "a b c d e")]
    assert found(spark, docs, items) == slow(docs, items)


def test_nulls_empties_repeats(spark):
    docs = [(1, None), (2, ""), (None, "p q r s t u"), (3, "p q r s t u"), (3, "p q r s t u"), (4, "!!!")]
    items = [(7, "P, Q; r s t u"), (7, "P, Q; r s t u"), (8, None), (9, "..."), (None, "r s t u")]
    assert found(spark, docs, items) == {(None, 7, 2, 2), (3, 7, 2, 2), (None, None, 1, 1), (3, None, 1, 1)}
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()


def test_clean_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "p q r s t u", 1), (None, "fine text of some words", 2), (None, "p q r s t u", 3)], "doc_id long, text string, doc_key int")
    items = spark.createDataFrame([(7, "p q r s t u")], "item_id long, text string")
    assert [(r.doc_id, r.doc_key) for r in decontaminate.clean(df, items).collect()] == [(None, 2)]


@pytest.mark.parametrize("threshold", [0, 1.5])
def test_bad_threshold(spark, threshold):
    with pytest.raises(ValueError):
        found(spark, [], [], threshold=threshold)
