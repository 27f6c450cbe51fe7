"""N-gram Jaccard join against all pairs in plain Python."""
import random

import numpy as np
import pytest

from codecorpus.llm import ngram_join


def grams(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, percent=80):
    """[(n, group)] in the order of ``texts``; a group is named by its smallest index."""
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            c = len(x & sets[j])
            if c and 100 * c >= percent * (len(x) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(x), find(i)) for i, x in enumerate(sets)]


def family(rng, base, copies, edits):
    """Texts a few words away from ``base``."""
    out = []
    for _ in range(copies):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(11)
    voc = [f"w{i}" for i in range(300)]
    line = lambda n: [rng.choice(voc) for _ in range(n)]
    passage = line(60)
    texts = []
    for n in (8, 30, 90, 300):
        base = line(n)
        texts += family(rng, base, 40, max(1, n // 12))
        # drifting: each a little further from the first
        for _ in range(25):
            base = base[:]
            base[rng.randrange(n)] = f"d{rng.randrange(999)}"
            texts.append(" ".join(base))
    texts += [" ".join(line(rng.randint(1, 20)) + passage + line(rng.randint(0, 25))) for _ in range(60)]
    texts += [" ".join(line(rng.randint(0, 80))) for _ in range(60)]
    texts += ["a b", "a b", "A  b", "a b c d", "a b c d e", "", None, " \n", "x" * 3000, texts[0].upper(), texts[5], texts[5]]
    rng.shuffle(texts)
    return texts


def check(got, texts, percent=80):
    want = {i: (n, g) for i, (n, g) in enumerate(brute(texts, percent))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(texts)


@pytest.mark.parametrize("percent", [80, 55])
def test_join_matches_all_pairs(spark, percent, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK", 900)
    monkeypatch.setattr(ngram_join, "BUCKET", 3000)
    check(ngram_join.near_duplicates(docs.repartition(3), percent=percent).collect(), texts, percent)


def test_join_of_odd_texts(odd, odd_texts):
    check(ngram_join.near_duplicates(odd).collect(), [t for _, t in odd_texts])


def test_join_edge_rows(spark, twice, empty, odd_texts):
    rows = ngram_join.near_duplicates(twice).collect()
    assert len(rows) == twice.count() and len({tuple(r) for r in rows if r["doc_id"] == 3}) == 1
    # a null id is named by its text's other holders, and alone by nothing
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    copies = spark.createDataFrame([(None, "one two three"), (4, "One two  three"), (9, "one two three"), (9, "other")], "doc_id long, text string")
    got = sorted((r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(copies).collect())
    assert got == [(1, 4), (1, 4), (1, 4), (1, 9)]
    assert ngram_join.near_duplicates(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(nothing).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_messages_come_back():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 1 << 63, 999, dtype=np.uint64) * np.uint64(2))
    for n in (0, 1, 999):
        a, b, c = ngram_join._unpack(ngram_join._pack(x[:n], x[:n] % np.uint64(70000), np.zeros(n, dtype=np.uint64)), 3)
        assert (a == x[:n]).all() and (b == x[:n] % np.uint64(70000)).all() and not c.any()
