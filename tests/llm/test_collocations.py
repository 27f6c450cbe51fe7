"""Phrases and quotient filters against plain Python."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from codecorpus.llm import collocations
from codecorpus.llm.quotient_filter import Packing, QuotientFilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """Rows of (lang, text) to (lang, rank, phrase, a, l, r, n, score)."""
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    covered = {(lang, g[i:j]) for (lang, g), c in found.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
               if j - i < len(g) and c >= f[lang, g[i:j]]}
    for (lang, g), a in found.items():
        if (lang, g) in covered:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]])
                             for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, rank = [], Counter()
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], *rest))
    return ranked


def corpus():
    rng = random.Random(3)
    voc = ["New", "york", "é", "the", "of", "state", "a", "b\x1c", "long", "run", "in", " ", "x" * 300]
    line = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    texts = [line(rng.randint(0, 40)) + rng.choice(". ,;\n:!?\t\r\x0b") + "In the long\trun the state of New York" for _ in range(60)]
    texts += ["", None, " \t\n ", "a", "Zz zz " * 300, "in the long run", *texts[:3]]
    return [(rng.choice(["en", "de", None, "und"]), t) for t in texts]


@pytest.mark.parametrize(("least", "top"), [(3, 20), (7, 2000)])
def test_phrases_match_brute_force(spark, least, top, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(7, t, lang, 1, 2) for lang, t in rows], "f long, text string, lang string, id long, at int")
    # small blocks, shards and bit tables, and texts cut into slices
    for name, size in (("BLOCK", 150), ("SHARD", 64), ("TABLE_BITS", 1 << 13), ("SLICE", 40)):
        monkeypatch.setattr(collocations, name, size)
    got = collocations.mine(docs.repartition(3), least=least, top=top).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, least, top))
    assert len(got) > 20


def test_tables_without_phrases(spark, empty):
    assert collocations.mine(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "one", "en")], "doc_id long, text string, lang string")
    assert collocations.mine(nulls).count() == 0 and collocations.mine(nulls, least=1).count() == 0


@pytest.mark.parametrize(("k", "bits"), [(1, 2), (2, 2), (2, 15), (3, 15), (3, 21), (4, 16), (4, 25), (5, 13), (5, 25)])
def test_quotient_filter_is_exact(k, bits):
    rng = np.random.default_rng(k * bits)
    p = Packing(k, bits)
    rows = rng.integers(0, min(1 << bits, 50), (5000, k)).astype(np.uint64)
    rows[::7] = rng.integers(0, 1 << bits, (len(rows[::7]), k))
    rows[:700] = (1 << bits) - 1
    left, right = p.pack(list(rows.T))
    assert (np.stack(p.unpack(*p.restore(*p.permute(left, right))), axis=1) == rows).all()
    want = Counter(map(tuple, rows.tolist()))
    prefix = min(3, p.left)
    shards = {}
    for part in np.array_split(rows, 4):
        for s, f in QuotientFilter.count(p, list(part.T)).shards(prefix):
            shards.setdefault(s, []).append(QuotientFilter.from_bytes(f.to_bytes(), p, prefix))
    got = Counter()
    for fs in shards.values():
        whole = QuotientFilter.merge(fs)
        again = QuotientFilter.from_bytes(whole.to_bytes(), p, prefix)
        assert (again.left == whole.left).all() and (again.counts == whole.counts).all()
        got.update(dict(zip(map(tuple, np.stack(again.ids(), axis=1).tolist()), again.counts.tolist())))
    assert got == want


def test_packing_has_a_bound():
    with pytest.raises(ValueError):
        Packing(5, 26)
