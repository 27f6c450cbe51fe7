"""Fill-in-middle against plain Python: cuts, forms, digests and the way back."""
import hashlib
import re

import numpy as np
import pytest

from codecorpus.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i:i + 8], 16) for i in (0, 8, 16, 24))
    k = TOKEN.findall(text)
    a, b = sorted((h1 % (len(k) + 1), h2 % (len(k) + 1)))
    p, m, s = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(k), "plain", None, None, text
    if h4 % 100 < 80:
        return len(k), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(k), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted((str(i), *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in texts)
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want


def test_fill_middle_matches_brute_force(twice, odd_texts):
    texts = [*odd_texts, odd_texts[3], odd_texts[3], (None, "null id text here"), (None, None)]
    check([tuple(r) for r in fill_middle.digest(twice).collect()], texts)


def test_fill_middle_markers_and_odd_spaces(spark, empty):
    texts = [(i, t) for i, t in enumerate(
        ["a <P> b c", "x<S>", "< P> <<S <M", "<", " \n", "a b  c", "你好 世界 !", "퟿ \U0001f642\U0001f642 z", "a\x1cb \x85 c"] * 6)]
    got = fill_middle.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check([tuple(r) for r in got], texts)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.digest(empty).count() == 0


def test_output_goes_back_to_the_text(odd, odd_texts):
    back = fill_middle.transform(odd).select("doc_id", fill_middle.restored().alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in odd_texts}


@pytest.mark.parametrize(("n", "widest"), [(0, 1), (1, 9), (2000, 9), (30_000, 400), (5000, 1)])
def test_rank_index_is_exact_and_bounded(n, widest):
    rng = np.random.default_rng(n + widest)
    y = np.concatenate([[0], np.cumsum(rng.integers(1, widest + 1, n))])
    y[len(y) // 2:] += 100_000  # a very long word
    index = fill_middle.RankIndex.build(y)
    assert (index.offset(np.arange(len(y))) == y).all()
    assert np.abs(index.residual).max() <= fill_middle.EPS + 1 and index.residual.dtype == np.int8
    if n == 2000:
        assert len(index.first) < 40
