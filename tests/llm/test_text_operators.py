"""Near-dedup, line dedup, packing, token output, pieces and language model against brute force."""
import pickle
import time
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
import public_tokenizers as P
from pyspark.sql import functions as F

from codecorpus.llm import (graph, harmonic, katz, line_windows, simhash_vptree, suffix_pieces, tokens,
                            wavelet)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


# ------------------------------------------------------------------ SimHash
def test_simhash_matches_brute_force(odd, odd_texts):
    got = by_id(simhash_vptree.near_duplicates(odd))
    fps = [brute.simhash(t) for _, t in odd_texts]
    for (i, _), f, g in zip(odd_texts, fps, brute.groups(fps)):
        assert (got[i][0]["fingerprint"], got[i][0]["component_id"]) == (f"{f:016x}", odd_texts[g][0])


def test_simhash_keeps_one_of_each_group(odd, odd_texts):
    kept = simhash_vptree.keep_one(odd)
    assert kept.columns == odd.columns
    fps = [brute.simhash(t) for _, t in odd_texts]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({odd_texts[g][0] for g in brute.groups(fps)})


def test_simhash_edge_rows(twice, empty, odd_texts):
    got = by_id(simhash_vptree.near_duplicates(twice))
    assert len(got[3]) == 3 and len({tuple(r) for r in got[3]}) == 1
    # the null id's null text joins the empty texts, under their least id
    assert {r["component_id"] for r in got[None]} == {None, min(i for i, t in odd_texts if not brute.words(t))}
    assert simhash_vptree.near_duplicates(empty).count() == 0 and simhash_vptree.keep_one(empty).count() == 0
    ids = [r["doc_id"] for r in simhash_vptree.keep_one(twice).collect()]
    assert len(ids) == len(set(ids))


def test_vantage_point_search_finds_all_links():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 60, dtype=np.uint64)
    x = np.concatenate([rng.integers(0, 2**64, 900, dtype=np.uint64),
                        *[centres ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (25, 2))]])
    x = np.unique(x)
    label = simhash_vptree.forest(x, 2)
    assert label.tolist() == brute.groups([int(v) for v in x])
    tree = simhash_vptree.grow_tree(x[::3], 40, 2)
    i, j = np.nonzero(np.triu(simhash_vptree.distance(x[:, None], x[None, :]) <= 2, 1))
    leaves = [set() for _ in x]
    for leaf, rows in tree.deal(x):
        for r in rows:
            leaves[r].add(leaf)
    assert max(tree.leaf) > 5 and all(leaves[a] & leaves[b] for a, b in zip(i, j))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 150)}, 201: 200}


# ---------------------------------------------------------------- line dedup
def test_line_dedup_matches_brute_force(odd, odd_texts):
    got = by_id(line_windows.dedup_lines(odd, counts=True).drop("n_chars"))
    for i, want in brute.line_dedup(dict(odd_texts)).items():
        r = got[i][0]
        assert (r["n_lines"], r["n_removed"], r["text"]) == want
    assert sum(w[1] for w in brute.line_dedup(dict(odd_texts)).values()) > 20


def test_line_dedup_edge_rows_and_plan(twice, empty):
    out = line_windows.dedup_lines(twice)
    assert out.columns == twice.columns and out.count() == twice.count()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert len({tuple(r) for r in by_id(out)[3]}) == 1
    assert line_windows.dedup_lines(empty, counts=True).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


# ------------------------------------------------------------------- packing
def reference_ids(file, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(file))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_packing_holds_each_id_once_with_little_padding(twice):
    pieces = harmonic.pack(twice, P.path("word_bpe_49k.json"), with_ids=True)
    got = pieces.toPandas()
    texts = {}
    for r in twice.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for i, ts in texts.items():
        own = got[got["doc_id"].isna()] if i is None else got[got["doc_id"] == i]
        want = sorted(reference_ids("word_bpe_49k.json", t, 1).tobytes() for t in ts)
        assert own["length"].sum() == sum(len(w) // 4 for w in want)
        if len(ts) == 1:
            own = own.sort_values("start")
            assert b"".join(own["ids"]) == want[0]
            assert (own["start"] == own["length"].cumsum() - own["length"]).all() and (own["doc_tokens"] == len(want[0]) // 4).all()
            assert [zlib.crc32(x) for x in own["ids"]] == own["ids_crc32"].tolist()
    padding = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        total = int(s["length"].sum())
        assert total <= 2048 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 0.01 * got["length"].sum()
    assert harmonic.sequences(pieces).where("length > 2048").count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 682, 683, 1024, 1500, 2047, 2048, 2049, 9999])
def test_cut_adds_up_and_fits_its_class(n):
    parts = harmonic.cut(n, 2048)
    assert sum(length for length, _ in parts) == n and all(length * k <= 2048 for length, k in parts)


def test_packing_empty(empty):
    assert harmonic.pack(empty, P.path("word_bpe_49k.json")).count() == 0


# -------------------------------------------------------------- token output
def test_wavelet_digest_matches_the_library(odd, odd_texts):
    got, at = by_id(wavelet.digest(odd, P.path("byte_bpe_50k.json"))), 0
    for i, t in odd_texts:
        ids = reference_ids("byte_bpe_50k.json", t, 0)
        assert tuple(got[i][0]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_wavelet_edge_rows(twice, empty):
    got = wavelet.digest(twice, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert len(got) == twice.count() and got[0]["doc_id"] is None
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert wavelet.digest(empty, P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1), (64, 3), (129, 1 << 20), (3000, 50257)])
def test_wavelet_matrix_file(n, top):
    a = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    ids, lengths, m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(a).to_bytes(pa.array([7]), np.array([n])))
    assert ids.to_pylist() == [7] and lengths.tolist() == [n]
    assert (m.decode() == a).all() and (m.access(np.arange(n)) == a).all()
    for s in {*a[:4].tolist(), 7}:
        where = np.flatnonzero(a == s)
        assert m.count(s) == len(where) and (m.occurrences(s) == where).all()
        assert m.occurrences(s, n // 4, n // 2).tolist() == [x for x in where if n // 4 <= x < n // 2]


def test_wavelet_access_opens_few_pieces(monkeypatch):
    monkeypatch.setattr(wavelet, "PIECE", 4)
    a = np.random.default_rng(1).integers(0, 300, 20_000).astype("<u4")
    _, _, m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(a).to_bytes(pa.array([1]), np.array([len(a)])))
    assert not any(p.open for p in m.planes) and len(m.planes[0].before) > 70
    assert m.access(np.array([777])).tolist() == [a[777]] and all(len(p.open) == 1 for p in m.planes)
    assert m.count(5) == (a == 5).sum() and max(len(p.open) for p in m.planes) <= 4
    assert (m.occurrences(7) == np.flatnonzero(a == 7)).all() and (m.access(np.arange(0, 20_000, 37)) == a[::37]).all()


@pytest.mark.parametrize(("file", "units"), [("byte_bpe_50k.json", tokens.byte_units), ("word_bpe_49k.json", tokens.word_units)])
def test_unit_encoder_is_exact(file, units, odd_texts):
    texts = [t or "" for _, t in odd_texts] + ["x<|endoftext|>, y", "don't, 'q' (a).. c!!", "a  b   c\n\n d", "ÀÉ, İ, ſ, x́, α,", "1,2 b2."]
    small = tokens.UnitEncoder(P.path(file), units, memo=50)
    assert small.encode(texts) == [reference_ids(file, t, 0)[:-1].tobytes() for t in texts]


def test_matrix_moves_rows_faster_than_by_masks():
    a = np.random.default_rng(3).integers(0, 8192, 2_000_000).astype("<u4")

    def by_masks():
        cur = a.astype(np.uint16)
        for level in range(12, -1, -1):
            bit = ((cur >> np.uint16(level)) & np.uint16(1)).astype(bool)
            cur = np.concatenate([cur[~bit], cur[bit]])

    def best(f):
        out = []
        for _ in range(3):
            began = time.process_time()
            f()
            out.append(time.process_time() - began)
        return min(out)

    m = wavelet.WaveletMatrix.build(a)
    assert (m.decode() == a).all()
    slow = best(by_masks)
    assert best(lambda: wavelet.WaveletMatrix.build(a)) < 0.9 * slow and best(m.decode) < 0.9 * slow


@pytest.mark.parametrize(("file", "units"), [("byte_bpe_50k.json", tokens.byte_units), ("word_bpe_49k.json", tokens.word_units)])
def test_encoder_looks_a_unit_up_once_for_many_texts(file, units, odd_texts):
    class Counted(tokens.Memo):
        asked = 0

        def get(self, unit):
            self.asked += 1
            return dict.get(self, unit)

    e = tokens.UnitEncoder(P.path(file), units)
    e.memo = Counted(tokens.MEMO_BYTES)
    texts = ["one two\none, two", None, "", "two  one"] * 60 + [t for _, t in odd_texts]
    distinct = {u for t in texts if t for u in units(t)}
    want = {t: reference_ids(file, t or "", 0)[:-1].tobytes() for t in set(texts)}
    assert e.encode(texts[:240]) == [want[t] for t in texts[:240]]
    assert e.memo.asked <= len(distinct)
    assert e.encode(texts) == [want[t] for t in texts]


@pytest.mark.parametrize(("file", "units"), [("byte_bpe_50k.json", tokens.byte_units), ("word_bpe_49k.json", tokens.word_units)])
@pytest.mark.parametrize("memo", [0, 3000, tokens.MEMO_BYTES])
def test_memo_gives_the_same_ids_over_generations(file, units, memo):
    import tokenizers

    e, library = tokens.UnitEncoder(P.path(file), units, memo=memo), tokenizers.Tokenizer.from_file(P.path(file))
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    for at in [*range(0, 200, 20), *range(180, -1, -20)]:
        texts = [" ".join(words[at:at + 20]), ", ".join(words[at:at + 30]) + "..", "x" * 100, "", None]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert e.encode(texts) == [np.array(x, dtype="<u4").tobytes() for x in want]
        assert all(len(u) <= tokens.LONG_UNIT for u in e.memo) and len(e.memo.data) == len(e.memo)
        assert e.memo.size <= max(memo, 2 * tokens.ENTRY_BYTES)


def test_texts_are_encoded_by_the_thousand(monkeypatch):
    """A unit is looked up once for up to 1,024 texts, and long texts go in smaller pieces."""
    b = pa.record_batch({"text": ["a"] * 1500 + [None, "b" * 40, "c" * 40, "d"]})
    assert [p.num_rows for p in tokens.pieces(b)] == [1024, 480]
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 40)
    assert [p.num_rows for p in tokens.pieces(b.slice(1500))] == [2, 1, 1]
    assert not list(tokens.pieces(b.slice(0, 0)))
    e, asked = tokens.UnitEncoder(P.path("byte_bpe_50k.json"), tokens.byte_units), []
    monkeypatch.setattr(e, "_encode", lambda texts: asked.append(len(texts)) or [b""] * len(texts))
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 1 << 22)
    e.encode(["a b"] * 1024)
    assert asked == [1024]


# -------------------------------------------------------------------- pieces
def test_pieces_match_the_library_and_come_back(twice, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in suffix_pieces.encode(twice, P.path("piece_bpe_32k.model"), with_ids=True).join(
            twice.select("doc_id", "text").distinct(), "doc_id").collect():
        assert bytes(r["ids"]) == np.array(sp.encode(r["text"] or ""), dtype="<u4").tobytes() and r["round_trip"]
    assert suffix_pieces.encode(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_pieces_of_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["  a  b ", "a\nb", "\ta", "ﬁ Ａ é é", "<s> <0x41> </s>", "▁x", "a b", "\x00a", "the" * 900, " " * 700, "🙂🙂 ok", "\n\n a\n"]
    e = suffix_pieces.PieceEncoder(P.path("piece_bpe_32k.model"))
    got = e.encode(texts)
    assert got == [np.array(x, dtype="<u4").tobytes() for x in sp.encode(texts, num_threads=1)]
    assert [e.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


# ------------------------------------------------------------ language model
def test_katz_numbers_come_back_and_pack_tighter():
    rng = np.random.default_rng(5)
    codes = np.minimum(rng.zipf(1.2, 100_000), 1 << 18).astype(np.uint32)
    parts = [codes, b"word\nword", np.zeros(0, dtype=np.uint64), np.arange(20, dtype=np.int64)[::2], np.array([True, False]), b""]
    got = katz._unzip(katz._zip(*parts))
    for a, b in zip(got, parts, strict=True):
        assert a == b if isinstance(b, bytes) else a.dtype == b.dtype and a.tolist() == b.tolist()
    assert len(katz._zip(codes)) < 0.95 * len(zstandard.compress(pickle.dumps((codes,), protocol=5), 1))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize(("order", "small"), [(2, False), (3, False), (3, True), (4, True)])
def test_katz_matches_brute_force(odd, odd_texts, order, small, monkeypatch):
    if small:  # many blocks and shards, texts cut into slices, bit tables with chance hits
        for name, size in (("BLOCK", 200), ("SHARD", 100), ("SLICE", 64), ("TABLE_BITS", 1 << 13)):
            monkeypatch.setattr(katz, name, size)
    m = brute.Katz([t for i, t in odd_texts if not held(i)], katz.discounts, order)
    got = by_id(katz.score(odd, order=order))
    for i, t in odd_texts:
        r, toks = got[i][0], [*brute.words(t), None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(toks), m.n)
        assert r["n_known"] == sum(w in m.c1 for w in toks)
        assert r["score"] == pytest.approx(m.score(t), rel=1e-9)
        base = sum(np.log10((m.c1.get(w, 0) + 0.1) / (m.n + 0.1 * (m.v + 1))) for w in toks)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    for h in [("^",), *list(m.total)[:8], *[x for x in list(m.total) if len(x) == order - 1][:8]]:
        assert sum(m.p(w, h) for w in m.c1) + m.p("never seen", h) == pytest.approx(1)


def test_katz_tables_and_edge_rows(twice, empty, odd_texts):
    got = by_id(katz.score(twice))
    assert len(got[3]) == 3 and len({tuple(r) for r in got[3]}) == 1
    assert all(r["score"] < 0 for v in got.values() for r in v)
    assert katz.score(empty).count() == 0
    model, _, _ = katz.fit(twice, order=2)
    # every token but the starts ends one bigram
    assert model.table(2).agg(F.sum("count")).first()[0] == model.unigrams.tokens


def test_katz_scores_other_texts_by_its_tables(odd, odd_texts, spark):
    m = brute.Katz([t for i, t in odd_texts if not held(i)], katz.discounts, 3)
    model, _, _ = katz.fit(odd)
    others = ["", "one two three", odd_texts[4][1] + " never heard of", " ".join(odd_texts[7][1].split()[::-1])]
    # ids of the training fold too: the other texts are not learned from
    got = by_id(katz.score_with(model, spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")))
    assert all(got[i][0]["score"] == pytest.approx(m.score(t), rel=1e-9) for i, t in enumerate(others))


@pytest.mark.parametrize("kind", ["null", "training", "held out"])
def test_katz_tables_without_rows_of_a_kind(spark, kind):
    ids = [i for i in range(400) if kind == "null" or held(i) == (kind == "held out")][:30]
    texts = {i: None if kind == "null" else f"word and word{i % 3} and end" for i in ids}
    m = None if kind == "held out" else brute.Katz([t for i, t in texts.items() if not held(i)], katz.discounts, 3)
    got = by_id(katz.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert set(got) == set(ids)
    for i, t in texts.items():
        n = len(brute.words(t)) + 1
        assert (got[i][0]["n_tokens"], got[i][0]["n_known"], got[i][0]["held_out"]) == (n, 0 if kind == "held out" else n, held(i))
        # nothing is known without training rows, and the one unknown word has all the mass
        assert got[i][0]["score"] == pytest.approx(m.score(t) if m else 0.0, rel=1e-9)


def test_katz_frequent_pairs_are_one_entry_a_block(spark):
    """A pair in each of 3000 texts goes to its shard once a block, and its counts are right."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("of the").alias("text")).repartition(3)
    model, cut, (answers, _) = katz.fit(docs, order=2)
    n = sum(not held(i) for i in range(3000))
    assert {tuple(r["words"]): r["count"] for r in model.table(2).collect()} and set(
        r["count"] for r in model.table(2).collect()) == {n} and model.table(2).count() == 3
    # one answer a block and level: neither texts nor pairs add rows
    assert answers.count() <= 2 * cut.count()


def test_dense_groups_are_linked_in_linear_time():
    """Near copies that no vantage separates: as many as a large group has, in seconds; and the same links as all pairs."""
    import time

    rng = np.random.default_rng(4)

    def ball(n, most):
        flips = np.zeros(n, dtype=np.uint64)
        for _ in range(most):
            flips ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        return np.unique(flips ^ np.uint64(0x123456789ABCDEF))

    x = ball(1500, 5)
    label = np.arange(len(x))
    simhash_vptree._dense(x, np.arange(len(x)), 2, label)
    assert label.tolist() == brute.groups([int(v) for v in x])
    # one group of equal bytes larger than is compared in pairs
    y = np.unique(rng.integers(0, 1 << 16, 6000).astype(np.uint64))[::2]
    label = np.arange(len(y))
    simhash_vptree._dense(y, np.arange(len(y)), 1, label)
    assert label.tolist() == brute.groups([int(v) for v in y], 1)
    big = ball(200_000, 6)
    t = time.process_time()
    simhash_vptree.forest(big, 2)
    assert time.process_time() - t < 40


def test_texts_are_cut_into_lines_behind_the_join(spark, capsys):
    """What is shuffled to meet the repeated windows is the text, not its lines besides."""
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None)], "doc_id long, text string")
    out = line_windows.dedup_lines(docs)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\nb\nc\nd", 2: "x", 3: None}
    out.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert plan.index("AS __line_all") < plan.index("Join")
