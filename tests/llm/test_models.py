"""Classifiers, nearest neighbours and the pipeline."""
import random
import zlib

import brute
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from codecorpus.llm import nn_descent, quality_gbt, rule_ensemble, toxicity_pu, trees
from codecorpus.llm import queries as Q

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled_docs(spark):
    """Prose with planted insults and shouted junk, labelled, one label in five wrong-typed or null."""
    rng = random.Random(1)
    voc = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(voc) for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grobling", "snarkface", "zonkbrain"]) + rng.choice(["", "s", "er"]))
        if junk:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w) + ".", None, "s", 0.1))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(None, None, None, None, None), (900, "", None, None, None), (901, None, None, None, None), docs[10]]
    labels += [(None, 1, 1), (3, None, None), (902, 5, 9), labels[8]]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def check_scores(out, n):
    rows = out.toPandas()
    assert len(rows) == n and rows["score"].between(0, 1).all() and rows["held_out"].isin([True, False]).all()
    ids = rows["doc_id"].dropna().astype(int)
    assert (rows.loc[ids.index, "held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]).all()
    return rows


def test_toxicity_held_out(labelled_docs):
    docs, labels = labelled_docs
    model = toxicity_pu.fit(docs, labels)
    rows = check_scores(toxicity_pu.score(docs, model), 504)
    held = rows[rows["held_out"] & (rows["doc_id"] < 500)]
    assert (held["predicted"] == (held["doc_id"] % 7 == 0)).mean() > 0.97
    assert (rows[rows["doc_id"] >= 900]["predicted"] == 0).all()
    kept = toxicity_pu.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == (rows["predicted"] == 0).sum()


def test_toxicity_scores_by_definition(labelled_docs, spark):
    """The score is the logistic of the summed weights of the features that a text holds; long, odd and empty texts too."""
    import re

    docs, labels = labelled_docs
    model = toxicity_pu.fit(docs, labels)
    weight = dict(zip(model.names, model.weights))
    texts = ["", None, "Grobling! grobling, snarkfaces 12 zonkbrain_s", "é" * 40, "a\x1cb " * 30_000 + "grobling", "z" * 200_000,
             *[r["text"] for r in docs.limit(40).collect()]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity_pu.score(d, model).collect()}
    for i, t in enumerate(texts):
        words = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        held = {f for w in words for f in [w, *(w[:k] + "*" for k in (3, 4, 5, 6) if len(w) > k)]}
        margin = sum(weight.get(f, 0.0) for f in held) + model.intercept
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_quality_of_long_and_repeated_texts(labelled_docs, spark):
    docs, labels = labelled_docs
    model = rule_ensemble.fit(docs, labels)
    texts = ["word " * 200_000, "x" * 500_000, "line of a few words\n" * 30_000, "", None, "same text", "same text"]
    rows = rule_ensemble.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).toPandas()
    assert len(rows) == len(texts) and rows["score"].between(0, 1).all() and rows["score"][5] == rows["score"][6]


def test_non_negative_risk_turns_back():
    """Where the unlabelled risk falls below the prior's share, the step is reversed."""
    one = lambda n: (np.arange(n), np.zeros(n, dtype=np.int64), n)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 5)
    w = np.array([6.0])
    up, _ = toxicity_pu.pu_risk_step(w, -6.0, one(5), none, 0.5)
    assert up[0] >= 0  # overfitted: the weight is not driven higher
    down, _ = toxicity_pu.pu_risk_step(np.array([0.0]), 0.0, one(5), none, 0.1)
    assert down[0] < 0


def test_classifiers_without_labels(labelled_docs, spark, empty):
    docs, labels = labelled_docs
    none = labels.where("false")
    assert toxicity_pu.score(docs, toxicity_pu.fit(docs, none)).where("predicted = 1").count() == 0
    assert rule_ensemble.score(docs, rule_ensemble.fit(docs, none)).where("score <> 0.5").count() == 0
    judged = quality_gbt.judge(docs, quality_gbt.fit(docs, none))
    assert judged.where("kept = base_failed").count() == 0
    for op in (toxicity_pu, rule_ensemble):
        assert op.score(empty, op.fit(empty, labels)).count() == 0
    assert quality_gbt.judge(empty, quality_gbt.fit(empty, labels)).count() == 0


def test_rule_ensemble_held_out_and_column(labelled_docs):
    docs, labels = labelled_docs
    model = rule_ensemble.fit(docs, labels)
    rows = check_scores(rule_ensemble.score(docs, model), 504)
    held = rows[rows["held_out"] & (rows["doc_id"] < 500)]
    assert (held["predicted"] == (held["doc_id"] % 5 != 0)).mean() > 0.98
    stats = docs.where("doc_id < 500").select("doc_id", rule_ensemble.statistics(docs["text"]).alias("s")).select("doc_id", "s.*").distinct().toPandas()
    expected = dict(zip(stats["doc_id"], model.predict(stats[rule_ensemble.STATS].to_numpy())))
    small = rows[rows["doc_id"] < 500]
    assert np.allclose(small["score"], [expected[i] for i in small["doc_id"]])
    assert rule_ensemble.keep_good(docs, model).columns == docs.columns


def test_statistics_of_plain_texts(spark):
    d = spark.createDataFrame([(0, "Ab ab ab!\n\nAb ab ab!\nx | 1"), (1, None), (2, " \t")], "i int, text string")
    s = {r["i"]: r["s"].asDict() for r in d.select("i", rule_ensemble.statistics(d["text"]).alias("s")).collect()}
    assert s[0]["n_words"] == 9 and s[0]["n_lines"] == 3 and s[0]["line_repeats"] == pytest.approx(1 / 3)
    assert s[0]["same_as_previous"] == 0 and s[0]["distinct"] == pytest.approx(6 / 9)
    assert set(s[1].values()) == {0.0} or s[1]["n_chars"] == 0
    assert s[2]["n_words"] == 0


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (600, 12)).astype(float)
    y = (z[:, 0] + z[:, 3] > 1).astype(float)
    b, beta = rule_ensemble.lasso_logistic(z, y, np.ones(600), 0.02)
    assert set(np.flatnonzero(np.abs(beta) > 0.2)) == {0, 3}


def test_trees_are_monotone_and_flat_forest_agrees():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (rng.random(800) < 0.2)).astype(float)
    base, forest = trees.boost(x, y, np.ones(800), rounds=25, depth=3, rate=0.3, min_weight=1, seed=1, monotone={0: 1})
    flat = quality_gbt.FlatForest.of(base, forest, 3)
    assert np.allclose(flat.predict(x), 1 / (1 + np.exp(-(base + sum(t.predict(x) for t in forest)))))
    grid = np.repeat(rng.random((20, 1, 3)), 50, axis=1)
    grid[:, :, 0] = np.linspace(0, 1, 50)
    p = flat.predict(grid.reshape(-1, 3)).reshape(20, 50)
    assert (np.diff(p, axis=1) >= -1e-12).all() and (flat.predict(x) > 0.5).astype(float).mean() == pytest.approx(y.mean(), abs=0.1)


def test_quality_counts(odd, odd_texts, labelled_docs):
    docs, labels = labelled_docs
    model = quality_gbt.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_gbt.judge(odd, model).collect()}
    for i, t in odd_texts:
        w, r = (t or "").encode().split(), got[i]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and r["n_repeat_words"] == brute.repeated_words(w)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    rows = quality_gbt.judge(docs, model).where("doc_id < 500").toPandas()
    assert (rows["kept"] == (rows["doc_id"] % 5 != 0)).mean() > 0.98


# --------------------------------------------------------- nearest neighbours
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[100:160] = x[100]  # a large group of equal vectors
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] * 12, 0), (1003, [None] + [1.0] * 11, 0),
             (1004, [float("inf")] + [1.0] * 11, 0), (1005, [1.0], 0), (None, x[0].tolist(), 0), (1006, [], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    index = nn_descent.build(v, k=16, rounds=6)
    got = nn_descent.search(index, v.where("vec_id % 50 = 0")).toPandas()
    y = x.astype(float)
    s = y @ y.T / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    hits = 0
    assert set(got["query_id"]) == set(range(0, 700, 50))
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        order = np.lexsort((np.arange(700), -np.round(s[q], 12)))
        order = order[order != q][:5]
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(part["vec_id"])
        assert np.allclose(part["score"], s[q][part["vec_id"]], atol=1e-9)
        hits += len(set(part["vec_id"]) & set(order.tolist()))
    assert hits >= 0.9 * 5 * got["query_id"].nunique()
    assert got[got["query_id"] == 100].sort_values("rank")["vec_id"].tolist() == [101, 102, 103, 104, 105]


def test_neighbours_of_few_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = nn_descent.search(nn_descent.build(v), v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 3), (0, 50), (50, 3), (50, 0)]
    none = v.where("false")
    assert nn_descent.search(nn_descent.build(none), none).count() == 0


def test_neighbours_grow_with_the_table(spark, monkeypatch):
    """The walk widens until a block of queries agrees with brute force."""
    x = np.random.default_rng(6).normal(size=(3000, 48)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    index = nn_descent.build(v, k=6, rounds=1)  # a poor graph, on which the first ef finds too little
    queries = v.where("vec_id % 50 = 0")
    asked = nn_descent.valid_vectors(queries).withColumnRenamed("id", "query_id")
    truth = nn_descent.nearest(index.vectors, asked, 5).cache()
    assert nn_descent.recall(nn_descent.search(index, queries, ef=160), truth) < 0.9
    monkeypatch.setattr(nn_descent, "BLOCK", 30)
    got = nn_descent.search(index, queries).cache()
    assert nn_descent.recall(got, truth) >= 0.9 and got.count() == 5 * 60
    assert [nn_descent.links_for(n) for n in (0, 32768, 51000, 3_000_000)] == [32, 32, 40, 88]


def test_neighbours_in_groups_below_half_precision(spark, monkeypatch):
    """All members of a node are scored, in more than one block, and k equal ones are found for any k."""
    monkeypatch.setattr(nn_descent, "MEMBERS", 300)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1100, 16))
    x[100:900] = np.where(np.arange(16) % 3, 0.25, -0.25) + rng.uniform(-3e-5, 3e-5, (800, 16))
    x[1000:1020] = x[1000]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = nn_descent.build(v)
    assert index.size == 1100 - 799 - 19
    got = nn_descent.search(index, v.where("vec_id % 50 = 0"), k=9).toPandas()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(100, 900, 50):
        order = np.argsort(-(y @ y[q]))
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == order[order != q][:9].tolist()
    assert got[got["query_id"] == 1000].sort_values("rank")["vec_id"].tolist() == list(range(1001, 1010))


def test_repeated_ids_and_odd_vectors(spark):
    """Of rows with one id the least vector counts; vectors that are null, empty, zero or not finite take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 120)]
    rows += [(0, [1.0, 0, 0, 0, 0, 0]), (0, [2.0, 0, 0, 0, 0, 1]), (0, [1.0, 0, 0, 0, 0, 0]), (500, [0.99, 0.01, 0, 0, 0, 0]),
             (600, [0.98, 0, 0.05, 0, 0, 0]), (601, None), (602, []), (603, [0.0] * 6), (604, [float("nan")] + [1.0] * 5),
             (605, [None] + [1.0] * 5), (606, [float("inf")] + [0.0] * 5), (607, [1.0, 0.0]), (None, [1.0, 0, 0, 0, 0, 0])]
    rows = [(i, e and [x if x is None else float(x) for x in e]) for i, e in rows]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn_descent.search(nn_descent.build(v), v.where("vec_id % 50 = 0 OR vec_id IS NULL")).toPandas()
    assert set(got["query_id"]) == {0, 50, 100, 500, 600} and not set(got["vec_id"]) & set(range(601, 608))
    assert (got.groupby("query_id").size() == 5).all() and not got.duplicated(["query_id", "vec_id"]).any()
    first = got[(got["query_id"] == 0) & (got["rank"] == 1)].iloc[0]
    assert first["vec_id"] == 500 and first["score"] == pytest.approx(0.99 / np.hypot(0.99, 0.01), abs=1e-12)


# ------------------------------------------------------------------ pipeline
def test_pipeline_of_odd_and_empty_tables(spark, twice, empty, labelled_docs, tmp_path):
    """Nulls, empty, long and repeated texts, and columns with names that stages use: every stage keeps the columns."""
    _, labels = labelled_docs
    for name, docs in (("odd", twice), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        frame = spark.read.parquet(f"{folder}/documents.parquet")
        columns, n = frame.columns, frame.count()
        for stage, run in corpus_pipeline.STAGES:
            run(spark, frame, folder).write.parquet(f"{folder}/{stage}")
            frame = spark.read.parquet(f"{folder}/{stage}")
            if stage != "packing":
                assert frame.columns == columns and frame.count() <= n
                n = frame.count()
        kept = {r["doc_id"] for r in spark.read.parquet(f"{folder}/near_dedup").collect()}
        assert {r["doc_id"] for r in frame.collect()} == kept and (name == "odd") == bool(kept)
        assert corpus_pipeline.run(spark, folder).count() == frame.count()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], ROOT).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_dedup", "packing"]
    assert all(f.columns == docs.columns for f in frames[:-1])
    text = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:-1]]
    good = {r["doc_id"] for r in Q.QUERIES["op10_quality_rules"](spark, ROOT).where("predicted = 1").collect()}
    assert set(text[1]) == good and set(text[2]) <= good
    assert text[3] == {i: t for i, (_, _, t) in brute.line_dedup(text[2]).items()}
    ids = sorted(text[3])
    assert set(text[4]) == {ids[g] for g in brute.groups([brute.simhash(text[3][i]) for i in ids])}
    pieces = frames[-1].toPandas()
    assert set(pieces["doc_id"]) == set(text[4])
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    same = corpus_pipeline.run(spark, ROOT).toPandas()
    order = ["doc_id", "start"]
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert len(same) == len(pieces)
    pd.testing.assert_frame_equal(same.sort_values(order)[cols[:1]].drop_duplicates().reset_index(drop=True),
                                  pieces.sort_values(order)[cols[:1]].drop_duplicates().reset_index(drop=True))


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES) == list(range(1, 11))
