"""Vectors at the ends of double precision, null ids that tie, columns with odd names, and the traversal's order."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import PATH, PATTERN, closure, prose
from test_queries import plain_leaks

import corpus_pipeline
from mosaica.llm import bpe, decontaminate, embedding_dedup, filter_audit, langid, periodic, pii, quality, sharding, simhash, substring, toxicity


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def test_tiny_huge_and_subnormal_vectors_link_like_others(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 16))
    near = x + 0.01 * rng.standard_normal(x.shape)
    more = [1e-200 * x[0], 1e200 * near[1], np.full(16, 1e-200), np.full(16, 5e-324), np.full(16, 1.7e308), np.full(16, 1.0), 1e-310 * near[2], np.r_[1e200, 1e200, np.zeros(14)], np.r_[1.0000001e200, 1e200, np.zeros(14)], np.r_[1e300, 1e-300, np.zeros(14)], np.r_[3.0, np.zeros(15)]]
    short = [np.array([1e-200, 1e-200]), np.array([2.0, 2.0]), np.array([1.0, 0.0, 0.0]), np.array([1e250, 1.0, 0.0]), np.array([7.0]), np.array([1e-320]), np.array([-1.0])]
    vectors = [*x, *near, *more, *short]
    table = spark.createDataFrame([(i, list(map(float, v)), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    linked = lambda i, j: len(vectors[i]) == len(vectors[j]) and cosine(vectors[i], vectors[j]) >= 0.98
    low = closure(len(vectors), linked)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    want = {i: (sum(linked(i, j) for j in range(len(vectors)) if j != i), low[i]) for i in range(len(vectors))}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want and sum(n for n, _ in want.values()) > 90


def test_one_tiny_vector_costs_no_link(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 16))
    data = [(i, list(map(float, v)), 1) for i, v in enumerate([*x, *(x + 0.001), np.full(16, 1e-200)])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).agg(F.sum("n_links")).first()[0]
    assert got == 400


def test_cells_come_nearest_first_and_stop_at_the_radius():
    rng = np.random.default_rng(1)
    words = (rng.standard_normal((30, 4)), rng.standard_normal((30, 4)))
    index = embedding_dedup.MultiIndex(words, 0.9)
    x = rng.standard_normal((20, 8))
    cells, far = index.borders(x)
    for q in range(len(x)):
        sums = far[0][q][:, None] + far[1][q]
        got = index.visits(far, q)
        assert got[0] == cells[0][q] * 30 + cells[1][q]
        assert sorted(got) == sorted(np.flatnonzero(sums.ravel() <= 0.9)) and len(set(got)) == len(got)
        dist = sums.ravel()[got]
        assert (np.diff(dist) >= 0).all()
    assert max(len(index.visits(far, q)) for q in range(20)) > 5


def test_large_codebooks_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = tuple(rng.standard_normal((2048, 384)) for _ in range(2))
    tracemalloc.start()
    index = embedding_dedup.MultiIndex(words)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert np.isclose(index.gaps[0][3, 5], np.linalg.norm(words[0][3] - words[0][5]))


@pytest.mark.parametrize("most", [20_000, 2])
def test_null_item_ids_may_tie(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", most)
    leak = prose(77, 40) + ". " + prose(78, 12) + "."
    items = [(None, leak), (None, leak), (3, leak), (None, leak + " more words"), (4, "other item of few words here")]
    docs = [(1, prose(1, 60) + " " + leak), (2, prose(2, 90)), (None, leak), (5, None)]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in got) == plain_leaks(docs, items) != []


NAMES = ["a.b", "_none", "_new", "_id", "_spans", "_key", "_n", "part", "`q`", "a b", "_mark", "_found", "fp2"]


def test_every_operator_that_keeps_columns_keeps_odd_ones(spark):
    texts = [prose(i, 70) for i in range(30)]
    texts[20] = texts[3] + " " + texts[4]
    quoted = ", ".join("`" + n.replace("`", "``") + "` int" for n in NAMES)
    docs = spark.createDataFrame([(i, t, "aa" if i % 2 else "bb", "s", len(t), *[i] * len(NAMES)) for i, t in enumerate(texts)], f"doc_id long, text string, lang string, source string, n_chars long, {quoted}")
    items = spark.createDataFrame([(1, texts[7])], "item_id long, text string")
    labelled = docs.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    made = {
        "langid": langid.identify(docs, langid.learn(docs)), "toxicity": toxicity.learn(labelled).score(docs), "shards": sharding.shard(docs, "text", "n_chars", ["doc_id"], 3),
        "quality": quality.classify(docs), "good": quality.good(docs), "passages": substring.remove_passages(docs), "clean": decontaminate.clean(docs, items), "prints": simhash.fingerprints(docs),
        "mask": filter_audit.failures(docs), "runs": periodic.with_runs(docs), "collapsed": periodic.collapsed(docs), "spans": pii.with_spans(docs), "redacted": pii.redacted(docs),
        "ids": bpe.tokenized(docs, PATH, PATTERN), "one": corpus_pipeline.one_of_each(spark, docs, ""), "cut": corpus_pipeline.without_passages(spark, docs, ""),
    }
    for name, out in made.items():
        rows = out.collect()
        assert len(rows) >= 27, name
        at = {c: k for k, c in enumerate(out.columns)}
        assert all(row[at[n]] == row[at["doc_id"]] for row in rows for n in NAMES), name


def test_copies_of_many_fingerprints_stay_few():
    from math import comb

    share = np.array([comb(64, d) / 2**64 for d in range(65)])
    for n, most in ((10**6, 15), (10**9, 220)):
        counts = np.tile(np.round(share * n).astype(np.int64), (64, 1))
        chosen = simhash.cuts(counts, 2)
        below = np.cumsum(share)
        copies = np.prod([below[c] + 1 - below[c - 2] for _, c in chosen])
        cell = n * np.prod([max(below[c], 1 - below[c - 2]) for _, c in chosen])
        print(n, len(chosen), round(copies, 1), round(cell))
        assert copies < most and cell <= simhash.CELL
