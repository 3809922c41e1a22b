import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import text
from basketry.operators import retrieval


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    corpus = rng.normal(size=(300, 8))
    corpus[250:] = corpus[0]                      # a sixth of the corpus is one vector
    return rng.normal(size=(7, 8)), corpus, rng.random(300) < 0.3


def brute(queries, corpus, old, k, policy):
    out = {}
    for q, query in enumerate(queries):
        sims = np.round(corpus @ query / np.sqrt((corpus**2).sum(1) * (query**2).sum()), 12)
        score = sims - retrieval.DEPRECATED_PENALTY * old if policy == "penalize" else sims
        rows = [i for i in range(len(corpus)) if not (policy == "exclude" and old[i])]
        rows.sort(key=lambda i: (-score[i], f"c{i:03d}"))
        out[str(q)] = [f"c{i:03d}" for i in rows[:k]]
    return out


@pytest.mark.parametrize("block", [2_000, 3])
def test_search_equals_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(retrieval, "_QUERIES_PER_BLOCK", block)
    monkeypatch.setattr(retrieval, "_SCORES_PER_STEP", 1)
    queries, corpus, old = vectors
    q = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(queries)], "query_id string, v array<double>")
    c = spark.createDataFrame(
        [(f"c{i:03d}", f"d{i // 3}", bool(old[i]), v.tolist()) for i, v in enumerate(corpus)],
        "chunk_id string, doc_id string, deprecated boolean, v array<double>").repartition(5)
    hits = retrieval.search(q, c, 9, "v", retrieval.dense_matrix, retrieval.POLICIES).orderBy("rank").collect()
    for policy in retrieval.POLICIES:
        got = {}
        for h in hits:
            if h.policy == policy:
                got.setdefault(h.query_id, []).append(h.chunk_id)
        assert got == brute(queries, corpus, old, 9, policy)


def test_hashed_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "!!")], "k int, text string")
    found = {r.k: np.array(r.embedding) for r in retrieval.hashed_embeddings(df, "k").collect()}
    assert np.linalg.norm(found[1]) == pytest.approx(1.0) and not found[2].any()
    counts = retrieval.bucket_matrix(df.select(text.buckets(F.col("text")).alias("b")).toPandas()["b"])
    assert counts[0].sum() == 3 and np.allclose(counts[0] / np.linalg.norm(counts[0]), found[1], atol=1e-6)


def test_question_scores(spark):
    ranks = spark.createDataFrame([("q", d, i) for i, d in enumerate("abc", 1)] + [("r", "x", 1)], "query_id string, doc_id string, doc_rank int")
    wanted = spark.createDataFrame(
        [("q", "b", "relevant"), ("q", "z", "relevant"), ("q", "a", "trap"), ("r", "b", "relevant")], "query_id string, doc_id string, kind string")
    found = {r.query_id: r for r in retrieval.question_scores(ranks, wanted, ["query_id"]).collect()}
    q = found["q"]
    assert (q.recall, q.hit, q.rr, q.trap_in_context, q.trap_above_relevant) == (0.5, 1.0, 0.5, 1.0, 1.0)
    assert (found["r"].recall, found["r"].rr, found["r"].trap_in_context) == (0.0, 0.0, 0.0)


def test_choose_setting(spark):
    rows = [("w32", "penalize", k, "all", r, m) for k, r, m in ((3, 0.5, 0.4), (5, 0.69, 0.5), (8, 0.70, 0.5))]
    rows += [("doc", "penalize", 8, "all", 0.70, 0.6), ("doc", "penalize", 5, "all", 0.67, 0.6), ("doc", "include", 8, "all", 0.9, 0.9)]
    df = spark.createDataFrame(rows, "config string, policy string, k int, subset string, recall double, mrr double")
    best = retrieval.choose_setting(df).first()
    assert (best.config, best.k) == ("doc", 8)


def test_context_marks_deprecated_documents(spark):
    hits = spark.createDataFrame([("q", "a#0", "a", 1), ("q", "b#0", "b", 2)], "query_id string, chunk_id string, doc_id string, rank int")
    corpus = spark.createDataFrame(
        [("a#0", "policy", "2011-01-01", False, None, "A"), ("b#0", "faq", "2010-01-01", True, "a", "B")],
        "chunk_id string, doc_type string, last_updated string, deprecated boolean, superseded_by string, text string")
    assert retrieval.context_blocks(hits, corpus, ["query_id"]).first().context == (
        "[doc: a | policy | updated 2011-01-01 | current]\nA\n\n[doc: b | faq | updated 2010-01-01 | DEPRECATED, superseded by a]\nB")
