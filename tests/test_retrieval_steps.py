"""Steps shared by the retrieval queries: which chunks a search needs, and how often a word is hashed."""
import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from basketry.functions import text
from basketry.operators import retrieval
from basketry.plans import register_retrieval as registered


def test_whole_documents_are_searched_without_other_chunks(monkeypatch):
    asked = []

    class Workspace:
        def written(self, name, build):
            return build()

    def chunk_documents(documents, configs=retrieval.CONFIGS):
        asked.append(dict(configs))
        return documents

    monkeypatch.setattr(retrieval, "chunk_documents", chunk_documents)
    monkeypatch.setattr(retrieval, "with_buckets", lambda df: df)
    monkeypatch.setattr(retrieval, "search", lambda *a, **k: a[1])
    monkeypatch.setattr(registered, "_documents", lambda ws: "documents")
    monkeypatch.setattr(registered, "_questions", lambda ws: "questions")
    registered._doc_hits(Workspace())
    assert asked == [{"doc": None}]


def test_a_worker_hashes_a_word_once(monkeypatch):
    hashed = []

    def md5(word):
        hashed.append(word)
        return hashlib.new("md5", word)

    monkeypatch.setattr(text, "_remembered", {})
    monkeypatch.setattr(text, "hashlib", type("h", (), {"md5": staticmethod(md5)}))
    found = text._bucket_lists(pd.Series(["ab 12 ab", "ab", "", None]))
    model = {w: int(hashlib.new("md5", w.encode()).hexdigest(), 16) % 384 for w in ("ab", "12")}
    assert [None if x is None else list(x) for x in found] == [[model["ab"], model["12"], model["ab"]], [model["ab"]], [], None]
    assert sorted(hashed) == [b"12", b"ab"]


def test_buckets_are_those_of_the_digest_expression(spark):
    texts = ["Ab ab, 12!", "", None, "été K x_y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(text.buckets(rows.t)).collect()]
    words = [r[0] for r in rows.select(text.tokens(rows.t)).collect()]
    assert got == [None if w is None else [int(hashlib.md5(x.encode()).hexdigest(), 16) % 384 for x in w] for w in words]


def _documents(spark):
    pick = random.Random(5)
    parts = ["Ab", "cd,", "e-f", "é", "12", "--", "İx", "\n", "\n\n", "\n \n", "\t", " ", " ", "\x1c", " "]
    bodies = ["".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(n)) for n in (0, 1, 7, 40, 300, 900, 900)]
    rows = [(i, f"Title {i}", b, i % 3 == 0) for i, b in enumerate([*bodies, None, "x y\n\nz"])]
    return spark.createDataFrame(rows, "doc_id int, title string, body string, deprecated boolean").repartition(2)


def test_buckets_cut_with_their_documents_are_those_of_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(text, "_BYTES_PER_STEP", 500)
    documents, configs = _documents(spark), {"a": 3, "b": 20, "doc": None}
    whole = retrieval.with_buckets(retrieval.chunk_documents(documents, configs)).drop("text")
    cut = retrieval.chunk_documents(documents, configs, texts=False)
    assert cut.columns == whole.columns
    got, wanted = (sorted(map(repr, df.collect())) for df in (cut, whole))
    assert got == wanted and len(got) > 200


def test_all_configurations_are_searched_without_copying_texts(spark):
    """Words are hashed once per document, and neither texts nor chunks are written or shuffled."""
    documents = _documents(spark)
    cut = retrieval.chunk_documents(documents, texts=False)
    assert "text" not in cut.columns

    class Workspace:
        def written(self, name, build):
            seen.append(name)
            return build()

        def source(self, name):
            return {"documents": documents.withColumnRenamed("body", "text").withColumn("lang", F.lit("en")),
                    "labels": spark.createDataFrame([(1, 1)], "doc_id int, toxic int"),
                    "benchmark": spark.createDataFrame([(1, "ab 12")], "item_id int, text string")}[name]

    seen = []
    hits = registered._hits(Workspace())
    assert seen == ["retrieval_hits"]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert {r.config for r in hits.collect()} == set(retrieval.CONFIGS)


def test_scores_that_rise_row_by_row_and_missing_vectors(spark, monkeypatch):
    """Every later row is better than all before, and many tie with the best: none may be ruled out."""
    monkeypatch.setattr(retrieval, "_SCORES_PER_STEP", 1)
    rows = [(f"c{i:04d}", "d", i % 2 == 0, [1.0, 900.0 - min(i, 800)]) for i in range(1200)] + [("none", "d", False, None)]
    corpus = spark.createDataFrame(rows, "chunk_id string, doc_id string, deprecated boolean, v array<double>").coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "query_id string, v array<double>")
    hits = retrieval.search(asked, corpus, 4, "v", retrieval.dense_matrix, retrieval.POLICIES).orderBy("rank").collect()
    found = {p: [h.chunk_id for h in hits if h.policy == p] for p in retrieval.POLICIES}
    odd = ["c0801", "c0803", "c0805", "c0807"]
    assert found == {"include": ["c0800", "c0801", "c0802", "c0803"], "penalize": odd, "exclude": odd}


def test_rarest_words_by_lookup_and_by_join(spark, monkeypatch):
    questions = spark.createDataFrame([("q", "the Cat 7"), ("r", "the the"), ("s", "nowhere")], "query_id string, text string")
    documents = spark.createDataFrame(
        [(1, False, "The cat, the CAT"), (2, True, "the cat 7-7"), (3, False, None), (3, False, "é THE"), (3, False, "é THE")],
        "doc_id int, deprecated boolean, text string")
    wanted = [("q", "2", "trap")] + [("r", d, k) for d, k in (("1", "relevant"), ("2", "trap"), ("3", "relevant"), ("3", "relevant"))]
    for most in (10, 0):
        monkeypatch.setattr(retrieval, "_BROADCAST_WORDS", most)
        assert sorted(map(tuple, retrieval.rarest_word_relevance(questions, documents).collect())) == wanted
