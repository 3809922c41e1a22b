"""Registered retrieval: the documents are the knowledge base, the benchmark items the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text
from basketry.operators import retrieval as r
from basketry.operators import vector_index
from basketry.plans.registry import register
from basketry.plans.workspace import Workspace
from basketry.session import spread



def _documents(ws: Workspace):
    """Documents with their lines as paragraphs and a deprecation flag from the labels."""
    flags = ws.source("labels").select("doc_id", "toxic")
    if flags.count() <= _BROADCAST_LABELS:
        flags = F.broadcast(flags)
    docs = spread(ws.source("documents")).join(flags, "doc_id", "left")
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    return docs.select(
        F.col("doc_id"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
        F.regexp_replace("text", "\n", "\n\n").alias("body"),
        F.when(F.col("lang") == "en", "metric_definition").otherwise("faq").alias("doc_type"),
        F.lit("2011-06-20").cast("date").alias("last_updated"),
        toxic.alias("deprecated"),
        F.when(toxic, (F.col("doc_id") - 1).cast("string")).alias("superseded_by"),
    )


# Labels that are handed to every task, so that the documents' texts stay where they are; more are joined by a shuffle.
_BROADCAST_LABELS = 1_000_000
# Documents whose chunks are shown, likewise.
_BROADCAST_SHOWN = 200_000


def _chunks(ws: Workspace):
    return ws.written("chunks", lambda: r.with_buckets(r.chunk_documents(_documents(ws))))


def _whole_documents(ws: Workspace):
    """The chunks of the configuration ``doc`` alone, for what never asks for another one."""
    whole = {"doc": r.CONFIGS["doc"]}
    return ws.written("whole_documents", lambda: r.with_buckets(r.chunk_documents(_documents(ws), whole)))


def _questions(ws: Workspace):
    return ws.source("benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def _hits(ws: Workspace):
    """The best eight chunks per question, configuration and policy."""
    return ws.written("retrieval_hits", lambda: r.search(
        r.with_buckets(_questions(ws)), r.chunk_documents(_documents(ws), texts=False),
        max(r.CUTS), "buckets", r.bucket_matrix, r.POLICIES, "config"))


def _doc_hits(ws: Workspace):
    return ws.written("document_hits", lambda: r.search(
        r.with_buckets(_questions(ws)), _whole_documents(ws), max(r.CUTS), "buckets", r.bucket_matrix, r.POLICIES, "config"))


def _relevance(ws: Workspace):
    docs = _documents(ws).withColumnRenamed("body", "text").select("doc_id", "deprecated", "text")
    return ws.written("relevance", lambda: r.rarest_word_relevance(_questions(ws), docs))


@register("g1_paragraphs", """
SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS digest
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents)""")
def g1(ws: Workspace):
    found = text.paragraphs(F.col("body"))
    return _documents(ws).select(
        "doc_id", F.size(found).cast("bigint").alias("paragraphs"), F.md5(F.array_join(found, "|")).alias("digest")
    )


@register("g2_word_windows", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(1, len(t) - 16), 48)) AS pos FROM w)
SELECT doc_id, CAST(pos / 48 AS BIGINT) AS window_no, len(t[pos + 1:pos + 64]) AS words, md5(array_to_string(t[pos + 1:pos + 64], ' ')) AS digest FROM s""")
def g2(ws: Workspace):
    windows = text.word_windows(text.words(F.col("text")), 64, 16)
    return spread(ws.source("documents")).select("doc_id", F.posexplode(windows).alias("window_no", "w")).select(
        "doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.size("w").cast("bigint").alias("words"),
        F.md5(F.array_join("w", " ")).alias("digest"),
    )


# Greedy packing as a recursion over the units of each document: the piece number rises when a unit is a
# window of a long paragraph, follows one, or no longer fits.
_PACKED = """
WITH RECURSIVE paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS no, t
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS no,
               unnest(list_transform(ls, lambda x: list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''))) AS t
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE len(t) > 0),
units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, pos) AS u, n, alone, body FROM (
    SELECT doc_id, no, 0 AS pos, len(t) AS n, false AS alone, array_to_string(t, ' ') AS body FROM paras WHERE len(t) <= {size}
    UNION ALL
    SELECT doc_id, no, pos, len(t[pos + 1:pos + {size}]), true, array_to_string(t[pos + 1:pos + {size}], ' ')
    FROM (SELECT doc_id, no, t, unnest(range(0, greatest(1, len(t) - 16), {step})) AS pos FROM paras WHERE len(t) > {size}))),
packed(doc_id, u, piece, filled) AS (
  SELECT doc_id, u, 0, CASE WHEN alone THEN -1 ELSE n END FROM units WHERE u = 1
  UNION ALL
  SELECT x.doc_id, x.u, CASE WHEN x.alone OR filled < 0 OR filled + x.n > {size} THEN piece + 1 ELSE piece END,
         CASE WHEN x.alone THEN -1 WHEN filled < 0 OR filled + x.n > {size} THEN x.n ELSE filled + x.n END
  FROM packed p JOIN units x ON x.doc_id = p.doc_id AND x.u = p.u + 1)
SELECT '{config}' AS config, doc_id, piece AS chunk_index,
       'Document ' || doc_id || '.' || chr(10) || string_agg(body, ' ' ORDER BY u) AS chunk
FROM packed JOIN units USING (doc_id, u) GROUP BY doc_id, piece"""


def _packed(config: str) -> str:
    size = r.CONFIGS[config]
    return _PACKED.format(config=config, size=size, step=max(1, size - 16))


_ALL_CHUNKS = " UNION ALL ".join(f"({_packed(c)})" for c in ("w32", "w64", "w128")) + """
UNION ALL SELECT 'doc', doc_id, 0, 'Document ' || doc_id || '.' || chr(10) || replace(text, chr(10), chr(10) || chr(10)) FROM documents"""


@register("g3_greedy_chunks", f"SELECT config, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS digest FROM ({_ALL_CHUNKS})")
def g3(ws: Workspace):
    return r.chunk_documents(_documents(ws)).select("config", "doc_id", "chunk_index", F.md5("text").alias("digest"))


@register("g4_chunk_statistics", f"""
SELECT config, count(*) AS chunks, half_even(sum(n)::DOUBLE / count(*), 1) AS mean_words, CAST(max(n) AS INTEGER) AS max_words
FROM (SELECT config, len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda x: x <> '')) AS n FROM ({_ALL_CHUNKS})) GROUP BY config""")
def g4(ws: Workspace):
    return r.chunk_statistics(_chunks(ws))


def _bucket_sql(word: str) -> str:
    rest = "0"
    for start in (1, 9, 17, 25):
        rest = f"(({rest}) * 256 + ('0x' || substr(md5({word}), {start}, 8))::BIGINT) % 384"
    return rest


def _bags(key: str, source: str) -> str:
    return f"""SELECT {key}, b, count(*) AS n FROM (
  SELECT {key}, {_bucket_sql('w')} AS b FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source}))
  GROUP BY {key}, b"""


@register("g5_hashed_vectors", f"""
WITH bag AS ({_bags('doc_id', 'documents')})
SELECT doc_id, CAST(b AS INTEGER) AS bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM bag""")
def g5(ws: Workspace):
    return r.hashed_weights(spread(ws.source("documents").select("doc_id", "text")), "doc_id")


_SIMILAR = f"""
docs AS (SELECT doc_id, 'Document ' || doc_id || '.' || chr(10) || text AS text FROM documents),
db AS ({_bags('doc_id', 'docs')}), qb AS ({_bags('item_id', 'benchmark')}),
dn AS (SELECT doc_id, sum(n * n)::DOUBLE AS s FROM db GROUP BY 1), qn AS (SELECT item_id, sum(n * n)::DOUBLE AS s FROM qb GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum(qb.n * db.n)::DOUBLE AS dot FROM qb JOIN db USING (b) GROUP BY 1, 2),
sims AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(toxic, 0) = 1 AS deprecated,
                round(coalesce(dot, 0) / sqrt(qn.s * dn.s), 12) AS similarity
         FROM qn CROSS JOIN dn d LEFT JOIN dots USING (item_id, doc_id) JOIN dn USING (doc_id) LEFT JOIN labels USING (doc_id)),
policies(policy) AS (VALUES ('include'), ('penalize'), ('exclude')),
hits AS (SELECT * FROM (
  SELECT policy, query_id, doc_id, doc_id || '#0' AS chunk_id, similarity, score,
         row_number() OVER (PARTITION BY policy, query_id ORDER BY score DESC, doc_id || '#0') AS rank
  FROM (SELECT policy, query_id, doc_id, similarity,
               similarity - CASE WHEN policy = 'penalize' AND deprecated THEN 0.1::DOUBLE * 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
        FROM sims, policies WHERE NOT (policy = 'exclude' AND deprecated))) WHERE rank <= 8)"""


_CENTROIDS = """
c AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2),
cl AS (SELECT label, list(v ORDER BY i) AS v FROM c GROUP BY 1)"""


@register("g6_vector_search", f"""
WITH {_CENTROIDS}
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS doc_id, round(similarity, 9) AS similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT cl.label AS query_id, vec_id, s AS similarity, row_number() OVER (PARTITION BY cl.label ORDER BY s DESC, CAST(vec_id AS VARCHAR)) AS rank
      FROM cl, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
           LATERAL (SELECT round(list_cosine_similarity(cl.v, e), 12) AS s))
WHERE rank <= 8""")
def g6(ws: Workspace):
    """The nearest vectors of every label's mean vector."""
    vectors = ws.source("embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centroids = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select(
        F.col("label").alias("query_id"), F.transform("c", lambda x: x["v"]).alias("embedding")
    )  # one entry per dimension
    corpus = vectors.select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.lit(False).alias("deprecated"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    hits = r.search(centroids, corpus, 8, "embedding", r.dense_matrix)
    return hits.select("query_id", "doc_id", F.round("similarity", 9).alias("similarity"), "rank")


@register("g6_clustered_search", """
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT query_id, id, round(similarity, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.id AS query_id, v.id, s AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY s DESC, v.id) AS rank
  FROM v q, v, LATERAL (SELECT round(list_cosine_similarity(q.e, v.e), 12) AS s) WHERE q.vec_id % 20 = 0) WHERE rank <= 8""")
def g6_clustered(ws: Workspace):
    """Every twentieth vector against all, through the index of cells."""
    vectors = ws.source("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = ws.fitted("vector_index", lambda: vector_index.build(vectors))
    hits, _ = vector_index.search(index, vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 8)
    return hits.select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank")


@register("g6_text_search", f"WITH {_SIMILAR} SELECT query_id, doc_id, similarity, CAST(rank AS INTEGER) AS rank FROM hits WHERE policy = 'include'")
def g6_text(ws: Workspace):
    return _doc_hits(ws).filter("policy = 'include'").select("query_id", "doc_id", "similarity", "rank")


@register("g7_policy_ranking", f"WITH {_SIMILAR} SELECT policy, query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def g7(ws: Workspace):
    return _doc_hits(ws).select("policy", "query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


_ALL_SIMILAR = f"""
pieces AS ({_ALL_CHUNKS}), cu AS (SELECT config, doc_id, doc_id || '#' || chunk_index AS chunk_id, chunk AS text FROM pieces),
keyed AS (SELECT config || '|' || chunk_id AS ck, text FROM cu),
db AS ({_bags('ck', 'keyed')}), qb AS ({_bags('item_id', 'benchmark')}),
dn AS (SELECT ck, sum(n * n)::DOUBLE AS s FROM db GROUP BY 1), qn AS (SELECT item_id, sum(n * n)::DOUBLE AS s FROM qb GROUP BY 1),
dots AS (SELECT item_id, ck, sum(qb.n * db.n)::DOUBLE AS dot FROM qb JOIN db USING (b) GROUP BY 1, 2),
sims AS (SELECT config, chunk_id, CAST(item_id AS VARCHAR) AS query_id, CAST(cu.doc_id AS VARCHAR) AS doc_id, coalesce(toxic, 0) = 1 AS deprecated,
                round(coalesce(dot, 0) / sqrt(qn.s * dn.s), 12) AS similarity
         FROM qn CROSS JOIN dn LEFT JOIN dots USING (item_id, ck) JOIN cu ON cu.config || '|' || cu.chunk_id = dn.ck
         LEFT JOIN labels ON labels.doc_id = cu.doc_id),
policies(policy) AS (VALUES ('include'), ('penalize'), ('exclude')),
hits AS (SELECT * FROM (
  SELECT config, policy, query_id, doc_id, chunk_id, similarity, score,
         row_number() OVER (PARTITION BY config, policy, query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT config, policy, query_id, doc_id, chunk_id, similarity,
               similarity - CASE WHEN policy = 'penalize' AND deprecated THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS score
        FROM sims, policies WHERE NOT (policy = 'exclude' AND deprecated))) WHERE rank <= 8)"""


@register("g7_policy_ranking_all_configs", f"WITH {_ALL_SIMILAR} SELECT config, policy, query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hits")
def g7_all(ws: Workspace):
    return _hits(ws).select("config", "policy", "query_id", "chunk_id", "score", "rank")


@register("g8_document_ranking", f"WITH {_SIMILAR} SELECT policy, query_id, doc_id, CAST(rank AS INTEGER) AS doc_rank FROM hits")
def g8(ws: Workspace):
    return r.document_ranks(_doc_hits(ws), ["policy", "query_id"])


@register("g8_document_ranking_all_configs", f"""WITH {_ALL_SIMILAR}
SELECT config, policy, query_id, doc_id, CAST(row_number() OVER (PARTITION BY config, policy, query_id ORDER BY first) AS INTEGER) AS doc_rank
FROM (SELECT config, policy, query_id, doc_id, min(rank) AS first FROM hits GROUP BY ALL)""")
def g8_all(ws: Workspace):
    return r.document_ranks(_hits(ws), ["config", "policy", "query_id"])


@register("g9_context", f"""WITH {_SIMILAR}
SELECT query_id, md5(string_agg('[doc: ' || h.doc_id || ' | ' || CASE WHEN lang = 'en' THEN 'metric_definition' ELSE 'faq' END || ' | updated 2011-06-20 | '
         || CASE WHEN toxic = 1 THEN 'DEPRECATED, superseded by ' || (d.doc_id - 1) ELSE 'current' END || ']' || chr(10)
         || 'Document ' || d.doc_id || '.' || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM hits h JOIN documents d ON CAST(d.doc_id AS VARCHAR) = h.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE policy = 'penalize' AND rank <= 3 GROUP BY query_id""")
def g9(ws: Workspace):
    top = _doc_hits(ws).filter("policy = 'penalize' AND rank <= 3")
    blocks = r.context_blocks(top, _whole_documents(ws), ["query_id"])
    return blocks.select("query_id", F.md5("context").alias("context_md5"))


_RELEVANT = """
asked AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark),
held AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
freq AS (SELECT word, count(*) AS docs FROM held GROUP BY 1),
rarest AS (SELECT query_id, word FROM (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY docs, word) AS p FROM asked JOIN freq USING (word)) WHERE p = 1),
relevance AS (SELECT query_id, held.doc_id, CASE WHEN toxic = 1 THEN 'trap' ELSE 'relevant' END AS kind
              FROM rarest JOIN held USING (word) LEFT JOIN labels ON CAST(labels.doc_id AS VARCHAR) = held.doc_id)"""
_SCORES_TAIL = f""", {_RELEVANT},
cuts(k) AS (VALUES (3), (5), (8)),
wanted AS (SELECT query_id, count(*) AS n FROM relevance WHERE kind = 'relevant' GROUP BY 1),
docs_at AS (SELECT config, policy, k, query_id, doc_id, row_number() OVER (PARTITION BY config, policy, k, query_id ORDER BY first) AS place
            FROM (SELECT config, policy, k, query_id, doc_id, min(rank) AS first FROM hits, cuts WHERE rank <= k GROUP BY ALL)),
per AS (SELECT config, policy, k, query_id, n, count(*) FILTER (WHERE kind = 'relevant') AS found,
               min(place) FILTER (WHERE kind = 'relevant') AS first, min(place) FILTER (WHERE kind = 'trap') AS trap
        FROM docs_at JOIN wanted USING (query_id) LEFT JOIN relevance USING (query_id, doc_id) GROUP BY ALL),
scores AS (SELECT config, policy, k, query_id, found / n::DOUBLE AS recall, (first IS NOT NULL)::INTEGER::DOUBLE AS hit, coalesce(1.0::DOUBLE / first, 0) AS rr,
                  (trap IS NOT NULL)::INTEGER::DOUBLE AS trap_in_context,
                  (trap IS NOT NULL AND (first IS NULL OR trap < first))::INTEGER::DOUBLE AS trap_above_relevant FROM per),
metrics AS (SELECT config, policy, k, subset, count(*) AS questions, half_even(avg(recall), 4) AS recall, half_even(avg(hit), 4) AS hit, half_even(avg(rr), 4) AS mrr,
                   half_even(avg(trap_in_context), 4) AS trap_in_context, half_even(avg(trap_above_relevant), 4) AS trap_above_relevant
            FROM (SELECT *, unnest(['all', CASE WHEN CAST(query_id AS INTEGER) % 4 = 0 THEN 'unanswerable' ELSE 'answerable' END]) AS subset FROM scores) GROUP BY ALL),
candidates AS (SELECT * FROM metrics WHERE subset = 'all' AND policy = 'penalize'),
best AS (SELECT config, recall FROM candidates WHERE k = 8 ORDER BY recall DESC, mrr DESC, config DESC LIMIT 1)"""
_SCORES = _SIMILAR.replace("SELECT policy, query_id, doc_id, doc_id || '#0' AS chunk_id", "SELECT 'doc' AS config, policy, query_id, doc_id, doc_id || '#0' AS chunk_id") + _SCORES_TAIL
_ALL_SCORES = _ALL_SIMILAR + _SCORES_TAIL
_CHOICE = """SELECT c.config, c.k, c.policy, c.recall, c.mrr FROM candidates c JOIN best USING (config)
WHERE c.recall >= best.recall - 0.02::DOUBLE ORDER BY c.k LIMIT 1"""


def _subsets():
    hard = F.col("query_id").cast("int") % 4 == 0
    return F.array(F.lit("all"), F.when(hard, "unanswerable").otherwise("answerable"))


def _metrics(ws: Workspace, hits):
    keys = ["config", "policy", "k", "query_id"]
    scores = r.question_scores(r.document_ranks(r.at_cuts(hits), keys), _relevance(ws), keys)
    return r.mean_metrics(scores, keys[:-1], _subsets())


@register("g10_retrieval_metrics", f"WITH {_SCORES} SELECT * FROM metrics")
def g10(ws: Workspace):
    return _metrics(ws, _doc_hits(ws))


@register("g10_retrieval_metrics_all_configs", f"WITH {_ALL_SCORES} SELECT * FROM metrics")
def g10_all(ws: Workspace):
    return _metrics(ws, _hits(ws))


@register("g11_chosen_setting", f"WITH {_SCORES} {_CHOICE}")
def g11(ws: Workspace):
    return r.choose_setting(_metrics(ws, _doc_hits(ws)))


@register("g11_chosen_setting_all_configs", f"WITH {_ALL_SCORES} {_CHOICE}")
def g11_all(ws: Workspace):
    return r.choose_setting(_metrics(ws, _hits(ws)))


@register("g12_misses", f"WITH {_SCORES} SELECT query_id FROM scores WHERE policy = 'penalize' AND k = 8 AND hit = 0")
def g12(ws: Workspace):
    ranks = r.document_ranks(_doc_hits(ws).filter("policy = 'penalize'"), ["query_id"])
    return r.misses(ranks, _relevance(ws), _questions(ws).select("query_id"))


_CHOSEN = f"{_ALL_SCORES}, chosen AS ({_CHOICE})"


def _chosen_hits(ws: Workspace):
    """The hits shown under the setting that the metrics choose."""
    setting = ws.written("chosen_setting", lambda: r.choose_setting(_metrics(ws, _hits(ws))).select("config", "policy", "k"))
    return _hits(ws).join(F.broadcast(setting), ["config", "policy"]).filter("rank <= k")  # one row


@register("g9_context_at_chosen_setting", f"""WITH {_CHOSEN}
SELECT query_id, md5(string_agg('[doc: ' || h.doc_id || ' | ' || CASE WHEN lang = 'en' THEN 'metric_definition' ELSE 'faq' END || ' | updated 2011-06-20 | '
         || CASE WHEN toxic = 1 THEN 'DEPRECATED, superseded by ' || (d.doc_id - 1) ELSE 'current' END || ']' || chr(10)
         || cu.text, chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM hits h JOIN chosen c ON c.config = h.config AND c.policy = h.policy AND h.rank <= c.k JOIN cu ON cu.config = h.config AND cu.chunk_id = h.chunk_id
JOIN documents d ON CAST(d.doc_id AS VARCHAR) = h.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY query_id""")
def g9_chosen(ws: Workspace):
    shown = _chosen_hits(ws)
    wanted = shown.select("doc_id").distinct()
    if wanted.count() <= _BROADCAST_SHOWN:
        wanted = F.broadcast(wanted)
    # Only the documents with a chunk that is shown are cut again, for its text.
    documents = _documents(ws)
    found = documents.join(wanted.withColumnRenamed("doc_id", "_shown"), F.col("doc_id").cast("string") == F.col("_shown"), "left_semi")
    held = r.chunk_documents(found).join(F.broadcast(shown.select("config").distinct()), "config", "left_semi")
    return r.context_blocks(shown, held, ["query_id"]).select("query_id", F.md5("context").alias("context_md5"))


@register("g12_misses_at_chosen_setting", f"WITH {_CHOSEN} SELECT query_id FROM scores JOIN chosen USING (config, policy, k) WHERE hit = 0")
def g12_chosen(ws: Workspace):
    return r.misses(r.document_ranks(_chosen_hits(ws), ["query_id"]), _relevance(ws), _questions(ws).select("query_id"))
