"""Chunks, hashed vectors, exact cosine search, deprecation policies and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketry.functions import text
from basketry.operators.ranking import row_positions
from basketry.session import bounded_batches, durable

# Chunk configurations (words per chunk, None = whole document), cut-offs and the penalty.
CONFIGS = {"w32": 32, "w64": 64, "w128": 128, "doc": None}
POLICIES = ["include", "penalize", "exclude"]
CUTS = [3, 5, 8]
DEPRECATED_PENALTY = 0.10
CHOICE_SLACK = 0.02

_QUERIES_PER_BLOCK = 2_000
_SCORES_PER_STEP = 2_000_000
_HIT_COLUMNS = ["policy", "query_id", "grouping", "chunk_id", "doc_id", "similarity", "score"]
# Words of the questions that are broadcast to the documents; more are joined by a shuffle.
_BROADCAST_WORDS = 200_000


def chunk_documents(
    documents: DataFrame, configs: dict[str, int | None] = CONFIGS, overlap: int = 16, texts: bool = True
) -> DataFrame:
    """One row per (config, chunk). Needs doc_id, title and body; other columns are carried along.

    A document is cut where it lies: no shuffle, and each configuration reads the same input row. Without ``texts`` a
    chunk has, in place of its text, the buckets that ``with_buckets`` finds in it: a document's words are hashed once for
    all configurations, and no text is copied.
    """
    if not texts:
        return _cut_buckets(documents, configs, overlap)
    carried = [c for c in documents.columns if c not in ("body", "title")]
    options = F.array(*[
        F.struct(F.lit(name).alias("config"), text.chunks(F.col("body"), size, overlap).alias("pieces"))
        for name, size in configs.items()
    ])
    per_config = documents.select(*carried, "title", F.inline(options))
    pieces = per_config.select(*carried, "title", "config", F.posexplode("pieces").alias("chunk_index", "piece"))
    return pieces.select(
        "config",
        F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"),
        *carried,
        "chunk_index",
        F.concat(F.col("title"), F.lit(".\n"), F.col("piece")).alias("text"),
    )


def _cut_buckets(documents: DataFrame, configs: dict[str, int | None], overlap: int) -> DataFrame:
    carried = [c for c in documents.columns if c not in ("body", "title")]
    inputs = bounded_batches(documents.select(*carried, F.lower("title").alias("_title"), F.lower("body").alias("_body")))
    kept = [f for f in inputs.schema.fields if f.name in carried]
    schema = T.StructType([
        T.StructField("config", T.StringType()), *kept, T.StructField("chunk_index", T.IntegerType()),
        T.StructField("buckets", T.ArrayType(T.IntegerType())),
    ])
    names = list(configs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for bodies in text.steps(batch.column("_body")):
                part = batch.slice(start, len(bodies))
                start += len(bodies)
                config, doc, index, buckets = _pieces(part, list(configs.values()), overlap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(config)), *[part.column(c).take(pa.array(doc)) for c in carried],
                     pa.array(index, pa.int32()), buckets],
                    names=["config", *carried, "chunk_index", "buckets"],
                )

    pieces = inputs.mapInArrow(cut, schema)
    chunk_id = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index"))
    return pieces.select("config", chunk_id.alias("chunk_id"), *carried, "chunk_index", "buckets")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists one after the other, and where each list begins and the last ends; null is empty."""
    sizes = pa.compute.coalesce(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _pieces(part: pa.RecordBatch, sizes: list[int | None], overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(number of the configuration, row of the document, chunk index, buckets) of the chunks of some documents."""
    body, title = part.column("_body"), part.column("_title")
    paragraphs, tokens_before = text.paragraph_words(body)
    values, _ = text.hashed_tokens(body)
    titles, title_starts = text.hashed_tokens(title)
    title_starts = np.array(title_starts)
    has_body, has_title = body.is_valid().to_numpy(zero_copy_only=False), title.is_valid().to_numpy(zero_copy_only=False)
    config, doc, index, first, last = [], [], [], [], []
    at = 0  # the document's first word in the batch
    for row, words in enumerate(paragraphs):
        n = sum(words)
        for number, size in enumerate(sizes):
            cuts = [(0, n)] if size is None else text.cuts(words, size, overlap)
            config += [number] * len(cuts)
            doc += [row] * len(cuts)
            index += range(len(cuts))
            first += [at + a for a, _ in cuts]
            last += [at + b for _, b in cuts]
        at += n
    config, doc, index, first, last = (np.array(x, dtype=np.int64) for x in (config, doc, index, first, last))
    # Each chunk is two runs of one array of buckets: its title's and its words'.
    runs = np.empty((len(doc), 2, 2), dtype=np.int64)
    runs[:, 0, 0], runs[:, 0, 1] = title_starts[doc], title_starts[doc + 1]
    runs[:, 1, 0], runs[:, 1, 1] = tokens_before[first] + len(titles), tokens_before[last] + len(titles)
    lengths = (runs[:, :, 1] - runs[:, :, 0]).ravel()
    ends = np.cumsum(lengths)
    picked = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(runs[:, :, 0].ravel() - (ends - lengths), lengths)
    offsets = np.concatenate([[0], ends[1::2]]).astype(np.int32)
    missing = ~(has_body & has_title)[doc]
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.concatenate([titles, values])[picked].astype(np.int32), pa.int32()),
        mask=pa.array(missing) if missing.any() else None,
    )
    return config, doc, index, lists


def chunk_statistics(chunked: DataFrame) -> DataFrame:
    n = F.size(text.words(F.col("text")))
    return chunked.groupBy("config").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.bround(F.sum(n) / F.count(F.lit(1)), 1).alias("mean_words"),
        F.max(n).alias("max_words"),
    )


def with_buckets(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("buckets", text.buckets(F.col(column)))


def hashed_weights(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The L2-normalised hashed bag of words in sparse form: (key, bucket, weight)."""
    counted = df.select(key, F.explode(text.buckets(F.col(column))).alias("bucket")).groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )
    norms = counted.groupBy(key).agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    return counted.join(norms, key).select(key, "bucket", (F.col("n") / F.sqrt("squares")).alias("weight"))


def hashed_embeddings(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The same vectors as dense arrays (at most 384 entries are collected per key)."""
    sparse = hashed_weights(df, key, column).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("weights")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(text.DIMENSIONS - 1)),
        lambda b: F.coalesce(F.try_element_at("weights", b), F.lit(0.0)).cast("float"),
    )
    found = sparse.select(key, dense.alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), text.DIMENSIONS)
    return df.select(key).join(found, key, "left").withColumn("embedding", F.coalesce("embedding", zeros))


# ---- exact search -----------------------------------------------------------------------------------


def bucket_matrix(lists: pd.Series | pa.Array) -> np.ndarray:
    """Word counts per bucket, one row per list of buckets."""
    values, starts = _lists(lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.int32())))
    n = len(starts) - 1
    cells = np.repeat(np.arange(n) * text.DIMENSIONS, np.diff(starts)) + values
    return np.bincount(cells, minlength=n * text.DIMENSIONS).reshape(n, text.DIMENSIONS).astype(float)


def dense_matrix(vectors: pd.Series | pa.Array) -> np.ndarray:
    vectors = vectors.to_pandas() if isinstance(vectors, pa.Array) else vectors
    return np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _ratio(product: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    # Values this close are ties (broken by id), whatever order the products were added in.
    return np.round(np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0), 12)


def _cosine(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return _ratio(rows @ wanted.T, np.sqrt(np.outer((rows * rows).sum(axis=1), (wanted * wanted).sum(axis=1))))


def _unit(rows: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Rows of length one, or zero, in single precision."""
    return (rows * np.divide(1.0, np.sqrt(squares), out=np.zeros_like(squares), where=squares > 0)[:, None]).astype(np.float32)


def _query_blocks(queries: DataFrame) -> list[DataFrame]:
    """Blocks of queries small enough to hand to every task; more queries simply make more blocks."""
    n = queries.count()
    if n <= _QUERIES_PER_BLOCK:
        return [queries]
    numbered = row_positions(queries, ["query_id"], "_place")
    edges = range(0, n, _QUERIES_PER_BLOCK)
    return [
        numbered.filter((F.col("_place") > at) & (F.col("_place") <= at + _QUERIES_PER_BLOCK)).drop("_place") for at in edges
    ]


def search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    vector: str,
    to_matrix: Callable[[pd.Series], np.ndarray],
    policies: list[str] = ["include"],  # noqa: B006
    group: str | None = None,
) -> DataFrame:
    """The exact top ``k`` corpus rows per query and policy (and ``group``, e.g. a chunk configuration).

    ``queries`` has query_id and the vector; ``corpus`` has chunk_id, doc_id, deprecated and the vector.
    Every task scores its own rows against one block of queries and keeps its best k per query, so no
    pair beyond those is ever emitted; the survivors are ranked per query. Rows without a vector are not found.
    """
    corpus = bounded_batches(corpus.select(
        (F.col(group) if group else F.lit("all")).alias("grouping"),
        "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "deprecated", F.col(vector).alias("vector"),
    ))
    schema = "policy string, query_id string, grouping string, chunk_id string, doc_id string, similarity double, score double"
    context = corpus.sparkSession.sparkContext
    found = []
    asking = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col(vector).alias("vector"))
    blocks = _query_blocks(asking.filter(F.col("vector").isNotNull()))
    if len(blocks) > 1:
        corpus = durable(corpus)  # read by every block, so not made anew for each
    for block in blocks:
        asked = block.orderBy("query_id").toPandas()  # at most one block of queries
        if asked.empty:
            continue
        shared = context.broadcast((asked["query_id"].to_numpy(), to_matrix(asked["vector"])))

        def best_of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wanted = shared.value
            step = max(256, _SCORES_PER_STEP // len(ids))
            best: dict[str, _Best] = {}
            for batch in batches:
                batch = batch.filter(batch.column("vector").is_valid())
                for start in range(0, batch.num_rows, step):
                    rows = batch.slice(start, step)
                    names = rows.column("grouping").dictionary_encode()
                    codes = names.indices.to_numpy(zero_copy_only=False)
                    for code, name in enumerate(names.dictionary.to_pylist()):
                        part = rows if len(names.dictionary) == 1 else rows.take(pa.array(np.flatnonzero(codes == code)))
                        if name not in best:
                            best[name] = _Best(wanted, k, policies)
                        best[name].add(part, to_matrix)
            for name, of_group in best.items():
                for policy, hits in of_group.rows().items():
                    out = hits.assign(policy=policy, grouping=name, query_id=ids[hits["query"].to_numpy()])[_HIT_COLUMNS]
                    yield pa.RecordBatch.from_pandas(out, schema=_HITS, preserve_index=False)

        found.append(corpus.mapInArrow(best_of, schema))
    candidates = reduce(DataFrame.unionByName, found)
    best_first = Window.partitionBy("policy", "grouping", "query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = candidates.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("grouping", group or "grouping") if group else ranked.drop("grouping")


_HITS = pa.schema([(c, pa.float64() if c in ("similarity", "score") else pa.string()) for c in _HIT_COLUMNS])


def _keep_best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k rows per query, equal scores in id order."""
    ordered = rows.sort_values(["query", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return ordered[ordered.groupby("query").cumcount() < k]


class _Best:
    """The best k rows met so far for every query of a block, under each policy.

    A product of rounded unit vectors, whose error has a bound, rules out the pairs that are surely behind the k-th best;
    the others are scored exactly. They are gathered, and ranked when they have become many.
    """

    def __init__(self, wanted: np.ndarray, k: int, policies: list[str]) -> None:
        self._wanted, self._k, self._policies = wanted, k, policies
        self._squares = (wanted * wanted).sum(axis=1)
        self._unit = _unit(wanted, self._squares).T
        self._error = np.float32(1e-6 + 2.4e-7 * wanted.shape[1])
        self._floor = {p: np.full(len(wanted), -np.inf) for p in policies}  # the k-th best score, once there are k
        self._met: dict[str, list[pd.DataFrame]] = {p: [] for p in policies}
        self._new = 0

    def add(self, part: pa.RecordBatch, to_matrix) -> None:
        rows = to_matrix(part.column("vector"))
        old = part.column("deprecated").to_numpy(zero_copy_only=False).astype(bool)
        squares = (rows * rows).sum(axis=1)
        near = _unit(rows, squares) @ self._unit
        least = np.min([self._floor[p] for p in self._policies], axis=0)
        picked = near >= (least - self._error).astype(np.float32)
        if np.count_nonzero(picked) > 4 * self._k * len(self._wanted):
            picked &= near >= self._least_here(near, old) - 2 * self._error
        at, query = np.nonzero(picked)
        if not len(at):
            return
        if 16 * len(at) > near.size:
            similarity = _cosine(rows, self._wanted)[at, query]
        else:
            product = np.concatenate([
                np.einsum("ij,ij->i", rows[at[i:i + 4096]], self._wanted[query[i:i + 4096]]) for i in range(0, len(at), 4096)
            ])
            similarity = _ratio(product, np.sqrt(squares[at] * self._squares[query]))
        if len(at) > 2 * self._k * len(self._wanted):  # ids are looked up for fewer
            stays = np.zeros(len(at), dtype=bool)
            for policy in self._policies:
                stays |= self._in_reach(policy, similarity, old[at], query)
            at, query, similarity = at[stays], query[stays], similarity[stays]
        used, place = np.unique(at, return_inverse=True)
        chunk, doc = (part.column(c).take(pa.array(used)).to_numpy(zero_copy_only=False)[place] for c in ("chunk_id", "doc_id"))
        for policy in self._policies:
            reach = self._in_reach(policy, similarity, old[at], query)
            score = similarity - DEPRECATED_PENALTY * old[at] if policy == "penalize" else similarity
            if reach.any():
                self._met[policy].append(pd.DataFrame({
                    "query": query[reach], "chunk_id": chunk[reach], "doc_id": doc[reach],
                    "similarity": similarity[reach], "score": score[reach],
                }))
                self._new += int(reach.sum())
        if self._new > 2 * self._k * len(self._wanted) * len(self._policies) or np.isneginf(least).any():
            self.rows()

    def _in_reach(self, policy: str, similarity: np.ndarray, old: np.ndarray, query: np.ndarray) -> np.ndarray:
        score = similarity - DEPRECATED_PENALTY * old if policy == "penalize" else similarity
        reach = score >= self._floor[policy][query]
        return reach & ~old if policy == "exclude" else reach

    def _least_here(self, near: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Per query, the least of the policies' k-th best similarities among these rows alone."""
        out = np.full(near.shape[1], np.inf, dtype=np.float32)
        for policy in self._policies:
            score = near[~old] if policy == "exclude" else near - np.float32(DEPRECATED_PENALTY) * old[:, None].astype(np.float32) if policy == "penalize" else near
            if len(score):
                place = len(score) - min(self._k, len(score))
                out = np.minimum(out, np.partition(score, place, axis=0)[place])
        return out

    def rows(self) -> dict[str, pd.DataFrame]:
        """The best rows of each policy that has any."""
        out = {}
        for policy, parts in self._met.items():
            if not parts:
                continue
            kept = out[policy] = _keep_best(pd.concat(parts), self._k)
            self._met[policy] = [kept]
            last = kept.groupby("query")["score"].agg(["size", "min"])
            full = last[last["size"] == self._k]
            self._floor[policy][full.index.to_numpy()] = full["min"].to_numpy()
        self._new = 0
        return out


# ---- document ranking and metrics -------------------------------------------------------------------


def document_ranks(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Documents in the order of their first hit (a handful per query)."""
    first = hits.groupBy(*keys, "doc_id").agg(F.min("rank").alias("first_rank"))
    order = Window.partitionBy(*keys).orderBy("first_rank")
    return first.select(*keys, "doc_id", F.row_number().over(order).alias("doc_rank"))


def context_blocks(hits: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """The text shown for a query: one labelled block per hit, best first (k hits per query)."""
    shown = F.concat(
        F.lit("[doc: "), F.col("doc_id"), F.lit(" | "), F.col("doc_type"), F.lit(" | updated "),
        F.col("last_updated").cast("string"), F.lit(" | "),
        F.when(F.col("deprecated"), F.concat(F.lit("DEPRECATED, superseded by "), F.coalesce("superseded_by", F.lit("none"))))
        .otherwise("current"),
        F.lit("]\n"), F.col("text"),
    )
    detail = corpus.select("chunk_id", "doc_type", "last_updated", "deprecated", "superseded_by", "text")
    joined = detail.join(hits.select(*keys, "chunk_id", "doc_id", "rank"), "chunk_id")
    return joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("block")))).alias("b")).select(
        *keys, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context")
    )


def rarest_word_relevance(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, kind): documents holding the question's rarest word; deprecated ones are traps."""
    asked = questions.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    # Only the questions' words are looked for, so frequent words of the documents are not shuffled.
    frequency = holding(documents, asked.select("word").distinct()).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    best = asked.join(frequency, "word").groupBy("query_id").agg(F.min(F.struct("docs", "word")).alias("best"))
    rarest = durable(best.select("query_id", F.col("best.word").alias("word")))
    # One word per question is left, so that of the documents only the rows of these words are kept and joined.
    return rarest.join(holding(documents, rarest.select("word").distinct()), "word").select(
        F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("deprecated"), "trap").otherwise("relevant").alias("kind"),
    )


def holding(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, deprecated, word) of every document and each of these different words that its text holds."""
    if words.count() > _BROADCAST_WORDS:
        found = F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")
        return documents.select("doc_id", "deprecated", found).join(words, "word", "left_semi")
    wanted = documents.sparkSession.sparkContext.broadcast([r["word"] for r in words.collect()])  # at most so many words
    texts = bounded_batches(documents.select("doc_id", "deprecated", F.lower("text").alias("_text")))
    schema = T.StructType([*[f for f in texts.schema.fields if f.name != "_text"], T.StructField("word", T.StringType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(wanted.value)}
        every = pa.array(wanted.value, pa.string())
        for batch in batches:
            start = 0
            for part in text.steps(batch.column("_text")):
                found, listed, edges = text.token_lists(part)
                places = np.fromiter((place.get(w, -1) for w in listed), dtype=np.int64, count=len(listed))[found]
                row = np.repeat(np.arange(len(part)), np.diff(edges))[places >= 0]
                pairs = np.unique(row * len(every) + places[places >= 0])
                rows = pa.array(start + pairs // max(1, len(every)))
                start += len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("deprecated").take(rows), every.take(pa.array(pairs % max(1, len(every))))],
                    names=["doc_id", "deprecated", "word"],
                )

    return texts.mapInArrow(look, schema)


def question_scores(doc_ranks: DataFrame, relevance: DataFrame, keys: list[str]) -> DataFrame:
    """recall, hit, reciprocal rank and trap flags per question; ``keys`` ends with query_id."""
    wanted = relevance.groupBy("query_id").agg(F.count_if(F.col("kind") == "relevant").alias("n_relevant")).filter("n_relevant > 0")
    settings = [c for c in keys if c != "query_id"]
    found = doc_ranks.join(relevance, ["query_id", "doc_id"]).groupBy(*keys).agg(
        F.count_if(F.col("kind") == "relevant").alias("hits"),
        F.min(F.when(F.col("kind") == "relevant", F.col("doc_rank"))).alias("first"),
        F.min(F.when(F.col("kind") == "trap", F.col("doc_rank"))).alias("first_trap"),
    )
    every = doc_ranks.select(*keys).distinct().join(wanted, "query_id")
    scored = every.join(found, keys, "left")
    return scored.select(
        *settings, "query_id",
        (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.col("first").isNotNull().cast("double").alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.col("first_trap").isNotNull().cast("double").alias("trap_in_context"),
        F.coalesce(F.col("first_trap").isNotNull() & (F.col("first").isNull() | (F.col("first_trap") < F.col("first"))), F.lit(False))
        .cast("double").alias("trap_above_relevant"),
    )


def at_cuts(hits: DataFrame, cuts: list[int] = CUTS) -> DataFrame:
    """The same hits as seen at every cut-off k (documents are cut by chunk rank before they are ranked)."""
    reached = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("rank") <= c)
    return hits.withColumn("k", F.explode(reached))


def mean_metrics(scores: DataFrame, settings: list[str], subsets: Column) -> DataFrame:
    """Means per setting and question subset; ``subsets`` is an array of subset names."""
    per = scores.withColumn("subset", F.explode(subsets))
    names = ["recall", "hit", "rr", "trap_in_context", "trap_above_relevant"]
    return per.groupBy(*settings, "subset").agg(
        F.count(F.lit(1)).alias("questions"), *[F.bround(F.sum(c) / F.count(F.lit(1)), 4).alias(c) for c in names]
    ).withColumnRenamed("rr", "mrr")


def choose_setting(metrics: DataFrame, policy: str = "penalize") -> DataFrame:
    """The configuration with the best recall at the largest k (ties: MRR), then its smallest k that is
    within the slack of that recall."""
    rows = metrics.filter((F.col("subset") == "all") & (F.col("policy") == policy))
    largest = rows.agg(F.max("k").alias("k")).scalar()
    best = rows.filter(F.col("k") == largest).agg(
        F.max_by(F.struct("config", "recall"), F.struct("recall", "mrr", "config")).alias("b")
    ).scalar()
    near = rows.withColumn("b", best).filter(
        (F.col("config") == F.col("b.config")) & (F.col("recall") >= F.col("b.recall") - CHOICE_SLACK)
    )
    return near.agg(F.min_by(F.struct("config", "k", "policy", "recall", "mrr"), "k").alias("s")).select("s.*")


def misses(doc_ranks: DataFrame, relevance: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with relevant documents of which none was retrieved."""
    relevant = relevance.filter(F.col("kind") == "relevant")
    answerable = questions.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    hit = doc_ranks.join(relevant, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
    return answerable.join(hit, "query_id", "left_anti")
