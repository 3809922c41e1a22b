"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a document's set holds the distinct
five-word shingles (the whole sequence when there are fewer words). Documents with a Jaccard similarity of at
least the threshold are linked, and every link is confirmed on the full sets.

1. One pass over the texts writes per document the set's size, a 128-bit digest of the set and 32 band keys of
   4 densified bins each. At a similarity of 0.75 a pair shares no band once in about 200,000 cases.
2. Documents with equal sets form a class, which its smallest doc_id stands for; copies are counted, not paired.
3. In each bucket (equal band key) the smallest doc_id is the hub, and only hub-member pairs are candidates:
   a bucket of n members gives n - 1 pairs. Pairs whose set sizes alone rule the threshold out are left away.
4. Candidates' sets are written once and intersected. Links give components (iterated minimum labels with
   pointer jumping, each round written to the shared folder).
5. A hub that has met its bucket leaves it. Buckets whose members still lie in more than one component get a new hub,
   chosen by a hash of the round, and members of other components are compared with it; buckets whose members lie
   in one component are done. This repeats until a round brings no new link, at most ``HUB_ROUNDS`` times.
6. The members of buckets that are still open are compared without hubs, all in one step. A set's shingles that other
   components hold too are ordered, rare ones first. Two sets that reach the threshold share one of the first of each
   (prefix filter), and the rest of both lists from their first common shingle on must be long enough for the overlap
   that their sizes ask for (positional filter). That bounds the sizes a set's partner can have at each shingle, so
   sets meet by shingle and size: members of a large group of near copies, or of texts with one common passage, that
   cannot reach the threshold by what they share are not even looked at together. No pair that shares a bucket stays
   undecided.

Null, empty and wordless texts have an empty set and are linked with nothing. Rows with the same doc_id count as
one document; a null doc_id is linked with nothing and its component is null. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import mapped, written
from basketry.llm.vectors import OnePermutation, mixed, shingle_set

THRESHOLD_PERCENT = 75
BIN_BITS, ROWS_PER_BAND = 7, 4
#: Candidate ids up to this many (8 bytes each) are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rounds with new hubs; what they leave open is compared by prefixes.
HUB_ROUNDS = 8
#: Sizes of sets that differ by less than this factor may fall in one step.
SIZE_STEP = 1.05


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lowered(data: bytes | None) -> bytes:
    return (data or b"").lower()  # bytes.lower() changes A-Z alone


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, bands): size and digest of the set, and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OnePermutation(BIN_BITS)
        n_bands = bins.size // ROWS_PER_BAND
        places = mixed(np.arange(1, bins.size + 1, dtype=np.uint64)).reshape(n_bands, ROWS_PER_BAND) | np.uint64(1)
        for batch in batches:
            sizes, digests, bands = [], [], []
            for data in batch.column(1):
                own = shingle_set(_lowered(data.as_py()))
                sizes.append(len(own))
                if len(own):
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    rows = bins.sketch(own).reshape(n_bands, ROWS_PER_BAND)
                    bands.append(_signed(mixed((mixed(rows) * places).sum(1, dtype=np.uint64))))
                else:
                    digests.append(None)
                    bands.append(np.empty(0, np.int64))
            offsets = pa.array(np.r_[0, np.cumsum([len(b) for b in bands])].astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), keys], ["doc_id", "n", "digest", "bands"]
            )

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return mapped(slim, run, "doc_id long, n long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) with sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_signed(shingle_set(_lowered(x.as_py()))) for x in batch.column(1)]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "shingles"])

    return mapped(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "doc_id long, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node reachable.

    Each round every node takes the smallest label of its neighbours and itself and then the label of that
    label, so paths shorten by more than half; a round is written before the next one reads it.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        least = heard.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(least.join(jump, "label").select("node", F.least("label", "far").alias("label")), "labels")
        changed = new.join(labels, ["node", "label"], "left_anti").limit(1).count()
        labels = new
        if not changed:
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only the linked components are joined to each other, not their members again."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left")
    ends = written(ends.select("node", "label", F.coalesce("label", "node").alias("root")), "ends")
    roots = links.join(ends.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(
        ends.select(F.col("node").alias("b"), F.col("root").alias("y")), "b"
    )
    joined = components(roots.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b").distinct())
    known = labels.union(ends.filter("label is null").select("node", "root"))
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("low"))
    return written(known.join(moved, "label", "left").select("node", F.coalesce("low", "label").alias("label")), "merged")


def _sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The sets of the documents with these distinct ids."""
    ids = written(ids, "candidates")
    few = ids.count() <= BROADCAST_IDS
    return shingle_sets(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return _agreeing(pairs, written(_sets_of(ids, texts), "sets"), percent)


def _agreeing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    together = F.size("a_set") + F.size("b_set") - shared
    return pairs.join(left, "a").join(right, "b").filter(100 * shared >= percent * together).select("a", "b").distinct()


def _fits(percent: int, one: str = "hub.n", other: str = "n"):
    """Set sizes that do not rule the threshold out."""
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, doc_id, n, label, most): the shingles of which one is shared by every two sets of different labels that
    reach the threshold, and the largest size of a partner whose first common shingle it is.

    Such sets share at least ``least`` shingles of each, so whatever the order of all shingles, the first shared one
    is among the first n - least + 1 of both. Shingles of one label alone are shared by no such sets; they come
    first and are left away. The others are ordered by the number of sets with them. From the first common shingle on,
    no more than ``left`` can be shared, and sets of sizes n and m have to share percent / (100 + percent) of n + m.
    """
    shingles = sets.select("entry", "label", F.explode("shingles").alias("shingle"))
    spread = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
    spread = spread.filter("low != high").select("shingle", "sets")
    shared = shingles.join(spread, "shingle").groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
    least = F.ceil(F.col("n") * percent / 100)
    first = (F.size("shared") - least + 1).cast("int")
    cut = sets.select("entry", "doc_id", "n", "label").join(shared, "entry").filter(first > 0)
    cut = cut.select("doc_id", "n", "label", F.size("shared").alias("all"), F.posexplode(F.slice("shared", F.lit(1), first)).alias("at", "s"))
    left = F.col("all") - F.col("at")
    return cut.select("s.shingle", "doc_id", "n", "label", (F.floor(left * (100 + percent) / percent) - F.col("n")).alias("most"))


def _size_step(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different labels whose first common shingle leaves room for the threshold.

    Of a pair the smaller set (by size, then id) stands in the step of its size, and the larger one in every step that a
    smaller partner can be in. A shingle's largest label is not paired with itself.
    """
    sizes = prefixes.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("shingle").agg(
        F.max_by("label", F.struct("size", "label")).alias("largest"), F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low != high").select("shingle", "largest")
    marked = written(prefixes.join(largest, "shingle").withColumn("main", F.col("label") == F.col("largest")).drop("largest"), "prefixes")

    fewest, at_most = F.ceil(F.col("n") * percent / 100), F.least("most", "n")
    small = marked.filter("most >= n").withColumn("step", _size_step(F.col("n"))).select(
        "shingle", "step", F.col("doc_id").alias("x"), F.col("n").alias("x_n"), F.col("label").alias("x_label"), F.col("most").alias("x_most"), F.col("main").alias("x_main"))
    large = marked.filter(at_most >= fewest).withColumn("step", F.explode(F.sequence(_size_step(fewest), _size_step(at_most))))
    fits = "label != x_label and n <= x_most and x_n <= most and (x_n < n or x_n = n and x < doc_id)"
    possible = (100 * F.col("x_n") >= percent * F.col("n")) & F.expr(fits)
    met = [
        one.join(other, ["shingle", "step"]).filter(possible)
        for one, other in ((small.filter("not x_main"), large), (small.filter("x_main"), large.filter("not main")))
    ]
    return met[0].union(met[1]).select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()


def _rest(open_: DataFrame, tested: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All links between different components among the members of open buckets that are not among those tested."""
    members = written(open_.select("doc_id", "label").distinct(), "members")
    sets = _sets_of(members.select("doc_id"), texts).join(members, "doc_id")
    sets = sets.select("doc_id", "label", F.size("shingles").cast("long").alias("n"), "shingles", F.monotonically_increasing_id().alias("entry"))
    sets = written(sets.filter("n > 0"), "open_sets")
    pairs = _meetings(written(_prefixes(sets, percent), "shared"), percent)
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    return written(_agreeing(pairs, sets.select("doc_id", "shingles"), percent), "confirmed")


def groups(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = written(signatures(texts), "signatures")
    linked = marks.filter("n > 0 and doc_id is not null")

    # Classes of equal sets; a class is known by its smallest doc_id.
    classes = written(linked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = classes.filter("copies > 1").select("digest", "first")
    copies = linked.select("digest", "doc_id").join(copied, "digest").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).filter("a != b")
    stand_ins = linked.join(classes.select(F.col("first").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")

    # Buckets with more than one member, written once for all rounds.
    placed = stand_ins.select("doc_id", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.max("doc_id").alias("last"))
    shared = shared.filter("hub.doc_id != last").select("band", "hub")
    buckets = written(placed.join(shared, "band").select("band", "doc_id", "n", "hub"), "buckets")

    star = buckets.filter(_fits(percent)).filter("hub.doc_id != doc_id")
    pairs = written(star.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    labels = components(written(_confirmed(pairs, texts, percent), "confirmed"))
    # A hub has met its whole bucket, so only the others go on.
    open_ = buckets.filter("hub.doc_id != doc_id").select("band", "doc_id", "n")
    tested = pairs
    for turn in range(1, HUB_ROUNDS + 1):
        open_ = written(_with_new_hubs(open_, labels, turn), "open")
        met = open_.filter("hub.label != label").filter(_fits(percent))
        pairs = met.select(F.least("hub.doc_id", "doc_id").alias("a"), F.greatest("hub.doc_id", "doc_id").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = written(_confirmed(pairs, texts, percent), "confirmed")
        tested = tested.union(pairs)
        open_ = open_.filter("hub.doc_id != doc_id").select("band", "doc_id", "n")
        if not found.limit(1).count():
            break
        labels = _merged(labels, found)
    open_ = written(_with_new_hubs(open_, labels, HUB_ROUNDS + 1), "open")
    if open_.limit(1).count():
        found = _rest(open_, tested, texts, percent)
        if found.limit(1).count():
            labels = _merged(labels, found)

    # Copies hang on their class's stand-in, so one more lookup gives their component.
    named = written(copies.join(labels.withColumnRenamed("node", "a"), "a", "left").select(
        F.col("b").alias("doc_id"), F.coalesce("label", "a").alias("component_id")
    ).union(labels.select("node", "label")).groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "named")
    judged = marks.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return judged.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _with_new_hubs(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of the buckets that still lie in more than one component, with their label and a hub of this turn."""
    at = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    at = at.select("band", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    order = F.xxhash64(F.lit(turn), "doc_id")
    opened = at.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("doc_id", "n", "label"), order).alias("hub")
    )
    return at.join(opened.filter("low != high").select("band", "hub"), "band")


def keep_one_of_each_group(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` without the documents whose group keeps another one; all columns as they are."""
    dropped = groups(docs, percent).filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
