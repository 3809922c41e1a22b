"""K-d tree partitioning into shards of near-equal bytes.

Every document has coordinates that depend on its text alone, so that equal texts lie together whatever their labels:
bytes, bytes a character (which tells scripts and accented languages apart) and bytes a word. A node is split at the weighted median (weights are bytes) along its widest dimension, widths taken
relative to the whole corpus, until it is one shard. Medians are exact and distributed: a histogram of byte sums
over the node's range is aggregated, the bin with the median is cut again into bins, until it holds a single value.
Ties along a dimension are ordered by the text's checksum; cuts fall between two checksums, at the one nearer to the
median, so equal texts lie in one shard. Only where that leaves a node more than ``TOLERANCE_PERCENT`` off balance,
because one group of copies is very large, the cut goes through the group, by doc_id.

The driver sees at most nodes times bins sums at a time. The texts are read once, to write (doc_id, size,
checksum, coordinates); all passes after that read this narrow table. Slots come from range-partitioned rows and
per-partition counts, so no shard is ordered in one task.

Null texts have no bytes (size 1) and checksum 0. Repeated rows get slots of their own; null doc_ids sort first. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.tables import written

TOLERANCE_PERCENT = 3
#: Bits resolved by one histogram pass.
BIN_BITS = 10
#: A dimension value (31 bits) and the text's checksum (32 bits) make one sortable key of 63 bits.
KEY_BITS = 63
DIMENSIONS = ("size", "character", "word")


@dataclass
class Cut:
    """Rows of ``node`` go left when (key along the dimension, doc_id) is at most (key, doc_id)."""

    node: int
    dimension: str
    key: int
    doc_id: int | None


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key_size, key_character, key_word), written once."""
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary"))
    n_bytes = F.octet_length(text).cast("long")
    size = n_bytes + 1
    keyed = {
        "size": F.least(size, F.lit((1 << 31) - 1)),
        "character": F.floor(1_000_000 * n_bytes / F.greatest(F.length(text), F.lit(1))),
        "word": F.least(F.floor(1000 * n_bytes / (1 + F.length(text) - F.length(F.replace(text, F.lit(" "))))), F.lit((1 << 31) - 1)),
    }
    keys = [F.shiftleft(v, 32).bitwiseOR(crc).alias(f"key_{k}") for k, v in keyed.items()]
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *keys), "described")


def node_of(cuts: list[Cut]) -> Column:
    """The node after all cuts, as one expression: children of node n are 2n (left) and 2n + 1."""
    node = F.lit(1)
    depth = lambda c: c.node.bit_length()
    for level in sorted({depth(c) for c in cuts}):
        step = node
        for c in (c for c in cuts if depth(c) == level):
            key = F.col(f"key_{c.dimension}")
            left = key < c.key if c.doc_id is None else (key < c.key) | ((key == c.key) & F.coalesce(F.col("doc_id") < c.doc_id, F.lit(True)))
            step = F.when(node == c.node, F.when(left, 2 * c.node).otherwise(2 * c.node + 1)).otherwise(step)
        node = step
    return node


def _histogram(rows: DataFrame, value: dict[int, Column], low: dict[int, int], shift: dict[int, int]) -> dict[int, dict[int, int]]:
    """Of each node, byte sums per bin of 2**shift values from low on; bins are few, whatever the rows."""
    which = F.lit(None).cast("long")
    for n, v in value.items():
        inside = (v >= low[n]) & (F.shiftright(v - low[n], shift[n]) < (1 << BIN_BITS))
        which = F.when((F.col("node") == n) & inside, F.shiftright(v - low[n], shift[n])).otherwise(which)
    sums = rows.select("node", which.alias("bin"), "size").filter("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("s"))
    found: dict[int, dict[int, int]] = {}
    for r in sums.collect():
        found.setdefault(r["node"], {})[r["bin"]] = r["s"]
    return found


def _search(rows: DataFrame, value: dict[int, Column], bits: int, low: dict[int, int], wanted: dict[int, float]) -> dict[int, tuple[int, float, float]]:
    """Of each node the value with the weighted median: (value, bytes before it, its bytes)."""
    low, before, weight = dict(low), {n: 0.0 for n in value}, {n: 0.0 for n in value}
    left = bits
    while left > 0:
        left = max(0, left - BIN_BITS)
        bins = _histogram(rows, value, low, {n: left for n in value})
        for n in value:
            for b, s in sorted(bins.get(n, {}).items()):
                weight[n], last = s, b
                if before[n] + s >= wanted[n]:
                    break
                before[n] += s
            else:
                before[n] -= weight[n]  # rounding: take the last bin
            low[n] += last << left
    return {n: (low[n], before[n], weight[n]) for n in value}


def _cuts_of_level(rows: DataFrame, shares: dict[int, tuple[int, int]], widths: dict[str, int]) -> list[Cut]:
    """The cut of each node in ``shares``, which has its (left, all) numbers of shards."""
    spans = rows.filter(F.col("node").isin(list(shares))).groupBy("node").agg(
        F.sum("size").alias("bytes"), *[f(f"key_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    ).collect()
    widest = {r["node"]: max(DIMENSIONS, key=lambda d, r=r: ((r[f"high_{d}"] >> 32) - (r[f"low_{d}"] >> 32)) / max(1, widths[d])) for r in spans}
    wanted = {r["node"]: r["bytes"] * shares[r["node"]][0] / shares[r["node"]][1] for r in spans}
    value = {n: F.col(f"key_{d}") for n, d in widest.items()}
    found = _search(rows, value, KEY_BITS, {n: 0 for n in value}, wanted)
    cuts, heavy = [], {}
    for r in spans:
        n = r["node"]
        key, before, weight = found[n]
        key_cut = key if wanted[n] - before <= before + weight - wanted[n] else key + 1
        off = min(wanted[n] - before, before + weight - wanted[n])
        if 100 * off > TOLERANCE_PERCENT * wanted[n]:
            heavy[n] = (key, wanted[n] - before)
        else:
            cuts.append(Cut(n, widest[n], key_cut, None))
    if heavy:
        inside = rows.filter(F.greatest(F.lit(False), *[(F.col("node") == n) & (value[n] == key) for n, (key, _) in heavy.items()]))
        ids = F.coalesce("doc_id", F.lit(0))
        lows = {r["node"]: (r["low"], r["high"]) for r in inside.groupBy("node").agg(F.min(ids).alias("low"), F.max(ids).alias("high")).collect()}
        bits = max(1, *((high - low).bit_length() for low, high in lows.values()))
        by_id = _search(inside, {n: ids for n in heavy}, bits, {n: lows[n][0] for n in heavy}, {n: w for n, (_, w) in heavy.items()})
        for n, (key, want) in heavy.items():
            doc_id, before, weight = by_id[n]
            cuts.append(Cut(n, widest[n], key, doc_id if want - before <= before + weight - want else doc_id + 1))
    return cuts


def tree(rows: DataFrame, shards: int) -> tuple[list[Cut], dict[int, int]]:
    """All cuts, and the shard of each leaf node; leaves are numbered from the left."""
    total = rows.agg(*[f(f"key_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).head()
    cuts: list[Cut] = []
    sizes, leaves = {1: shards}, {}
    if total["low_size"] is None:
        return [], {1: 0}
    widths = {d: (total[f"high_{d}"] >> 32) - (total[f"low_{d}"] >> 32) for d in DIMENSIONS}
    while sizes:
        shares = {n: (s // 2, s) for n, s in sizes.items() if s > 1}
        leaves.update({n: n for n, s in sizes.items() if s == 1})
        if not shares:
            break
        made = _cuts_of_level(rows.withColumn("node", node_of(cuts)), shares, widths)
        cut = {c.node for c in made}
        leaves.update({n: n for n in shares if n not in cut})  # nodes without rows
        cuts += made
        sizes = {c: k for n in cut for c, k in ((2 * n, shares[n][0]), (2 * n + 1, shares[n][1] - shares[n][0]))}
    order = sorted(leaves, key=lambda n: f"{n:b}"[1:])
    return cuts, {n: i for i, n in enumerate(order)}


def with_slots(placed: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 by doc_id; counts per partition stand in for one ordering task."""
    keys = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32"]
    laid = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = written(laid, "laid_out").withColumn("_slice", F.shiftright("_at", 33))
    per_slice = kept.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("shard", "_slice", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = kept.join(F.broadcast(offsets), ["shard", "_slice"])  # one row per shard and slice
    return numbered.withColumn("slot", F.col("before") + F.col("_at") - F.col("first"))


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near-equal bytes."""
    rows = described(docs)
    cuts, numbers = tree(rows, shards)
    of_leaf = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    placed = rows.select("doc_id", "size", "text_crc32", of_leaf[node_of(cuts)].cast("int").alias("shard"))
    return with_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """So many shards that each has at most about ``target_bytes``."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).head()["n"] or 0
    return max(1, -(-total // target_bytes))
