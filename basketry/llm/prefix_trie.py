"""Prefix trie of conversations: double-array tries per range of sequences, upper nodes merged globally.

A conversation is a sequence of turns (role, text), nulls read as empty, ordered by turn (null first; equal turns by
the digest of role and text). Each distinct sequence of first d turns is a node at depth d; the root has depth 0.

1. A turn becomes a 128-bit digest of its role and text and the number of its words, 40 hexadecimal digits together;
   a conversation becomes the path of its turns. Texts go no further.
2. Equal paths are one sequence with its members counted. The members' ids are dealt by ranges of (sequence, id), so a
   sequence that a third of all conversations share is joined up in many tasks; the digest of the joined ids then reads
   one string per range, in order.
3. Sequences are sorted and dealt by ranges, longer ones before their own prefixes. A task cuts its range into shards
   of bounded size. In a shard turns get dense ids and the trie is packed into BASE and CHECK: the child of state s by
   turn t is BASE[s] + t, and CHECK of it is s. Walking the sequences through them adds up members; going up by CHECK,
   deepest states first, adds up subtrees.
4. Only the nodes on a shard's first and last path can be in other shards too. They carry a digest of their path and
   are added up by Spark. What must be counted once for a node (words, children, leaves) is counted by the first shard
   that has it: a shard knows the sequence before its own first one, and across tasks one row per task tells what
   was counted twice.

Rows without conv_id belong to no conversation and are left out. Repeated rows are repeated turns. A conversation is
held in one row (40 characters a turn), never its texts. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.tables import mapped, written

#: Hexadecimal digits of a turn in a path: its digest and the number of its words.
CELL, DIGEST = 40, 32
#: Turns of all sequences of a shard together; a longer sequence is a shard of its own.
SHARD_TURNS = 200_000
#: Sorts behind every digit, so a path comes after the paths that it is a prefix of.
_END = "~"
#: Characters of member ids joined in one row.
_JOINED = 1 << 20
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, cell): the cell is the turn's digest and the number of its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    cell = F.concat(digest, F.lpad(F.lower(F.hex(words)), CELL - DIGEST, "0"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", cell.alias("cell")).filter("conv_id is not null")


def _in_order(rows: str = "turn", cell: str = "cell") -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(rows, cell))), lambda x: x[cell])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of the conversations as they stand."""
    return turns(conversations).groupBy("conv_id").agg(F.array_join(_in_order(), "").alias("path"))


def branched_paths(conversations: DataFrame, siblings: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, path) of conversations that begin like the first one of their ``siblings``.

    The first crc32(conv_id) mod ``heads`` turns come from conversation c - c % siblings (fewer if it has fewer, none if
    it is absent), the rest from the own turns behind as many. One shuffle by the first sibling's id serves both.
    """
    base = F.col("conv_id") - F.col("conv_id") % siblings
    own = turns(conversations).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(_in_order().alias("cells"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("cells", 1, heads))).over(Window.partitionBy("base"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    none = F.array().cast("array<string>")
    rest = F.slice("cells", taken + 1, F.greatest(F.size("cells"), F.lit(1)))
    joined = F.concat(F.slice(F.coalesce("head", none), F.lit(1), taken), rest)
    return own.withColumn("head", head).select("conv_id", F.array_join(joined, "").alias("path"))


def _members(sequences: DataFrame) -> DataFrame:
    """(key, n, low, ends): per sequence its members, the smallest and the digest of all ids in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, size = None, [], 0
        rows: list[tuple] = []

        def close() -> None:
            if ids:
                rows.append((last, ids[0], len(ids), ",".join(map(str, ids)).encode()))

        def out() -> pa.RecordBatch:
            done = list(zip(*rows)) or [(), (), (), ()]
            rows.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], ["key", "first", "n", "ids"])

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last or size > _JOINED:
                    close()
                    last, ids, size = key, [], 0
                ids.append(conv)
                size += 20
            yield out()
        close()
        yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, n, state = None, None, 0, None
        for batch in batches:
            rows: list[tuple] = []
            for key, first, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == last:
                    state.update(b"," + ids)
                    n += count
                else:
                    if last is not None:
                        rows.append((last, n, low, state.hexdigest()))
                    last, low, n, state = key, first, count, hashlib.sha256(ids)
            yield _rows(rows)
        yield _rows([] if last is None else [(last, n, low, state.hexdigest())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        done = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], ["key", "n", "low", "ends"])

    ids = sequences.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = mapped(ids, join, "key string, first long, n long, ids binary")
    return mapped(joined.repartition("key").sortWithinPartitions("key", "first"), digest, "key string, n long, low long, ends string")


class DoubleArray:
    """A trie of shard-local turn ids in two arrays: the child of state s by turn t is base[s] + t, and check of it is s."""

    TRIES = 16

    def __init__(self, children: list[tuple[int, list[int], list[int]]], n_nodes: int) -> None:
        """``children``: (node, turn ids ascending, child nodes), parents before their children; node 0 is the root."""
        self._base, self._check = [0], [0]
        self.state = np.zeros(n_nodes, np.int64)
        free = 1
        for node, ids, below in children:
            free = self._free(free)
            at, slot = None, free
            for _ in range(self.TRIES):
                if all(self._is_free(slot - ids[0] + t) for t in ids):
                    at = slot - ids[0]
                    break
                slot = self._free(slot + 1)
            if at is None:
                at = len(self._check) - ids[0]
            parent = int(self.state[node])
            self._base[parent] = at
            for t, child in zip(ids, below):
                self._take(at + t, parent)
                self.state[child] = at + t
        self.base, self.check = np.array(self._base, np.int64), np.array(self._check, np.int64)

    def _is_free(self, slot: int) -> bool:
        return slot > 0 and (slot >= len(self._check) or self._check[slot] < 0)

    def _free(self, slot: int) -> int:
        while not self._is_free(slot):
            slot += 1
        return slot

    def _take(self, slot: int, parent: int) -> None:
        more = slot + 1 - len(self._check)
        if more > 0:
            self._check.extend([-1] * more)
            self._base.extend([0] * more)
        self._check[slot] = parent

    def walk(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth from 1 the sequences that reach it and their states; all sequences go down together."""
        live = np.flatnonzero(lengths > 0)
        states, depth = np.zeros(len(live), np.int64), 0
        while len(live):
            below = self.base[states] + ids[starts[live] + depth]
            if not np.array_equal(self.check[below], states):
                raise ValueError("a sequence left the trie")
            depth += 1
            yield live, below
            on = lengths[live] > depth
            live, states = live[on], below[on]


_COLUMNS = [
    ("shard", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("heard", pa.int64()), ("needed", pa.int64()), ("ends", pa.string()), ("first_path", pa.string()), ("last_path", pa.string()),
]
_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _COLUMNS)


def _common(a: str, b: str) -> int:
    """Whole turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CELL
    low, high = 0, n // CELL
    while low < high:  # the longest common prefix in turns by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * CELL] == b[: middle * CELL] else (low, middle - 1)
    return low


def _keys(path: str) -> list[str]:
    """Digests of the path's prefixes, the empty one first."""
    state, keys = hashlib.md5(usedforsecurity=False), []
    keys.append(state.hexdigest())
    for at in range(0, len(path), CELL):
        state.update(path[at : at + CELL].encode())
        keys.append(state.hexdigest())
    return keys


def _words(cell: str) -> int:
    return int(cell[DIGEST:], 16)


class Shard:
    """Consecutive sequences of the sorted order and their trie."""

    def __init__(self, number: int, before: str | None, sequences: list[tuple[str, int, int, str]]) -> None:
        """``before`` is the path in front of the shard's first one, if its task has one."""
        self._number, self._sequences = number, sequences
        parent, cells, depth, stack = [0], [""], [0], [0]
        previous = ""
        self._end, self._new_end = [], []
        for path, *_ in sequences:
            shared = _common(previous, path)
            del stack[shared + 1 :]
            for d in range(shared, len(path) // CELL):
                parent.append(stack[-1])
                cells.append(path[d * CELL : (d + 1) * CELL])
                depth.append(d + 1)
                stack.append(len(parent) - 1)
            self._end.append(stack[-1])
            self._new_end.append(len(path) // CELL > shared or not previous and not path)
            previous = path
        self._parent, self._depth = np.array(parent), np.array(depth)
        self._node_words = np.array([_words(c) if c else 0 for c in cells], np.int64)
        # Nodes up to here on the first path were counted by an earlier shard of the task.
        self._known = -1 if before is None else _common(before, sequences[0][0])
        if self._known == len(sequences[0][0]) // CELL:
            self._new_end[0] = False
        # Dense ids level by level, so that the children of a node mostly have neighbouring ids.
        by_level = np.argsort(self._depth, kind="stable")[1:]
        dense: dict[str, int] = {}
        self._turn = np.zeros(len(parent), np.int64)
        for node in by_level.tolist():
            self._turn[node] = dense.setdefault(cells[node][:DIGEST], len(dense))
        order = by_level[np.lexsort((self._turn[by_level], self._parent[by_level], self._depth[by_level]))]
        cuts = np.flatnonzero(np.diff(self._parent[order], prepend=-1))
        children = [(int(self._parent[part[0]]), self._turn[part].tolist(), part.tolist()) for part in np.split(order, cuts[1:])] if len(order) else []
        self.trie = DoubleArray(children, len(parent))
        self._dense = dense

    def rows(self) -> pa.RecordBatch:
        trie, sequences = self.trie, self._sequences
        lengths = np.array([len(s[0]) // CELL for s in sequences], np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = np.array([self._dense[s[0][at : at + DIGEST]] for s in sequences for at in range(0, len(s[0]), CELL)], np.int64)
        n = np.array([s[1] for s in sequences], np.int64)
        low = np.array([s[2] for s in sequences], np.int64)
        slots = len(trie.check)
        n_convs, lowest = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
        n_convs[0], lowest[0] = n.sum(), low.min()
        for live, states in trie.walk(ids, starts, lengths):
            np.add.at(n_convs, states, n[live])
            np.minimum.at(lowest, states, low[live])

        words, depth, own = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.ones(slots, bool)
        words[trie.state], depth[trie.state] = self._node_words, self._depth
        first_path, last_path = sequences[0][0], sequences[-1][0]
        first = self._states_of(ids[: lengths[0]])
        last = self._states_of(ids[starts[-1] :])
        own[first[: self._known + 1]] = False
        used = np.flatnonzero(trie.check >= 0)
        leaves = np.zeros(slots, np.int64)
        leaves[trie.state[self._end]] = self._new_end
        heard, needed, children = n_convs * words, words * own, np.zeros(slots, np.int64)
        order = used[np.argsort(depth[used], kind="stable")]
        levels = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
        for d in range(int(depth.max()), 0, -1):
            at = order[levels[d - 1] : levels[d]]
            up = trie.check[at]
            np.add.at(children, up, own[at].astype(np.int64))
            for total in (leaves, heard, needed):
                np.add.at(total, up, total[at])

        keys = np.full(slots, None, object)
        for states, path in ((first, first_path), (last, last_path)):
            keys[states] = _keys(path)
        ends = np.full(slots, None, object)
        ends[trie.state[self._end]] = [s[3] for s in sequences]
        up = trie.check[used]
        parent_keys = np.where(used > 0, keys[up], None)
        whole = np.array([k is None for k in parent_keys]) & (used > 0)
        nothing = pa.nulls(len(used), pa.string())
        columns = [
            np.full(len(used), self._number), keys[used], parent_keys, depth[used], lowest[used],
            pa.array(lowest[up], pa.int64(), mask=~whole), n_convs[used], children[used], leaves[used], heard[used], needed[used], ends[used], nothing, nothing,
        ]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS)], [c for c, _ in _COLUMNS])

    def _states_of(self, ids: np.ndarray) -> list[int]:
        one = np.zeros(1, np.int64)
        return [0, *(int(s[0]) for _, s in self.trie.walk(ids, one, one + len(ids)))]


def _row(**values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in _COLUMNS], [n for n, _ in _COLUMNS])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    waiting: list[tuple[str, int, int, str]] = []
    size, before, first = 0, None, None
    for batch in batches:
        for sequence in zip(*(c.to_pylist() for c in batch.columns)):
            if first is None:
                first = sequence[0]
            if waiting and size + len(sequence[0]) // CELL > SHARD_TURNS:
                yield Shard(number, before, waiting).rows()
                number, before, waiting, size = number + 1, waiting[-1][0], [], 0
            waiting.append(sequence)
            size += len(sequence[0]) // CELL
    if waiting:
        yield Shard(number, before, waiting).rows()
        yield _row(shard=TaskContext.get().partitionId(), first_path=first, last_path=waiting[-1][0])


def _counted_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the first shard of a task counted although the task before it has the same nodes, as negative numbers."""
    for batch in batches:
        for before, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shared = _common(before, path)
            inside = shared == len(path) // CELL
            keys, more = _keys(path[: shared * CELL]), 0
            for d in range(shared, -1, -1):
                more += _words(path[(d - 1) * CELL : d * CELL]) if d else 0
                yield _row(key=keys[d], n_convs=0, n_children=-int(d < shared), n_leaves=-int(inside), heard=0, needed=-more)


def nodes(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    sequences = written(paths.select("conv_id", "path", F.md5("path").alias("key")), "paths")
    members = _members(sequences).withColumnRenamed("low", "conv_id")
    distinct = sequences.join(members, ["key", "conv_id"]).select("path", "n", F.col("conv_id").alias("low"), "ends")
    order = F.concat("path", F.lit(_END))
    dealt = distinct.repartitionByRange(order).sortWithinPartitions(order)
    found = written(mapped(dealt, _shards, _SCHEMA), "trie")

    tasks = found.filter("first_path is not null").withColumn("before", F.lag("last_path").over(Window.orderBy("shard")))  # a row per task
    again = mapped(tasks.filter("before is not null").select("before", "first_path"), _counted_twice, _SCHEMA)
    sums = ["n_convs", "n_children", "n_leaves", "heard", "needed"]
    upper = written(
        found.filter("key is not null").union(again).groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends")),
        "upper",
    )
    named = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("known"))
    top = upper.join(named, "parent_key", "left").withColumn("parent_conv_id", F.col("known"))
    # A shard's other nodes find their upper parent by shard and key, so that the root is not one hot key.
    shown = found.filter("key is not null").select("shard", F.col("key").alias("parent_key")).distinct().join(named, "parent_key")
    lower = found.filter("key is null and first_path is null").join(shown, ["shard", "parent_key"], "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "known"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("heard") - F.col("needed")).alias("saved_tokens"),
               F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")]
    return top.select(*columns).union(lower.select(*columns))
