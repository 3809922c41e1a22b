"""Prefix trie, ranked search and language-model scores."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import ngram_scores, prefix_trie, ranked_search
from basketry.llm.tables import table

SF = "/root/testdata/sf0.001"


# Prefix trie

TALKS = "conv_id long, turn long, role string, text string, path string, key long"


def talks(spark):
    """Conversations with null columns, equal and null turns, repeated rows, copies, prefixes of others and one long one."""
    rows = [(c, t, "user", f"turn {t} of all") for c in range(40, 60) for t in range(c % 7)]
    rows += [(7, None, "system", "first of all"), (7, 2, None, "x y"), (7, 1, "user", None), (7, 1, "user", "b"), (7, 1, "user", "b")]
    rows += [(None, 0, "user", "nobody's"), (20, 0, "", ""), (21, 0, None, None), (-5, 0, "user", "below"), (0, 0, "user", "zero zero"), (0, 1, "a", "q")]
    rows += [(30, t, "user", f"long {t} " * 3) for t in range(700)]
    rows += [(c, t, "user", f"turn {t} of all") for c in (110, 111, 113, 115) for t in range(5)]
    return spark.createDataFrame([r + ("p", 1) for r in rows], TALKS).repartition(5)


def brute_trie(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[r.conv_id].append((r.turn is not None, r.turn or 0, digest, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    own = {c: [(d, w) for *_, d, w in sorted(t)] for c, t in own.items()}
    members, ends, words = defaultdict(list), defaultdict(list), {}
    for c, cells in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + cells[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def as_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("turns, partitions", [(prefix_trie.SHARD_TURNS, "8"), (40, "8"), (1, "3")])
def test_trie_against_brute_force(spark, monkeypatch, turns, partitions):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "_JOINED", 40 if turns == 1 else prefix_trie._JOINED)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small ranges apart
    try:
        for docs in (talks(spark), table(spark, SF, "conversations")):
            got = as_rows(prefix_trie.nodes(prefix_trie.branched_paths(docs)))
            want = brute_trie(docs.collect())
            assert got == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_nothing_and_of_plain_conversations(spark):
    docs = talks(spark)
    assert prefix_trie.nodes(prefix_trie.branched_paths(docs.limit(0))).count() == 0
    root = [r for r in as_rows(prefix_trie.nodes(prefix_trie.paths(docs))) if r[1] == 0]
    assert len(root) == 1 and root[0][3] == docs.select("conv_id").distinct().filter("conv_id is not null").count()


def test_double_array_gives_every_child_one_slot():
    rng = np.random.default_rng(3)
    children, n = [], 1
    for node in range(300):
        if node < n:
            ids = sorted(rng.choice(500, rng.integers(1, 9), replace=False).tolist())
            children.append((node, ids, list(range(n, n + len(ids)))))
            n += len(ids)
    trie = prefix_trie.DoubleArray(children, n)
    assert len(set(trie.state.tolist())) == n
    for node, ids, below in children:
        for t, child in zip(ids, below):
            slot = trie.base[trie.state[node]] + t
            assert slot == trie.state[child] and trie.check[slot] == trie.state[node]


# Ranked search

def brute_ranks(items, docs, top):
    def terms(text):
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, asked in wanted.items():
        found = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings, scores", [(ranked_search.BLOCK_POSTINGS, ranked_search.SCORES_AT_ONCE), (30, 1)])
def test_ranks_against_brute_force(spark, monkeypatch, odd, postings, scores):
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "SCORES_AT_ONCE", scores)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(20 + i, "tie tie again Ünï-x_y 42") for i in range(30)], "doc_id long, text string"))
    rows = [(1, "The QUICK brown fox"), (1, "words jumps"), (2, None), (3, ""), (None, "tie again"), (4, "zwei ünïcödé x_y"), (5, "nothing-has-this"), (6, "42 one two THREE token")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("rank", F.lit("r")).withColumn("doc_id", F.lit(1))
    for top in (10, 3):
        got = sorted([tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in ranked_search.search(items, docs, top).collect()], key=str)
        assert got == brute_ranks(rows, docs.collect(), top)


def test_ranks_of_nothing(spark, odd, nothing):
    items = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert ranked_search.search(items, nothing).count() == 0
    assert ranked_search.search(items.limit(0), odd).count() == 0


# Language-model scores

class PlainKatz:
    """The same model with dictionaries, token by token."""

    END, START = ("end",), ("start",)

    def __init__(self, docs):
        train = [self.tokens(t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        self.words = Counter(w for t in train for w in t)
        self.pairs = Counter(p for t in train for p in zip([self.START, *t], t))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.context = Counter()
        self.after = defaultdict(list)
        for (v, w), c in self.pairs.items():
            self.context[v] += c
            self.after[v].append(w)
        self.d1, self.d2 = self.discounts(self.words), self.discounts(self.pairs)
        self.rest = 1 - sum(self.mass(c, self.d1) for c in self.words.values()) / self.n if self.n else 1.0

    def tokens(self, text):
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), self.END]

    def discounts(self, counts):
        n = Counter(counts.values())
        for k in (5, 4, 3, 2, 1):
            if all(n[r] for r in range(1, k + 2)):
                out = (k + 1) * n[k + 1] / n[1]
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - out) / (1 - out) if out != 1 else -1 for r in range(1, k + 1)}
                if out < 1 and all(0 < x < 1 for x in d.values()):
                    return d
        return {}

    def mass(self, c, d):
        return d[c] * c if c in d else c - 0.5

    def word(self, w):
        return self.mass(self.words[w], self.d1) / self.n if self.words[w] else self.rest

    def p(self, v, w):
        if not self.context[v]:
            return self.word(w)
        if self.pairs[v, w]:
            return self.mass(self.pairs[v, w], self.d2) / self.context[v]
        left = 1 - sum(self.mass(self.pairs[v, x], self.d2) for x in self.after[v]) / self.context[v]
        return left / (1 - sum(self.word(x) for x in self.after[v])) * self.word(w)

    def row(self, i, text):
        t = self.tokens(text)
        base = sum(math.log10((self.words[w] + 1) / (self.n + self.v + 1)) for w in t)
        return (i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(self.words[w] > 0 for w in t), self.n, base,
                sum(math.log10(self.p(v, w)) for v, w in zip([self.START, *t], t)))


def assert_scores(docs):
    rows = docs.collect()
    model = PlainKatz([(r.doc_id, r.text) for r in rows])
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: tuple(str(x) if k < 5 else round(x, 3) for k, x in enumerate(r))
    got = sorted((tuple(r[c] for c in columns) for r in ngram_scores.score(docs).collect()), key=key)
    want = sorted((model.row(r.doc_id, r.text) for r in rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    return model


@pytest.mark.parametrize("block, chars, part", [(ngram_scores.BLOCK_TOKENS, ngram_scores.CHARS_PER_PART, ngram_scores.TOKENS_PER_PART), (300, 20_000, 3000)])
def test_scores_against_plain_katz(spark, monkeypatch, block, chars, part):
    for name, value in (("BLOCK_TOKENS", block), ("CHARS_PER_PART", chars), ("TOKENS_PER_PART", part)):
        monkeypatch.setattr(ngram_scores, name, value)
    model = assert_scores(table(spark, SF, "documents").select("doc_id", "text"))
    assert len(model.d1) == 5
    for v in [*list(model.after)[::97], model.START, "never seen"]:
        assert abs(sum(model.p(v, w) for w in [*model.words, "never seen"]) - 1) < 1e-9


@pytest.mark.parametrize("part", [ngram_scores.TOKENS_PER_PART, 2000])
def test_scores_of_odd_texts_and_of_one_word(spark, monkeypatch, odd, nothing, part):
    monkeypatch.setattr(ngram_scores, "TOKENS_PER_PART", part)
    monkeypatch.setattr(ngram_scores, "BLOCK_TOKENS", 1000)
    assert_scores(odd)
    assert ngram_scores.score(nothing).count() == 0
    hot = spark.createDataFrame([(i, "same " * (i % 50) + f"own{i}") for i in range(300)], "doc_id long, text string")
    assert_scores(hot.repartition(4))
    only_held_out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = ngram_scores.score(spark.createDataFrame([(i, "a b") for i in only_held_out], "doc_id long, text string")).collect()
    assert len(rows) == len(only_held_out) and all((r.base_score, r.score, r.n_known, r.train_tokens) == (0, 0, 0, 0) for r in rows)


def test_discounts_fall_back_where_counts_of_counts_do_not_allow_them():
    assert len(ngram_scores.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6})) == 6
    assert len(ngram_scores.discounts({1: 100, 2: 40, 3: 20})) == 3
    assert len(ngram_scores.discounts({1: 3, 2: 40})) == len(ngram_scores.discounts({})) == 1
    assert ngram_scores.discounted(np.array([1, 7]), np.zeros(1)).tolist() == [0.5, 6.5]
