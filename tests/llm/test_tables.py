"""URL filter, secret scan, sharding, near duplicates, language, packing and the pipeline."""
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import language_id, near_dedup, packing, queries, secret_scan, sharding, tables, url_filter
from basketry.llm.arrays import covered_by_repeats, prefix_sums
from basketry.llm.tables import table
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    verdict = compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_on_whole_table(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    documents = table(spark, SF, "documents").count()
    assert len(rows) >= documents if name != "op2_secret_scan" else len(rows) > 0


def test_array_helpers(spark):
    rows = spark.createDataFrame([([],), ([1],), ([3, 1, 4],), (list(range(700)),)], "v array<bigint>").select("v", prefix_sums(F.col("v")).alias("s")).collect()
    assert all(r.s == [sum(r.v[:i]) for i in range(len(r.v))] for r in rows)
    words = ["a b c a b c d".split(), "a a a a".split(), [], ["x"]]
    got = spark.createDataFrame([(w,) for w in words], "w array<string>").select(covered_by_repeats(F.col("w"), 2).alias("n")).collect()
    assert [r.n for r in got] == [6, 4, 0, 0]


# URL filter

URLS = [
    "https://Example.ORG/es/x", "http://a.example.org/en/1", "http://example.org/en/2", "http://notexample.org.net/", "https://shop.com/fr/", "https://shop.com/de/x?y#z",
    "https://shop.com?x=/de/", "https://www.bad.net/a.html?utm_source=1", "https://bad.net/a/#top", "https://bad.net/b", "no scheme", "", None, "https://org", "://org/",
]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, listed string")


@pytest.mark.parametrize("broadcast", [url_filter.BROADCAST_URLS, 0])
def test_url_rules_and_list(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_URLS", broadcast)
    listed = spark.createDataFrame([("bad.net/a",), ("bad.net/a",), (None,)], "url string")
    rows = {r.page_id: r for r in url_filter.judge(pages_of(spark, URLS * 2), listed).collect()}
    assert len(rows) == 2 * len(URLS)
    assert [rows[i].rule for i in range(15)] == [
        "example.org/es/", "example.org/en/1", "org/", None, "com/fr/", "com/de/", None, None, None, None, None, None, None, None, "org/"]
    assert [i for i in range(15) if rows[i].verdict == "block"] == [0, 1, 5, 7, 8]
    assert (rows[0].host, rows[0].path, rows[6].path, rows[12].host) == ("example.org", "/es/x", "", "")
    nothing = url_filter.judge(pages_of(spark, URLS), listed.limit(0)).collect()
    assert len(nothing) == 15 and not any(r.listed for r in nothing)
    assert url_filter.judge(pages_of(spark, URLS).limit(0), listed).count() == 0


def test_content_reports_other_variants_of_a_page(spark):
    junk, clean = "<p>*** $$$ ### %%%</p><script>fine words here</script>", "<p>fine words ### here and there, many of them</p>"
    rows = [(1, "https://www.a.net/x.html", junk), (2, "https://a.net/x?utm_source=1", clean), (3, "https://a.net/y", clean), (4, "https://b.net/", None), (5, None, junk),
            (6, "https://spam-farm.c.net/z", clean)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.reported(pages)).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("host/"), "id").alias("url"))
    n = url_filter.blocks_for(2000)
    words = url_filter.bloom_words(listed, n).scalar()
    asked = spark.range(12000).select("id", F.concat(F.lit("host/"), "id").alias("url"))
    hit = {r.id for r in asked.filter(url_filter.may_be_listed("url", words, n)).collect()}
    assert set(range(2000)) <= hit and len(hit) < 2000 + 100


# Secret scan

def test_secret_candidates_and_starts(spark, odd, nothing):
    pieces = secret_scan.common_pieces(WORD_BPE)
    assert secret_scan.candidates(nothing, pieces).count() == 0
    docs = table(spark, SF, "documents").select("doc_id", "text", "source").union(odd.filter("doc_id != 6").select("doc_id", "text", "source").withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = dict(docs.select("doc_id", "text").collect())
    want = sorted((i, m.start() + len(m.group(1) or ""), m.group()[len(m.group(1) or "") :]) for i, t in texts.items() for m in re.finditer(secret_scan.CANDIDATE, t or ""))
    assert sorted((r.doc_id, r.start, r.text) for r in secret_scan.candidates(docs, pieces).collect()) == want


def test_secrets_are_masked_and_words_are_not(spark, odd, nothing):
    pieces = secret_scan.common_pieces(WORD_BPE)
    more = 'Donaudampfschifffahrtsgesellschaft 4785380592391139 and bare 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b plus token = "d3add85726a6b499e1baeb21b4eae21ecce4ec31" end'
    base = table(spark, "/root/testdata/sf0.01", "documents")
    docs = base.union(spark.createDataFrame([(10**6, more, "de", "src0", len(more))], base.schema))
    row = secret_scan.redact(docs, pieces).filter("doc_id = 1000000").head()
    assert row.text == 'Donaudampfschifffahrtsgesellschaft 4785380592391139 and bare <SECRET> plus token = "<SECRET>" end' and row.n_chars == len(row.text)
    assert secret_scan.redact(nothing, pieces).count() == 0
    plain = {str(r.doc_id): r.text for r in secret_scan.redact(odd, pieces).collect()}
    assert plain["3"] is None and plain["9"].count("<SECRET>") == 1 and secret_scan.redact(odd, pieces).columns == odd.columns


@pytest.mark.parametrize("text, shown", [
    ('password = "hunter2abc!" here', 'password = "<SECRET>" here'),
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI7K8MDENG8bPxRfiCYEXAMPLEKEY", "AWS_SECRET_ACCESS_KEY=<SECRET>"),
    ("DB_PASSWORD=Zx9!kq7@Lm2#Pw8$ next", "DB_PASSWORD=<SECRET> next"),
    ("api_key: 'sk-1a2b3c4d5e'", "api_key: '<SECRET>'"),
    ("the password is changed often by the owners", "the password is changed often by the owners"),
    ("plain words: nothing to hide, unterscheidungsmerkmale included", "plain words: nothing to hide, unterscheidungsmerkmale included"),
])
def test_assigned_values_are_masked_without_their_names(spark, text, shown):
    base = table(spark, "/root/testdata/sf0.01", "documents")
    docs = base.union(spark.createDataFrame([(10**6, text, "en", "src0", len(text))], base.schema))
    assert secret_scan.redact(docs, secret_scan.common_pieces(WORD_BPE)).filter("doc_id = 1000000").head().text == shown


def test_forest_expression_is_the_models_own_vote(spark):
    found = secret_scan.candidates(table(spark, "/root/testdata/sf0.01", "documents"), secret_scan.common_pieces(WORD_BPE))
    vectors = VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(secret_scan.known_findings(found))
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=3, impurity="gini").fit(vectors)
    forest = secret_scan.Forest(secret_scan._parsed(model.toDebugString))
    votes = [float(np.mean([t.predict(r.features) for t in model.trees])) for r in vectors.select("features").collect()]
    own = [r.p for r in vectors.select(forest.probability(F.col).alias("p")).collect()]
    assert np.allclose(own, votes) and 0 < sum(own) < len(own)


def test_forest_without_labels_is_the_rule(spark, nothing):
    found = secret_scan.candidates(nothing, ["the"])
    assert secret_scan.train(secret_scan.known_findings(found)) is secret_scan.RULE_ALONE


# Sharding

@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_are_even_and_gapless(spark, shards):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.shard_by_bytes(docs, shards).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    assert len(rows) == len(texts) and sorted(sizes) == list(range(shards)) and max(sizes.values()) < 1.06 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in rows:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def _plain_tree(rows, shards):
    """The same law with sorted lists: {row number: shard}."""
    def key(r, d):
        return r["keys"][d] << 32 | r["crc"]

    widths = [max(r["keys"][d] for r in rows) - min(r["keys"][d] for r in rows) for d in range(3)]
    out, first = {}, [0]

    def place(part, n):
        if n == 1 or not part:
            out.update({r["at"]: first[0] for r in part})
            first[0] += 1
            return
        d = max(range(3), key=lambda d: (max(r["keys"][d] for r in part) - min(r["keys"][d] for r in part)) / max(1, widths[d]))
        want = sum(r["size"] for r in part) * (n // 2) / n
        sums = Counter()
        for r in part:
            sums[key(r, d)] += r["size"]
        before = 0
        for k in sorted(sums):
            if before + sums[k] >= want:
                break
            before += sums[k]
        take = want - before > before + sums[k] - want
        off = min(want - before, before + sums[k] - want)
        assert 100 * off <= sharding.TOLERANCE_PERCENT * want
        place([r for r in part if key(r, d) < k + take], n // 2)
        place([r for r in part if key(r, d) >= k + take], n - n // 2)

    place(rows, shards)
    return out


@pytest.mark.parametrize("shards", [2, 7, 8])
def test_shards_are_those_of_a_plain_tree(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "TOLERANCE_PERCENT", 5)  # no group is cut
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("length(text) < 4000")
    rows = []
    for i, (doc_id, text) in enumerate(docs.select("doc_id", "text").collect()):
        data = text.encode()
        rows.append({"at": doc_id, "size": len(data) + 1, "crc": zlib.crc32(data), "keys": (len(data) + 1, 10**6 * len(data) // max(1, len(text)), 1000 * len(data) // (1 + text.count(" ")))})
    assert {r.doc_id: r.shard for r in sharding.shard_by_bytes(docs, shards).collect()} == _plain_tree(rows, shards)


def test_copies_with_other_labels_stay_together(spark):
    langs = ["en", "de", None, "fr", "xx"]
    docs = spark.createDataFrame([(5 * i + k, f"text {i} " * (3 + i % 11), langs[(i + k) % 5]) for i in range(80) for k in range(5)], "doc_id long, text string, lang string")
    homes = {}
    for r in sharding.shard_by_bytes(docs, 4).collect():
        homes.setdefault(r.doc_id // 5, set()).add(r.shard)
    assert len(homes) == 80 and all(len(h) == 1 for h in homes.values())


def test_one_group_of_copies_is_split_by_need(spark, odd, nothing):
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    sizes = Counter(r.shard for r in sharding.shard_by_bytes(copies, 8).collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2
    assert sharding.shard_by_bytes(nothing, 8).count() == 0
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count() and {r.size for r in rows if r.doc_id == 3} == {1} and {r.text_crc32 for r in rows if r.doc_id == 3} == {0}
    assert sharding.shards_for(copies, 1000) == 6


# Near duplicates

def _exact_groups(texts):
    sets, holders = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def chained(spark):
    """A chain of texts each near the next one only, copies, and texts that share one long passage."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(0, 12)]
    rows += [(100 + i, " ".join(words[:40] + [f"own{i}x{k}" for k in range(60)])) for i in range(30)]
    rows += [(200 + i, "Same Text here for all of them, word by word") for i in range(50)]
    rows += [(300, "same text HERE for all of them, word by word"), (301, "short text"), (302, "short text"), (303, "short texts"), (304, ""), (305, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("ids", [near_dedup.BROADCAST_IDS, 0])
def test_near_duplicates_against_exact_groups(spark, monkeypatch, ids):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", ids)
    docs = chained(spark) if ids == 0 else table(spark, SF, "documents").select("doc_id", "text")
    want = _exact_groups(dict(docs.collect()))
    rows = near_dedup.groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def crowded(spark):
    """Unlinked texts with one long passage; two of them are alike since it is most of their text, but neither is a hub."""
    passage = " ".join(f"p3x{k}" for k in range(304))
    own = {i: 120 + i % 80 for i in range(200)} | {171: 40, 193: 40}
    rows = [(3000 + i, passage + "".join(f" o3x{i}x{k}" for k in range(n))) for i, n in own.items()]
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_copies(spark, n=400, changes=14):
    """Copies of one text with a few words changed in each, more in later ones, so that links are near the threshold."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(220)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(len(base), rng.integers(2, 3 + changes * i // n), replace=False):
            words[at] = f"c{rng.integers(0, 6)}x{at}"
        rows.append((7000 + i, " ".join(words[: len(words) - int(rng.integers(0, 40))])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def with_passage(spark):
    """One passage in half of all texts, a smaller or larger part of each."""
    rng = np.random.default_rng(12)
    passage = " ".join(f"p{k}" for k in range(90))
    rows = [(8000 + i, (passage if i % 2 else "") + "".join(f" q{i if rng.random() < 0.7 else i // 3}y{k}" for k in range(int(rng.integers(5, 60))))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("rounds", [near_dedup.HUB_ROUNDS, 0])
@pytest.mark.parametrize("make", [crowded, near_copies, with_passage])
def test_links_in_crowded_buckets_are_found(spark, monkeypatch, make, rounds):
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", rounds)
    docs = make(spark)
    want = _exact_groups(dict(docs.collect()))
    assert make is not crowded or want[3193][1] == 3171
    assert len({c for _, c in want.values()}) > 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs).collect()} == want


@pytest.mark.parametrize("percent", [75, 50, 90])
def test_meetings_hold_every_link(spark, percent):
    """Prefixes and sizes alone, against all pairs of sets with one label each."""
    for docs in (near_copies(spark, 150), with_passage(spark)):
        sets = near_dedup.shingle_sets(docs).filter("size(shingles) > 0")
        sets = sets.select("doc_id", F.col("doc_id").alias("label"), F.size("shingles").cast("long").alias("n"), "shingles", F.col("doc_id").alias("entry")).cache()
        found = {(r.a, r.b) for r in near_dedup._meetings(near_dedup._prefixes(sets, percent), percent).collect()}
        own = {r.doc_id: set(r.shingles) for r in sets.collect()}
        links = {(a, b) for a in own for b in own if a < b and 100 * (k := len(own[a] & own[b])) >= percent * (len(own[a]) + len(own[b]) - k)}
        assert links <= found and (links or percent > 75)


def test_components_and_their_merging(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(1, 2), (3, 4)], "a long, b long")
    labels = near_dedup.components(links)
    assert dict(labels.collect()) == {**{i: 20 for i in range(20, 41)}, 1: 1, 2: 1, 3: 3, 4: 3}
    more = spark.createDataFrame([(2, 4), (5, 6), (3, 6), (7, 8), (30, 50)], "a long, b long")
    assert dict(near_dedup._merged(labels, more).collect()) == {
        **{i: 20 for i in [*range(20, 41), 50]}, **{i: 1 for i in range(1, 7)}, 7: 7, 8: 7}


def test_near_duplicates_of_odd_rows(odd, nothing):
    assert near_dedup.groups(nothing).count() == 0 and near_dedup.keep_one_of_each_group(nothing).count() == 0
    rows = near_dedup.groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[None].kept and by_id[3].kept and by_id[6].component_id == 6
    assert near_dedup.keep_one_of_each_group(odd).columns == odd.columns


# Language

def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    rows = language_id.identify(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_ignores_labels_of_what_it_judges(spark, odd, nothing):
    model = language_id.fit(table(spark, SF, "documents").select("doc_id", "text", "lang"), PIECES)
    rows = {r.doc_id: r for r in language_id.predict(odd.select("doc_id", "text"), model).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[7].lang_pred == rows[8].lang_pred == "und" and rows[8].score == 0.0
    assert rows[6].lang_pred == "de" and len(rows) == 10
    assert language_id.identify(nothing, PIECES).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}
    kept = language_id.keep_identified(odd, PIECES)
    assert kept.columns == odd.columns and {2, 3, 7, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_forward_sum_counts_every_segmentation():
    lattice = language_id.Lattice.of(PIECES, 1)
    n = len(lattice.hashes)
    lattice.probabilities[:] = np.linspace(1e-5, 1e-3, n + 1)[:, None]

    def piece(text):
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * language_id._BASE + np.uint64(ord(c) + 1)
        at = min(int(np.searchsorted(lattice.hashes, h[0])), n - 1)
        return lattice.probabilities[at, 0] if lattice.hashes[at] == h[0] else lattice.probabilities[n, 0] if len(text) == 1 else 0.0

    def total(text):
        return 1.0 if not text else sum(piece(text[:i]) * total(text[i:]) for i in range(1, len(text) + 1))

    words = ["the", "straße", "x", "日本"]
    assert np.allclose(lattice.log_likelihoods(words)[:, 0], [np.log(total("▁" + w)) for w in words])
    weights = np.ones((len(words), 1))
    letters = lattice.expected_counts(words, weights)
    assert letters.sum() > len(words)


def test_words_of_unknown_letters_have_finite_sums(spark, monkeypatch):
    """Also with counts as from a very large corpus."""
    strange = "ꙮ" * 200
    docs = spark.createDataFrame([(i, f"the word and {strange} the" if i == 3 else "the word and the text", "en" if i % 2 else "de") for i in range(8)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, PIECES)
    unknown = model.lattice.probabilities[-1]
    model.lattice.probabilities[-1] = 1e-8
    assert (unknown >= 0.9e-8).all()
    words = ["ꙮ" * language_id.LONGEST_WORD, "the"]
    logs = model.lattice.log_likelihoods(words)
    counts = model.lattice.expected_counts(words, np.full((2, 2), 1e12))
    assert np.isfinite(logs).all() and np.isfinite(counts).all() and counts[-1].min() > 1e13
    rows = language_id.predict(docs.select("doc_id", "text"), model).collect()
    assert all(0 <= r.score <= 1 for r in rows)


def test_values_of_the_label_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some words of a text", f"x{i}" if i > 20 else "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert language_id.fit(docs, PIECES).languages == ["a", "b"]


# Packing

def check_packing(rows, texts):
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        total = sum(r.length for r in pieces)
        assert 0 < total <= 2048 and total & (total - 1) == 0


def test_packing_keeps_every_id_once(spark, odd, nothing):
    docs = table(spark, SF, "documents")
    check_packing(packing.pack(docs, WORD_BPE).collect(), dict(docs.select("doc_id", "text").collect()))
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(unique, WORD_BPE).collect(), dict(unique.select("doc_id", "text").collect()))
    assert packing.pack(nothing, WORD_BPE).count() == 0
    assert packing.pack(odd, WORD_BPE).filter("doc_id = 6").count() >= 2


def test_word_ids_of_random_texts_are_the_librarys():
    """Letters of several alphabets, combining marks, stops and special tokens in any case."""
    coder, library = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    rng = np.random.default_rng(9)
    letters = [*map(chr, range(0x20, 0x180)), *map(chr, range(0x300, 0x315)), *"İıſßﬁΣςЖжǅ日本😀", *" .,.,'-\n\x85\xa0\u3000"]
    words = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "TEKİ.", "don't", "I'LL", "e\u0301.", "the", "WORD,", "a.b."]
    texts = []
    for _ in range(20_000):
        parts = ["".join(rng.choice(letters, rng.integers(1, 7))) if rng.random() < 0.6 else words[rng.integers(len(words))] for _ in range(rng.integers(1, 7))]
        texts.append(("" if rng.random() < 0.3 else " ").join(parts))
    assert all(coder.of(x).tolist() == e.ids for x, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))


def test_word_ids_are_the_librarys():
    coder, library = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    texts = ["Hello  WORLD\tÉcole école", "a\x1cb \x1f c", "ΣΑΣ Σ <|endoftext|> x<|startoftext|>y", "don't 12 日本 😀", "", " \n"]
    assert [coder.of(x).tolist() for x in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(5)
    rests = [(i, rng.integers(0, 50, 40).astype(np.uint32), 0) for i in range(30)]
    idf = rng.random(60) + 0.1
    shard = packing.Shard(rests, idf, 40.0)
    got = shard.scores(rests[3][1])
    for i, (_, ids, _) in enumerate(rests):
        counts = Counter(ids.tolist())
        want = sum(idf[t] * n * 2.2 / (n + 1.2) for t in set(rests[3][1].tolist()) if (n := counts.get(t)))
        assert abs(got[i] - want) < 1e-4
    assert int(np.argmax(got)) == 3


# Pipeline

def test_stages_against_plain_models(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "secrets", "packing"]
    texts = {}
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before, texts = texts, dict(docs.select("doc_id", "text").collect())
        if name == "near_duplicates":
            assert set(texts) == {i for i, (_, component) in _exact_groups(before).items() if i == component}
        if name == "secrets":
            assert set(texts) == set(before) and not any(re.search(r"token = \"[0-9a-f]{40}\"", t) for t in texts.values())
    check_packing(stages["packing"](spark, docs, SF).collect(), texts)


def test_stages_take_odd_and_empty_tables(spark, odd, nothing):
    everyone = sorted(map(str, (r.doc_id for r in odd.collect())))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
        out = stage(spark, odd, SF)
        assert name == "packing" or out.columns == odd.columns
        ids = sorted(str(r.doc_id) for r in out.collect())
        if name == "secrets":
            assert ids == everyone
        elif name == "packing":
            assert set(ids) == set(everyone)
        else:
            assert set(ids) < set(everyone) and len(ids) < len(everyone)
            assert {"language": {"2", "3", "7", "8"}, "quality": {"2", "3", "7", "6"}, "near_duplicates": {"5"}}[name].isdisjoint(ids)


def test_run_gives_the_packed_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def _sizes_of_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    key, before = tables.BATCH_BYTES[0], spark.conf.get(tables.BATCH_BYTES[0], None)
    texts = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("text"))
    try:
        spark.conf.unset(key)
        sizes = tables.mapped(texts, _sizes_of_batches, "n long, size long").collect()
        assert sum(r["n"] for r in sizes) == 60
        assert max(r["size"] for r in sizes) < 6_000_000
        spark.conf.set(key, "1m")  # a session that says so itself keeps its value
        sizes = tables.mapped(texts, _sizes_of_batches, "n long, size long").collect()
        assert sum(r["n"] for r in sizes) == 60
        assert max(r["size"] for r in sizes) < 2_000_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_worker_drops_what_another_operator_kept(spark):
    def keeping(batches):
        for batch in batches:
            tables.kept_by_worker("one", list).append(batch.num_rows)
            yield batch

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(tables._kept)])], ["kept"])

    def kept_after(keeps):
        tables.mapped(spark.range(0, 64, 1, 16), keeping, "id long", keeps="one").collect()
        return {r["kept"] for r in tables.mapped(spark.range(0, 64, 1, 16), kept, "kept string", keeps=keeps).collect()}

    assert kept_after(None) == {""}
    assert kept_after("two") == {""}
    assert "one" in kept_after("one")
