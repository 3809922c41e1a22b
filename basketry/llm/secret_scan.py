"""Secret scans: candidates by pattern, false positives removed by a random forest, all in column expressions.

A candidate is the value assigned to a key name, of at least six characters and up to its closing quote or white space,
or else a run of at least 16 letters, digits and ``+/_-`` with its padding. Its features are length, transitions between
character classes, shares of digits and distinct characters, dictionary coverage (share of its three-letter
pieces that are common in a public word list), the path (here ``source``) and the neighbouring words: a key name
before it, an assignment, quotes on both sides.

The forest is trained (Spark ML) on labelled findings, each also without its neighbours so that it learns the
characters too. Its few, shallow trees become one CASE expression, so scoring is row-local: no shuffle, no Python.

Null and empty texts have no candidates; a null path is an empty one. Repeated rows give repeated findings. A row
with very many candidates costs a little more than linear time. With labelled findings of one kind only, no forest
can be trained and the labelling rule itself decides.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrays import let, prefix_sums
from basketry.llm.tables import written

#: Words that name a secret (token, secret, password, passwd, passphrase, pwd, private key, API key, access
#: key, auth, bearer, credential), by their first letters so that most places fail at the second one.
_NAMES = (
    r"token|secret|p(?:ass(?:w(?:or)?d|phrase)|wd|rivate[_-]?key)|a(?:pi[_-]?key|ccess[_-]?key|uth)|bearer|credentials?"
)
_ASSIGN = r"[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}"
_BARE = r"[^\s\"'<>,;]"
_RUN = "[A-Za-z0-9+/_-]"
#: Group 1 is what stands before the value: the key name, the assignment and an opening quote; empty for a mere run. A run
#: that ends in a key name with an assignment behind it is no candidate.
CANDIDATE = (
    rf"((?=[tspabcTSPABC])(?i:{_NAMES}){_ASSIGN}(?:\"(?=[^\"\n]{{6,}}\")|'(?=[^'\n]{{6,}}')|(?={_BARE}{{6}})))"
    rf"(?:(?<=\")[^\"\n]{{6,}}+|(?<=')[^'\n]{{6,}}+|{_BARE}{{6,}}+)"
    rf"|(?<!{_RUN})(?={_RUN}{{16}})(?!{_RUN}*?(?i:{_NAMES}){_ASSIGN}){_RUN}{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/=_-]))?"
)
MASK = "<SECRET>"
TREES, DEPTH, SEED = 20, 5, 7
#: The forest is trained on about this many labelled findings of each kind, drawn by a hash; where only masking is
#: asked for, findings of about so many documents are labelled.
TRAINING_FINDINGS, TRAINING_DOCUMENTS = 5_000, 40_000
LEAST_PROBABILITY = 0.5
#: A three-letter piece is common when so many words of the public list have it.
COMMON_IN_WORDS = 12

_BEFORE, _AFTER = 48, 24
_KEY_NAME = rf"(?i)(?:{_NAMES})[\"'\s:=>]*$"
_ASSIGNED = r"(?:=|:|=>)\s*[\"']?$"
_TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|mocks?|fixtures?|vendor|docs?)(?:[/_.-]|$)"
_CHANGES = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"

CHARACTER_FEATURES = ("length", "transitions", "digits", "distinct", "coverage", "upper")
PLACE_FEATURES = ("test_path", "key_name", "assigned", "quoted")
FEATURES = CHARACTER_FEATURES + PLACE_FEATURES


def common_pieces(vocabulary_path: str, least: int = COMMON_IN_WORDS) -> list[str]:
    """Three-letter pieces a-z that so many whole words of a public vocabulary have."""
    with open(vocabulary_path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    words = {t.removesuffix("</w>") for t in tokens if re.fullmatch(r"[a-z]{3,}</w>", t)}
    counts = Counter(p for w in words for p in {w[i : i + 3] for i in range(len(w) - 2)})
    return sorted(p for p, n in counts.items() if n >= least)


def _features(text: Column, before: Column, after: Column, path: Column, pieces: list[str]) -> list[Column]:
    n = F.length(text)
    lower = F.lower(text)
    known = F.size(F.filter(F.sequence(F.lit(1), n - 2), lambda i: F.substring(lower, i, F.lit(3)).isin(pieces)))
    double = {
        "length": n,
        "transitions": F.regexp_count(text, F.lit(_CHANGES)) / (n - 1),
        "digits": F.regexp_count(text, F.lit("[0-9]")) / n,
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / n,
        "coverage": known / (n - 2),
        "upper": F.regexp_count(text, F.lit("[A-Z]")) / n,
        "test_path": path.rlike(_TEST_PATH).cast("int"),
        "key_name": before.rlike(_KEY_NAME).cast("int"),
        "assigned": before.rlike(_ASSIGNED).cast("int"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
    }
    return [F.coalesce(double[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]


def findings(text: Column, path: Column, pieces: list[str]) -> Column:
    """Of one text all candidates in order: start, gap (the text before it since the last one), text and features."""
    whole, path = F.coalesce(text, F.lit("")), F.coalesce(path, F.lit(""))

    def described(gaps: Column, found: Column, ends: Column) -> Column:
        def one(candidate: Column, i: Column) -> Column:
            before, after = F.right(F.get(gaps, i), F.lit(_BEFORE)), F.left(F.get(gaps, i + 1), F.lit(_AFTER))
            start = F.get(ends, i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), F.get(gaps, i).alias("gap"), candidate.alias("text"), *_features(candidate, before, after, path, pieces))

        return F.transform(found, one)

    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda c, i: (F.length(c) + F.length(F.get(gaps, i))).cast("bigint"))
        return let(prefix_sums(lengths), lambda ends: described(gaps, found, ends))

    def apart(matches: Column, heads: Column) -> Column:
        """What stands before a value belongs to the gap, not to the candidate."""
        values = F.zip_with(matches, heads, lambda m, h: F.substring(m, F.length(h) + 1, F.length(m)))
        gaps = F.transform(F.split(whole, CANDIDATE), lambda gap, i: F.concat(gap, F.coalesce(F.get(heads, i), F.lit(""))))
        return let(values, lambda found: let(gaps, lambda g: placed(g, found)))

    return let(F.regexp_extract_all(whole, F.lit(CANDIDATE), 0), lambda matches: F.when(F.size(matches) > 0, let(
        F.regexp_extract_all(whole, F.lit(CANDIDATE), 1), lambda heads: apart(matches, heads)
    )))


def candidates(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """One row per candidate: doc_id, start, text and features."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(findings(F.col("text"), F.col("source"), pieces)).alias("f"))
    return found.select("doc_id", "f.start", "f.text", *[f"f.{x}" for x in FEATURES])


def known_findings(found: DataFrame) -> DataFrame:
    """Labelled findings of a corpus without hand labels: a candidate assigned in quotes to a key name, with letters
    and digits mixed, is a secret; a plain word or number that no key name, assignment or quote stands beside is
    none. Others stay unlabelled."""
    secret = (F.col("key_name") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.col("transitions") > 0)
    alone = (F.col("key_name") == 0) & (F.col("assigned") == 0) & (F.col("quoted") == 0)
    none = alone & F.col("text").rlike("^(?:[A-Za-z_-]+|[0-9_-]+)$")
    return found.withColumn("label", F.when(secret, 1.0).when(none, 0.0)).filter("label is not null")


@dataclass
class Forest:
    """Nested (feature, threshold, low, high) trees; leaves are 0.0 or 1.0."""

    trees: list

    def probability(self, feature) -> Column:
        """Share of the trees that vote for a secret; ``feature(name)`` gives a column."""

        def vote(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, threshold, low, high = tree
            return F.when(feature(name) <= threshold, vote(low)).otherwise(vote(high))

        total = vote(self.trees[0])
        for tree in self.trees[1:]:
            total = total + vote(tree)
        return total / len(self.trees)


#: Without labelled findings of both kinds: assigned in quotes to a key name.
RULE_ALONE = Forest([("key_name", 0.5, 0.0, ("quoted", 0.5, 0.0, ("assigned", 0.5, 0.0, 1.0)))])


def _parsed(text: str) -> list:
    """Trees of a forest's printed form."""
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split()[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", line).groups()
        low = node()
        at += 1  # the Else line
        return FEATURES[int(feature)], float(threshold), low, node()

    trees = []
    while at < len(lines):
        at += 1
        if lines[at - 1].startswith("Tree "):
            trees.append(node())
    return trees


def train(labelled: DataFrame, per_kind: int = TRAINING_FINDINGS) -> Forest:
    """A forest from findings with features and ``label`` (1.0 secret, 0.0 not), about ``per_kind`` of each kind."""
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        return RULE_ALONE
    share = F.when(F.col("label") == 1.0, per_kind / sizes[1.0]).otherwise(per_kind / sizes[0.0])
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", "start", "text"), F.lit(1 << 30)) < share * (1 << 30))
    alone = drawn.withColumns({f: F.lit(0.0) for f in PLACE_FEATURES})
    rows = written(drawn.unionByName(alone).select(*FEATURES, "label"), "training")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)
    return Forest(_parsed(forest.toDebugString))


def scan(docs: DataFrame, pieces: list[str], least: float = LEAST_PROBABILITY) -> DataFrame:
    """(doc_id, start, length, digest, probability, is_secret) of every candidate; the secret itself is not shown."""
    found = written(candidates(docs, pieces), "candidates")
    forest = train(known_findings(found))
    judged = found.withColumn("probability", forest.probability(F.col))
    return judged.select(
        "doc_id", "start", F.length("text").cast("long").alias("length"), F.sha2("text", 256).alias("text_sha256"), "probability",
        (F.col("probability") >= least).alias("is_secret"),
    )


def redact(docs: DataFrame, pieces: list[str], least: float = LEAST_PROBABILITY) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask and ``n_chars`` counted anew; other columns as they are."""
    share = min(1.0, TRAINING_DOCUMENTS / max(1, docs.count()))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    forest = train(known_findings(written(candidates(sample, pieces), "candidates")))
    text = F.coalesce(F.col("text"), F.lit(""))

    def rebuilt(found: Column) -> Column:
        parts = F.transform(found, lambda f: F.concat(f["gap"], F.when(forest.probability(lambda n: f[n]) >= least, MASK).otherwise(f["text"])))
        last = F.get(found, F.size(found) - 1)
        rest = F.substring(text, last["start"].cast("int") + F.length(last["text"]) + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    shown = F.coalesce(let(findings(F.col("text"), F.col("source"), pieces), lambda f: F.when(F.size(f) > 0, rebuilt(f))), F.col("text"))
    masked = docs.select(F.struct("*").alias("d"), shown.alias("shown"))
    changed = {"text": F.col("shown"), "n_chars": F.coalesce(F.length("shown").cast("long"), F.col("d.n_chars"))}
    return masked.select(*[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
