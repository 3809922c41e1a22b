"""Language identification by unigram pieces with every segmentation counted in.

The pieces are those of a fixed public vocabulary (lower-case letters, with or without the word mark). Each
language has a probability for every piece, fitted by expectation-maximisation: the forward and backward sums
over all segmentations of a word give each piece's expected count. A text's likelihood in a language is the
product over its words of the forward sum, so no segmentation is preferred or cut off; the languages have equal
priors, and the score is the winner's share.

Words are runs of at most 31 letters, lower-cased; longer runs are cut there. Prediction reads the text alone and
uses whole texts; each worker keeps the sums of chunks it has seen in a bounded cache. Texts that are null or
have no letter give ``und`` with score 0, as does every text when there was nothing to learn from. Rows are
judged one by one, so repeated rows agree; ties go to the first language by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import kept_by_worker, mapped, written

UNDETERMINED = "und"
#: The model is fitted on about this many labelled documents of each language, drawn by a hash of doc_id.
TRAINING_DOCUMENTS = 2_000
ROUNDS = 3
#: So many values of the label can be languages, the most frequent ones.
MOST_LANGUAGES = 512
#: Every piece and the unknown letter have at least this share, whatever the size of the corpus, so that the sums of
#: words of ``LONGEST_WORD`` unknown letters and their inverses stay within a double.
LEAST_SHARE = 1e-8
#: Chunks kept by a worker; beyond it the cache starts anew.
CACHE_CHUNKS = 400_000
LONGEST_WORD = 31

_MARK = "▁"
_WORD = regex.compile(rf"\p{{L}}{{1,{LONGEST_WORD}}}")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 20_000


def _codes(strings: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), length).astype(np.uint64)


@dataclass
class Lattice:
    """Pieces of the vocabulary by hash, and their probability in each language (last rows: unknown letter)."""

    hashes: np.ndarray
    longest: int
    probabilities: np.ndarray

    @classmethod
    def of(cls, path: str, n_languages: int) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        named = {model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        kept = [p for p in named if p == p.lower() and (p == _MARK or p.removeprefix(_MARK).isalpha())]
        by_length: dict[int, list[str]] = {}
        for p in kept:
            by_length.setdefault(len(p), []).append(p)
        hashes = []
        for length, pieces in by_length.items():
            codes, h = _codes(pieces, length), np.zeros(len(pieces), np.uint64)
            for k in range(length):
                h = h * _BASE + codes[:, k] + np.uint64(1)
            hashes.append(h)
        ordered = np.unique(np.concatenate(hashes))
        return cls(ordered, max(by_length), np.full((len(ordered) + 1, n_languages), 1.0 / (len(ordered) + 1)))

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of every place in the words where a piece fits; unknown single letters too."""
        n = codes.shape[1]
        unknown = len(self.hashes)
        for start in range(n):
            h = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * _BASE + codes[:, end - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), unknown - 1)
                hit = self.hashes[at] == h
                if end == start + 1:
                    yield start, end, np.arange(len(codes)), np.where(hit, at, unknown)
                elif hit.any():
                    rows = np.flatnonzero(hit)
                    yield start, end, rows, at[rows]

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            members = np.flatnonzero(lengths == length)
            for i in range(0, len(members), _BLOCK):
                block = members[i : i + _BLOCK]
                yield block, _codes([_MARK + words[j] for j in block], length + 1)

    def _forward(self, codes: np.ndarray, edges) -> np.ndarray:
        sums = np.zeros((codes.shape[1] + 1, len(codes), self.probabilities.shape[1]))
        sums[0] = 1.0
        for start, end, rows, pieces in edges:
            sums[end, rows] += sums[start, rows] * self.probabilities[pieces]
        return sums

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Of each word in each language."""
        out = np.zeros((len(words), self.probabilities.shape[1]))
        for block, codes in self._by_length(words):
            out[block] = np.log(self._forward(codes, self._edges(codes))[-1])
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Per piece and language, over all segmentations; ``weights`` counts each word in each language."""
        counts = np.zeros_like(self.probabilities)
        for block, codes in self._by_length(words):
            edges = list(self._edges(codes))
            ahead = self._forward(codes, edges)
            behind = np.zeros_like(ahead)
            behind[-1] = weights[block] / ahead[-1]
            for start, end, rows, pieces in reversed(edges):
                through = behind[end, rows] * self.probabilities[pieces]
                behind[start, rows] += through
                np.add.at(counts, pieces, ahead[start, rows] * through)
        return counts


@dataclass
class Model:
    languages: list[str]
    lattice: Lattice


def fit(
    labelled: DataFrame, path: str, per_language: int = TRAINING_DOCUMENTS, rounds: int = ROUNDS
) -> Model:
    """A model of the languages in ``labelled`` (doc_id, text, lang); null texts and labels teach nothing.

    About ``per_language`` documents of each language are read for it, all of them where there are fewer; of the values
    of ``lang`` the ``MOST_LANGUAGES`` most frequent are languages.
    """
    usable = labelled.filter("text is not null and lang is not null")
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], Lattice.of(path, 0))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    drawn = usable.filter(F.col("lang").isin(languages)).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{LONGEST_WORD}}})"), 1))
    of_language = [F.sum(F.when(F.col("lang") == x, 1.0).otherwise(0.0)) for x in languages]
    counted = drawn.select("lang", word.alias("word")).groupBy("word").agg(F.array(*of_language).alias("counts"))
    words = written(counted, "words")

    lattice = Lattice.of(path, len(languages))
    for _ in range(rounds):
        summed = _expected(words, lattice).toPandas()  # at most vocabulary times languages
        counts = np.zeros_like(lattice.probabilities)
        counts[summed["piece"], summed["language"]] = summed["n"]
        smooth = counts + np.maximum(1e-2, LEAST_SHARE * counts.sum(0))
        lattice = Lattice(lattice.hashes, lattice.longest, smooth / smooth.sum(0))
    return Model(languages, lattice)


def _expected(words: DataFrame, lattice: Lattice) -> DataFrame:
    """(piece, language, n) summed over all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros_like(lattice.probabilities)
        for batch in batches:
            if batch.num_rows:
                weights = np.array(batch.column(1).to_pylist(), float)
                counts += lattice.expected_counts(batch.column(0).to_pylist(), weights)
        pieces, languages = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pieces, pa.int32()), pa.array(languages, pa.int32()), pa.array(counts[pieces, languages])], ["piece", "language", "n"]
        )

    return mapped(words, run, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))


class Judge:
    """Scores texts; keeps the log-likelihoods of the chunks between white space that it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._rows: dict[str, int] = {}
        self._sums = np.zeros((1, len(model.languages) + 1))

    def _learn(self, chunks: list[str]) -> None:
        if len(self._rows) + len(chunks) > CACHE_CHUNKS:
            self._rows.clear()
        found = [_WORD.findall(c.lower()) for c in chunks]
        words = sorted({w for ws in found for w in ws})
        places = {w: i for i, w in enumerate(words)}
        each = self.model.lattice.log_likelihoods(words)
        new = np.zeros((len(chunks), self._sums.shape[1]))
        of_chunk = np.repeat(np.arange(len(chunks)), [len(ws) for ws in found])
        of_word = np.fromiter((places[w] for ws in found for w in ws), np.int64, len(of_chunk))
        np.add.at(new[:, :-1], of_chunk, each[of_word])
        new[:, -1] = np.bincount(of_chunk, minlength=len(chunks))
        first = len(self._rows)
        if len(self._sums) < first + len(chunks):
            grown = np.zeros((2 * (first + len(chunks)), self._sums.shape[1]))
            grown[:first] = self._sums[:first]
            self._sums = grown
        self._sums[first : first + len(chunks)] = new
        self._rows.update((c, first + i) for i, c in enumerate(chunks))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [(t or "").split() for t in texts]
        new = set().union(*split)
        if not new <= self._rows.keys():
            missing = sorted(new - self._rows.keys())
            if len(self._rows) + len(missing) > CACHE_CHUNKS:
                missing = sorted(new)
            self._learn(missing)
        out = []
        for chunks in split:
            rows = np.fromiter(map(self._rows.__getitem__, chunks), np.int64, len(chunks))
            total = self._sums[rows].sum(0)
            if not total[-1] or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(np.argmax(total[:-1]))
            out.append((self.model.languages[best], float(1.0 / np.exp(total[:-1] - total[best]).sum())))
        return out


def _judge_of(key: str, model: Model) -> Judge:
    """The worker's judge of one model."""
    return kept_by_worker(key, lambda: Judge(model))


def predict(docs: DataFrame, model: Model, carried: str = "doc_id long") -> DataFrame:
    """(carried column, lang_pred, score) of each row; ``carried`` names the id column and its type."""
    name = carried.split(" ")[0]
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge_of(key, model)
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 256):
                found += judge.judge(batch.column(1).slice(i, 256).to_pylist())
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [name, "lang_pred", "score"]
            )

    return mapped(docs.select(name, "text"), run, f"{carried}, lang_pred string, score double", keeps=key)


def held_out(doc_id):
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 4, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, path: str, per_language: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document, by a model fitted on those not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), path, per_language)
    judged = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, least_score: float = 0.5, per_language: int = TRAINING_DOCUMENTS) -> DataFrame:
    """``docs`` whose language is found with at least ``least_score``, and ``lang`` set to it; other columns as they are."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), path, per_language)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge_of(key, model)
        for batch in batches:
            texts = batch.column("text")
            found = []
            for i in range(0, batch.num_rows, 256):
                found += judge.judge(texts.slice(i, 256).to_pylist())
            langs = pa.array([x[0] for x in found], pa.string())
            stays = pa.array([x[0] != UNDETERMINED and x[1] >= least_score for x in found], pa.bool_())
            columns = [langs if n == "lang" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(stays)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, schema, keeps=key)
