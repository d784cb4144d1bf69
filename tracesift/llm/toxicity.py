"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps look-alike letters of other scripts and accented letters to plain ones, drops zero-width
characters, reads digits and signs inside words as the letters they stand for, and turns all else into single spaces.
A lexicon entry is a word or a word's beginning (a stem); both are anchored at a word's start.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.neardup import shingle_sets
from tracesift.llm.scratch import cut, frugal
from tracesift.llm.textscan import mix

#: Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Used where no labelled row is toxic.
PRIOR = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "worthless": 3.0, "pathetic": 3.0, "scum": 4.0, "disgusting": 3.0, "loser": 3.0, "imbecile": 4.0}
#: Phrases in which an entry doesn't count.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash bag", "white trash bag", "stupid question", "not stupid", "not an idiot", "not worthless", "sore loser law")

SAMPLE_ROWS = 12_000
#: Texts are compared as near copies where each of so many orders of their 5-word shingles has the same least one.
MINIMA, COPY = 2, 0.8
STEMS = range(4, 9)
LEXICON_SIZE = 4096
#: A term is taken where fewer than exp(-GUARD) terms of its support are to be expected by chance.
GUARD = 1.0
#: Clean texts without a hit that the fit of the score is given beside the labelled ones.
BLANKS = 30
_MIXED = re.compile(r"[@$!|]{2,}|(?<![^\W\d_])[@$!|]+(?![^\W\d_])|[!|]+(?=\s|$)")
_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")
_SIGNS = re.compile(r"[@$!|]")


class _Fold(dict):
    """str.translate table that fills itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            to = HOMOGLYPHS[c]
        elif unicodedata.category(c) in ("Cf", "Mn"):
            to = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
            to = plain if plain.isalpha() else SUBSTITUTES.get(plain, " ") if len(plain) == 1 else " "
        self[code] = to
        return to


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text: words of letters with one space before, between and after them; an empty text is one space."""
    text = text.lower()
    if _SIGNS.search(text):
        text = _MIXED.sub(" ", text)
    return f" {' '.join(_NUMBER.sub(' ', text).translate(_FOLD).split())} "


@dataclass
class Model:
    """``terms``: weight of each entry; an entry ending in a space is a whole word, else a stem. Score: logistic in the log density."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase)), None))
        found.make_automaton()
        return found

    def weigh(self, folded: str, found: ahocorasick.Automaton) -> tuple[float, list[tuple[int, int, float]]]:
        """Density of weight in a folded text, and the hits (start, end, weight) in it that no exception covers."""
        hits, free = [], []
        for end, (n, weight) in found.iter(folded) if len(found) else ():
            (free if weight is None else hits).append((end - n + 1, end + 1, weight))
        if free:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in free)]
        best: dict[int, tuple[int, int, float]] = {}  # a word counts once, by its heaviest entry
        for h in hits:
            if h[0] not in best or best[h[0]][2] < h[2]:
                best[h[0]] = h
        return math.log1p(1000 * sum(h[2] for h in best.values()) / (folded.count(" ") + 20)), sorted(best.values())

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * density))))


def _terms(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        if len(word) > 2:
            out.add(word + " ")
        out.update(word[:n] for n in STEMS if n <= len(word))
    return out


def minima(shingles: np.ndarray) -> bytes:
    """The least hash of a shingle set in each of MINIMA orders."""
    return b"".join((shingles if k == 0 else mix(shingles + np.uint64(k))).min().tobytes() for k in range(MINIMA)) if len(shingles) else b""


def learn(docs: DataFrame, labels: DataFrame, train, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the lexicon and the score on labelled rows for which ``train`` (a condition on doc_id) holds.

    At most ``sample_rows`` labelled rows, by hash order of their ids, are read (the one bound of the fit). Texts
    of one shingle set count once, as toxic if any is; so do most near copies of one label: those whose MINIMA least
    hashes are equal and whose sets have a Jaccard similarity of at least COPY.
    Terms are counted on the executors; of the whole counts those with toxic support come to the driver."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    @frugal
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(0), 5):
                least = pa.array([minima(s) for s in sets], pa.binary())
                whole = pa.array([np.array([len(s), s.sum(), mix(s).sum()], np.uint64).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(sets)).columns, least, whole], names=["text", "toxic", "h", "whole"])

    texts = texts.mapInArrow(sketch, "text string, toxic int, h binary, whole binary")
    texts = texts.groupBy("whole").agg(F.max(F.struct("toxic", "text", "h")).alias("r")).select("r.*")

    @frugal
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for batch in batches:
            keys, stay = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)), []
            for first, sets in shingle_sets(batch.column(0), 5):
                for now, s in zip(keys[first : first + len(sets)], sets, strict=True):
                    if now != key:
                        key, kept = now, []
                    both = [len(np.intersect1d(s, k, assume_unique=True)) for k in kept]
                    stay.append(all(b < COPY * (len(s) + len(k) - b) for b, k in zip(both, kept, strict=True)))
                    if stay[-1]:
                        kept.append(s)
            yield batch.filter(pa.array(stay, pa.bool_())).select(["text", "toxic"])

    order = texts.select("text", "toxic", "h").repartition("toxic", "h").sortWithinPartitions("toxic", "h", F.desc("text"))
    texts = cut(order.mapInArrow(alone, "text string, toxic int"))

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y == 1 else clean).update(_terms(fold(text)))
                n[y == 1] += 1
        rows = [("", n[1], n[0]), *((t, toxic[t], clean[t]) for t in toxic.keys() | clean.keys())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["term", "toxic", "clean"])

    counts = texts.coalesce(8).mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts)
    total = counts.where("term = ''").first()
    n_toxic, n_clean = (total["toxic"] or 0, total["clean"] or 0) if total else (0, 0)
    if not n_toxic:
        return Model({k + " ": v for k, v in PRIOR.items()})
    # log-likelihood ratio against the base rate. Its exponential bounds the chance of such a find among clean terms of the same
    # support; times the number of terms that have as much support, or more, that is how many such finds to expect
    per = {r["n"]: r["k"] for r in counts.where("term <> ''").groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("k")).collect()}  # sample_rows rows at most
    many, upto = {}, 0
    for n in sorted(per, reverse=True):
        upto += per[n]
        many[n] = math.log(upto)
    tests = counts.sparkSession.createDataFrame(list(many.items()), "n long, tests double")
    base, seen = n_toxic / max(1, n_toxic + n_clean), F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / seen / F.lit(base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / F.lit(max(1 - base, 1e-9)))).otherwise(0.0)
    ratio = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    rows = counts.where("term <> '' AND toxic > 0").withColumn("n", seen).join(F.broadcast(tests), "n")
    rows = rows.withColumn("w", F.log(ratio)).where((F.col("w") > 1.5) & (gain >= F.col("tests") + GUARD)).orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "term").limit(LEXICON_SIZE).collect()
    terms: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        shorter = [terms[r["term"][:n]] for n in STEMS if n < len(r["term"]) and r["term"][:n] in terms]
        if not shorter or r["w"] > max(shorter) + 1:
            terms[r["term"]] = float(r["w"])
    model = Model(terms or {k + " ": v for k, v in PRIOR.items()})

    @frugal
    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            x = [model.weigh(fold(t), found)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    fit = np.array([(r["x"], r["y"]) for r in texts.mapInArrow(density, "x double, y int").collect()], float).reshape(-1, 2)
    # a few labelled texts must not make texts without any hit toxic
    fit = np.concatenate([fit, np.zeros((BLANKS, 2))])
    model.bias, model.slope = _logistic(fit[:, 0], (fit[:, 1] == 1).astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-3, ridge])
        step = np.linalg.solve(hess, design.T @ (y - p) - np.array([1e-3, ridge]) * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id and ``score`` (0 to 1) of every row's whole text; with ``spans`` also the hits in the folded text.

    A null or empty text has no hit and gets the score of density 0. Equal rows get equal scores, and an empty table gives none. Only
    doc_id and text are read."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            out = [model.weigh(fold(t or ""), found) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([model.score(x) for x, _ in out], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": a, "end": b, "weight": w} for a, b, w in hits] for _, hits in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "spans"][: len(columns)])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double" + ", spans array<struct<start: bigint, end: bigint, weight: double>>" * spans)


def flagged(docs: DataFrame, model: Model, limit: float, keep: bool) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``limit`` (``keep``) or below it. No row is matched by its id."""
    at = docs.columns.index("text")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            toxic = [model.score(model.weigh(fold(t or ""), found)[0]) >= limit for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([t == keep for t in toxic], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
