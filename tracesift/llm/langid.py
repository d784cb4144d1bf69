"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads each word (white-space delimited, at most ``SPAN`` bytes at a time, folded to lower case)
from both ends and labels every byte's position; a document pools the probabilities of all its positions. State starts
anew at each word, so a word's labels depend on its bytes alone and are worked out once for each distinct word of a task.
Training is backpropagation through time with Adam on the mean position loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.scratch import frugal

SPAN = 24
HIDDEN = 24
DOCS_PER_LANGUAGE = 300
WORDS_PER_LANGUAGE = 40_000
STEPS = 500
BATCH = 512
WORDS_KEPT = 400_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction. ``table``: a byte's input to update gate, reset gate and candidate; ``rec``: the state's."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.rec = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.hidden = hidden

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: bytes [steps, rows]; live: 1 where a row has a byte. States [steps, rows, hidden]; a row's state stays once it ends."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        states, saved = np.zeros((*x.shape, n), np.float32), []
        for t in range(x.shape[0]):
            inp = self.table[x[t]]
            gates = _sigmoid(inp[:, : 2 * n] + h @ self.rec[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(inp[:, 2 * n :] + (r * h) @ self.rec[:, 2 * n :])
            new = h + live[t][:, None] * z * (c - h)
            if keep:
                saved.append((h, z, r, c))
            h = states[t] = new
        return states, saved

    def backward(self, x: np.ndarray, live: np.ndarray, saved: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        n = self.hidden
        d_table, d_rec = np.zeros_like(self.table), np.zeros_like(self.rec)
        dh = np.zeros_like(d_states[0])
        for t in reversed(range(x.shape[0])):
            h, z, r, c = saved[t]
            dh = dh + d_states[t]
            on = live[t][:, None]
            dc = dh * on * z * (1 - c * c)
            dz = dh * on * (c - h) * z * (1 - z)
            d_rh = dc @ self.rec[:, 2 * n :].T
            dr = d_rh * h * r * (1 - r)
            d_in = np.concatenate([dz, dr, dc], 1)
            d_rec[:, : 2 * n] += h.T @ d_in[:, : 2 * n]
            d_rec[:, 2 * n :] += (r * h).T @ dc
            np.add.at(d_table, x[t], d_in)
            dh = dh * (1 - on * z) + d_rh * r + d_in[:, : 2 * n] @ self.rec[:, : 2 * n].T
        return {"table": d_table, "rec": d_rec}


@dataclass
class Model:
    languages: list[str]
    ahead: Gru
    back: Gru
    out: np.ndarray  # [2 * hidden + 1, languages]

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        return cls(languages, Gru(hidden, rng), Gru(hidden, rng), rng.normal(0, 0.1, (2 * hidden + 1, len(languages))).astype(np.float32))

    def positions(self, x: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Log probabilities [steps, rows, languages] of padded words x [rows, steps] with ``size`` bytes."""
        steps = x.shape[1]
        live = (np.arange(steps)[:, None] < size).astype(np.float32)
        turn = np.where(live.T > 0, size[:, None] - 1 - np.arange(steps), np.arange(steps))
        mirrored = np.take_along_axis(x, turn, 1)
        a, kept_a = self.ahead.forward(x.T, live, keep)
        b, kept_b = self.back.forward(mirrored.T, live, keep)
        b_at = np.take_along_axis(b, turn.T[:, :, None], 0)
        both = np.concatenate([a, b_at, np.ones((*a.shape[:2], 1), np.float32)], 2)
        logits = both @ self.out
        logits -= logits.max(2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        return logp, (live, turn, mirrored, kept_a, kept_b, both)

    def train(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = {"at": self.ahead.table, "ar": self.ahead.rec, "bt": self.back.table, "br": self.back.rec, "o": self.out}
        first = {k: np.zeros_like(v) for k, v in params.items()}
        second = {k: np.zeros_like(v) for k, v in params.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            width = int(size[pick].max())
            grads = self.gradients(x[pick, :width], size[pick], y[pick])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, p in params.items():
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                p -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logp, (live, turn, mirrored, kept_a, kept_b, both) = self.positions(x, size, True)
        d = np.exp(logp)
        d[:, np.arange(len(y)), y] -= 1
        d *= (live / live.sum())[:, :, None]
        n = self.ahead.hidden
        d_both = d @ self.out.T
        d_b = np.zeros_like(d_both[:, :, n : 2 * n])
        np.put_along_axis(d_b, turn.T[:, :, None], d_both[:, :, n : 2 * n], 0)
        a = self.ahead.backward(x.T, live, kept_a, d_both[:, :, :n])
        b = self.back.backward(mirrored.T, live, kept_b, d_b)
        return {"at": a["table"], "ar": a["rec"], "bt": b["table"], "br": b["rec"], "o": np.tensordot(both, d, ([0, 1], [0, 1]))}


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    x = np.zeros((len(words), int(size.max(initial=1))), np.uint8)
    x[np.arange(x.shape[1]) < size[:, None]] = flat
    return x, size


class Labeller:
    """Sums of positions' probabilities by word, each distinct word worked out once."""

    def __init__(self, model: Model):
        self.model, self.at, self.sums = model, {}, np.zeros((0, len(model.languages) + 2), np.float64)

    def labels(self, text: str) -> np.ndarray:
        """Log probabilities at each byte that is not white space, in order."""
        parts = [w[i : i + SPAN] for w in text.lower().encode().split() for i in range(0, len(w), SPAN)]
        if not parts:
            return np.zeros((0, len(self.model.languages)))
        x, size = padded(parts)
        logp, rest = self.model.positions(x, size)
        return logp.transpose(1, 0, 2)[rest[0].T > 0]

    def _learn(self, new: list[bytes]) -> None:
        spans, owner = [], []
        for k, w in enumerate(new):
            for i in range(0, len(w), SPAN):
                spans.append(w[i : i + SPAN])
                owner.append(k)
        sums = np.zeros((len(new), self.sums.shape[1]))
        order = np.argsort([len(s) for s in spans], kind="stable")
        for i in range(0, len(order), 8192):
            part = order[i : i + 8192]
            x, size = padded([spans[j] for j in part])
            logp, rest = self.model.positions(x, size)
            np.add.at(sums, np.array(owner)[part], np.concatenate([np.einsum("trl,tr->rl", np.exp(logp), rest[0]), size[:, None], np.zeros((len(part), 1))], 1))
        sums[:, -1] = [any(c.isalpha() for c in w.decode()) for w in new]
        for w in new:
            self.at[w] = len(self.at)
        self.sums = np.concatenate([self.sums, sums])

    def pool(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities over all positions, and whether there is a letter, for each text."""
        if len(self.at) > WORDS_KEPT:
            self.at, self.sums = {}, self.sums[:0]
        split = [t.lower().encode().split() for t in texts]
        new = list({w for ws in split for w in ws}.difference(self.at))
        if new:
            self._learn(new)
        get = self.at.__getitem__
        n = np.array([len(ws) for ws in split])
        flat = np.array([k for ws in split for k in map(get, ws)], np.int64)
        total = np.concatenate([np.zeros((1, self.sums.shape[1])), np.cumsum(self.sums[flat], 0)]) if len(flat) else np.zeros((1, self.sums.shape[1]))
        ends = np.cumsum(n)
        sums = total[ends] - total[ends - n]
        return sums[:, :-2] / np.maximum(sums[:, -2:-1], 1), sums[:, -1] > 0.5


def learn(docs: DataFrame, train) -> Model | None:
    """Trains on documents for which ``train`` (a condition on doc_id) holds; None without any labelled text.

    The fit reads at most DOCS_PER_LANGUAGE whole documents of each language, by hash order of their ids, and draws at most
    WORDS_PER_LANGUAGE of their words (pieces of at most SPAN bytes) on the executors, by hash order too; these bounds and STEPS
    are its parameters. Only the drawn words come to the driver. Only doc_id, lang and text are read; repeated rows count as
    often as they come."""
    from pyspark.sql.window import Window

    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & train).select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("k", F.row_number().over(first)).where(f"k <= {DOCS_PER_LANGUAGE}").select("doc_id", "lang").distinct()

    @frugal
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = [w.encode() for w in text.lower().split() if any(c.isalpha() for c in w)]
                pieces = [w[i : i + SPAN] for w in words for i in range(0, len(w), SPAN)]
                # no language needs more of one document than the bound of them all; the draw must not favour long ones' beginnings
                keys = [zlib.crc32(b, zlib.crc32(b"%d:%d" % (doc, n))) for n, b in enumerate(pieces)]
                chosen = sorted(range(len(pieces)), key=keys.__getitem__)[:WORDS_PER_LANGUAGE]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chosen), pa.string()), pa.array([keys[i] for i in chosen], pa.int64()), pa.array([pieces[i] for i in chosen], pa.binary())], names=["lang", "key", "word"])

    # languages x DOCS_PER_LANGUAGE rows at most
    chosen = docs.select("doc_id", "lang", "text").where("text IS NOT NULL").join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    drawn = chosen.mapInArrow(draw, "lang string, key long, word binary")
    order = Window.partitionBy("lang").orderBy("key", "word")
    rows = drawn.withColumn("k", F.row_number().over(order)).where(f"k <= {WORDS_PER_LANGUAGE}").select("lang", "word").collect()
    rows = sorted((r["lang"], bytes(r["word"])) for r in rows)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng, words, y = np.random.default_rng(3), [w for _, w in rows], [languages.index(lang) for lang, _ in rows]
    model = Model.new(languages)
    if words:
        y = np.array(y)
        each = np.bincount(y, minlength=len(languages))
        even = np.concatenate([rng.choice(np.flatnonzero(y == k), max(each)) if each[k] else np.zeros(0, np.int64) for k in range(len(languages))]).astype(np.int64)
        x, size = padded(words)
        model.train(x[even], size[even], y[even])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text; ``und`` with score 0 for null texts and those without a letter.

    The score is the predicted language's share of the positions' probabilities. Equal rows get equal results, and an empty table
    gives none. Only doc_id and text are read."""
    kind = dict(docs.dtypes)["doc_id"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts, at, weight = [t or "" for t in batch.column(1).to_pylist()], 0, 0
            for i, t in enumerate(texts):
                weight += len(t)
                if weight > 1 << 21 or i + 1 == len(texts):
                    own = texts[at : i + 1]
                    if labeller:
                        p, known = labeller.pool(own)
                        best = p.argmax(1)
                        lang = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                        score = np.where(known, np.minimum(p[np.arange(len(own)), best], 1.0), 0.0)
                    else:
                        lang, score = ["und"] * len(own), np.zeros(len(own))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
                    at, weight = i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
