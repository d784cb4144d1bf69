"""Best-fit packing of tokenised documents by large-item matching.

Lengths are integers up to the capacity, so a packing is fully described by how many bins hold which lengths. The
driver plans with the histogram of lengths (at most ``capacity`` rows whatever the corpus size): pieces above a third of
the capacity are matched greedily, at most two in a bin; smaller pieces then best-fit the remaining gaps, largest first.
Equal bins form groups, so the plan stays small too. Pieces get their place from their rank among
pieces of equal length, which is a distributed prefix sum over salted ranges of each length.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm.scratch import cut, fresh, frugal, held

CAPACITY = 4096
WORDS_KEPT, CORES_KEPT = 500_000, 1_200_000
#: Bytes of text that are encoded at once: a word is looked up once in them.
RUN_BYTES = 1 << 22
#: A control character that is a token of its own.
MARK = "\x01"
SIGNS = ".,;:!?%$&#*"


class _Store:
    """Token ids of byte strings, all in one array; entry 0 is empty."""

    def __init__(self):
        self.at: dict[bytes, int] = {b"": 0}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ends, self.known = np.zeros(1 << 14, np.int64), 1

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.ends[self.known : self.known + len(words)] = self.used + np.cumsum(sizes)
        self.at.update(zip(words, range(self.known, self.known + len(words)), strict=True))
        self.used, self.known = self.used + len(ids), self.known + len(words)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in a row, and each entry's count."""
        ends = self.ends[entries]
        n = ends - np.where(entries > 0, self.ends[entries - 1], 0)
        to = np.cumsum(n)
        return self.pool[np.arange(to[-1] if len(to) else 0) + np.repeat(ends - to, n)], n


def _letters(word: bytes) -> bool:
    """Whether a word has letters of the Latin blocks only; lower-casing parts none of these from its marks."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class _Encoder:
    """Token ids by word: no token crosses ASCII white space, so a text's ids are its words' ids in a row.

    With ``split_marks``, for tokenizers that part letters from signs, signs that end a word are looked up apart, so
    fewer words are new. New ones are encoded together, in long runs with a mark between them whose one id tells them apart."""

    def __init__(self, path: str, split_marks: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_ids = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.split_marks = split_marks and self._parts(["a" + SIGNS, "a", SIGNS]) and self._parts(["é" + SIGNS, "é", SIGNS])
        #: Whether ASCII letters of either case have the same ids, also below marks that the normaliser joins to them.
        self.folds = all(self._same(t, t.lower()) for t in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "E\u0301 A\u030a O\u0308x", "It'S DON'T WE'LL", "X1Y2.Z"))
        self.parting: dict[str, bool] = {}
        self.words, self.earlier, self.cores = _Store(), _Store(), _Store()
        vocab = self.tokenizer.get_vocab()
        closing = [i for t, i in vocab.items() if t.endswith("</w>")]
        self.closes = None
        if closing and self.split_marks:
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[closing] = True

    def _same(self, a: str, b: str) -> bool:
        return self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids

    def _parts(self, texts: list[str]) -> bool:
        whole, *parts = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
        return whole == [i for p in parts for i in p]

    def _ends(self, last: str) -> bool:
        """Whether the tokenizer reads a character as letters only, so that signs after it are a part of their own.

        Its normaliser may take a letter apart into a letter and a mark, which would go with the signs."""
        return last.isalpha() and self._parts([last + SIGNS, last, SIGNS]) and self._parts(["a" + last + SIGNS, "a" + last, SIGNS])

    def _ids(self, new: list[bytes]) -> None:
        """Encodes new entries of ``cores``."""
        odd = [w for w in new if len(self.mark_ids) != 1 or MARK.encode() in w]
        if odd:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)]
            self.cores.add(odd, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))
            gone = set(odd)
            new = [w for w in new if w not in gone]
        if self.closes is not None:  # words of letters alone are one part each, which its last token closes
            plain = [w for w in new if w.isalpha() or _letters(w)]
            for i in range(0, len(plain), 4000):
                some = plain[i : i + 4000]
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.closes[ids])
                if len(last) != len(some):
                    raise ValueError("a word of letters has several parts in this tokenizer")
                self.cores.add(some, ids, np.diff(last, prepend=-1))
            new = [w for w in new if not (w.isalpha() or _letters(w))]
        between = f" {MARK} ".encode()
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([(between.join(some) + between).decode()], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_ids[0])
            if len(marks) != len(some):
                raise ValueError("the mark isn't a token of its own in this tokenizer")
            self.cores.add(some, np.delete(ids, marks), np.diff(marks, prepend=-1) - 1)

    def _learn(self, new: list[bytes]) -> None:
        parts, signs, ends = [], SIGNS.encode(), self.parting
        for w in new:
            if not self.split_marks or b"<|" in w:
                parts += (w, b"")
                continue
            if self.folds:
                w = w.lower()
            core = w.rstrip(signs)
            if core and len(core) < len(w):
                # a letter before the signs, or they belong to what precedes
                if core[-1] < 128:
                    alone = core[-1:].isalpha()
                else:
                    last = core[-4:].decode(errors="ignore")[-1]
                    alone = ends.get(last)
                    if alone is None:
                        alone = ends[last] = self._ends(last)
                if alone:
                    parts += (core, w[len(core) :])
                    continue
            parts += (w, b"")
        if self.cores.known > CORES_KEPT:
            self.cores = _Store()
        fresh = list(set(parts).difference(self.cores.at))
        if fresh:
            self._ids(fresh)
        ids, n = self.cores.gather(np.array([self.cores.at[p] for p in parts], np.int64))
        self.words.add(new, ids, n[0::2] + n[1::2])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's count, of texts in UTF-8."""
        if self.words.known > WORDS_KEPT:
            self.words, self.earlier = _Store(), self.words
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))  # may give empty words, which have no ids
        coded = split.flatten().dictionary_encode()
        flat = coded.dictionary.cast(pa.large_binary()).to_pylist()  # each word of these texts once
        entries = np.fromiter(map(self.words.at.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            unknown = new = [flat[i] for i in missing.tolist()]
            before = np.fromiter(map(self.earlier.at.get, new, repeat(-1)), np.int64, len(new))
            again = np.flatnonzero(before >= 0).tolist()
            if again:  # still known from before the last change of stores
                self.words.add([new[i] for i in again], *self.earlier.gather(before[again]))
                new = [new[i] for i in np.flatnonzero(before < 0).tolist()]
            self._learn(new)
            entries[missing] = [self.words.at[w] for w in unknown]
        entries = entries[np.asarray(coded.indices)]
        ends = np.asarray(split.offsets)
        ids, n = self.words.gather(entries)
        upto = np.concatenate([[0], np.cumsum(n)])[ends - ends[0]]
        return ids, np.diff(upto)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, keep=None) -> DataFrame:
    """Pieces of every row's whole text: doc_id, piece, start, length, ids.

    ``tokenizer``: path of a tokenizer file on every machine. A document is its ids and ``end_id``; only longer ones
    than ``capacity`` are cut. A null or empty text is the end id alone. Rows are independent of each other.
    ``keep``: a function of (ids, starts, lengths) that gives an Arrow array instead of the ids."""

    name = f"encoder {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one encoder a worker process, so that tasks share what is known; other operators' tasks drop it
        coder = held(name, lambda: _Encoder(tokenizer))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            weight, at = 0, 0
            for i, t in enumerate(texts):
                texts[i] = t = t or b""
                weight += len(t)
                if weight > RUN_BYTES or i + 1 == len(texts):
                    yield piece(batch.column(0).slice(at, i + 1 - at), *coder.encode(texts[at : i + 1]))
                    weight, at = 0, i + 1

    def piece(doc: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        ids = np.insert(ids, ends, end_id).astype(np.uint32)
        sizes = sizes + 1
        pieces = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), pieces)
        no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = no * capacity
        length = np.minimum(capacity, sizes[row] - start)
        edges = np.concatenate([[0], np.cumsum(length)])
        if keep is None:
            held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
        else:
            held = keep(ids, edges[:-1], length)
        return pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), held], names=["doc_id", "piece", "start", "length", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(frugal(run, name), f"doc_id {kind}, piece int, start long, length long, ids {'array<int>' if keep is None else 'long'}")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, last rank + 1, first bin, pieces a bin, offset); ranks and bins count from 0.

    Each placement puts consecutive ranks of one length into consecutive bins, so its size is bounded by the capacity
    alone: every step moves a whole group of equal bins, or splits one group for the last pieces of a length."""
    left = {s: n for s, n in histogram.items() if n}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> groups [first bin, bins]
    out, bins = [], 0

    def put(size: int, first: int, count: int, each: int, gap: int) -> None:
        out.append((size, rank[size], rank[size] + count * each, first, each, capacity - gap))
        rank[size] += count * each
        left[size] -= count * each
        if gap - each * size:
            gaps[gap - each * size].append([first, count])

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            partner = next((p for p in large if p <= capacity - size and left[p] > (p == size)), None) if size < capacity else None
            if partner is None:
                put(size, bins, n := left[size], 1, capacity)
                bins += n
            elif partner == size:
                put(size, bins, n := left[size] // 2, 2, capacity)
                bins += n
            else:
                n = min(left[size], left[partner])
                out.append((size, rank[size], rank[size] + n, bins, 1, 0))
                rank[size] += n
                left[size] -= n
                put(partner, bins, n, 1, capacity - size)
                bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            gap = min((g for g, x in gaps.items() if g >= size and x), default=capacity)
            each = min(gap // size, left[size])
            if gaps.get(gap):
                first, have = gaps[gap].pop()
            else:
                first, have = bins, max(1, left[size] // each)
                bins += have
            count = min(have, left[size] // each)
            if count < have:
                gaps[gap].append([first + count, have - count])
            put(size, first, count, each, gap)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = 20_000) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``capacity``) plus sequence_id and offset, gapless from 0.

    ``pieces`` should be a stored table, as it is read twice. Equal rows get places of their own; an empty table gives
    none; columns of the results' names are replaced, and others may have any name. Which of the equally long pieces goes where
    follows their hash, and has no bearing on the packing's quality."""
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    mark, part, start, place_ = fresh(pieces, "_key", "_salt", "_start", "_rank")
    key = F.xxhash64(*[F.col(f"`{c}`") for c in names if c in ("doc_id", "piece")] or [F.lit(0)])
    total = pieces.count()
    salts = max(64, total // range_rows)
    marked = pieces.withColumn(mark, key).withColumn(part, F.pmod(mark, F.lit(salts)).cast("int"))
    counts = marked.groupBy("length", part).agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("a piece is longer than the capacity, or empty")
    earlier = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))
    inner = F.row_number().over(Window.partitionBy("length", part).orderBy(mark)) - 1
    ranked = marked.withColumn(place_, inner).join(starts, ["length", part]).withColumn(place_, F.col(place_) + F.col(start))
    layout = defaultdict(list)
    for length, low, high, first, each, offset in sorted(plan(histogram, capacity)):
        layout[length].append((low, first, each, offset))

    @frugal
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {s: np.array(p, np.int64) for s, p in layout.items()}
        for batch in batches:
            size, rank = (np.asarray(batch.column(c), np.int64) for c in (batch.schema.get_field_index("length"), batch.num_columns - 1))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
                p = places[int(size[part[0]])]
                at = p[np.searchsorted(p[:, 0], rank[part], side="right") - 1]
                k = rank[part] - at[:, 0]
                seq[part], off[part] = at[:, 1] + k // at[:, 2], at[:, 3] + k % at[:, 2] * size[part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*[F.col(f"`{c}`") for c in names], place_).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs ``docs``: pieces with their ids and places."""
    return pack(cut(tokenise(docs, tokenizer, capacity)), capacity)
