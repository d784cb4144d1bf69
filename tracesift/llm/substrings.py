"""Removal of word passages that repeat across documents, by prefix-partitioned suffix trees.

1. A pass over the texts finds each window's anchor: the place of its least half-window word run (a minimiser). Equal
   windows have equal anchors, so the trees need the suffixes at anchors only, and a window whose anchor's run
   occurs in one document only can't repeat and is done with. This pruning is by hashes; all that follows is by words.
2. Suffixes are split into groups by their first words: by half a window's words, or, where more than GROUP_SUFFIXES suffixes
   share these, by three quarters of a window's, one prefix for each half of the places that a window can have about its anchor.
   Groups by the longer prefix are dealt over salted parts, as many as the root of what could be in them.
3. A task sorts a group's suffixes by their words and reads the tree from the common prefixes of neighbours: its internal
   nodes at depth d hold the suffixes that share d words. A window that starts b words before its anchor
   repeats where a node of depth window - b has another suffix with the same b words to its left. Neighbouring starts
   whose window occurs in a smaller document make up one maximal repeat.
4. Of a group in parts, each part hands on its least document of each window, and these meet by the whole window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.blocks import spread_join
from tracesift.llm.scratch import cut, frugal
from tracesift.llm.textscan import runs, slices, words

WINDOW = 50
#: Suffixes that a group may hold; larger ones are split by longer prefixes.
GROUP_SUFFIXES = 500
#: Suffixes of whole groups that are sorted at a time.
CHUNK = 10_000
TASK_SUFFIXES = 200_000


def anchors(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within a row: its start and its anchor's place; and the hashes of all half-window runs."""
    size = window // 2
    grams = runs(hashes, size)
    width = window - size + 1
    starts = len(grams) - width + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    best, have = np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best, have = np.where(grams[b] < grams[a], b, a), have + step
    row = np.searchsorted(at, np.arange(starts), side="right") - 1
    inside = np.flatnonzero(np.arange(starts) + window <= at[np.minimum(row + 1, len(at) - 1)])
    return inside, best[inside], grams


def _spells(starts: np.ndarray, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each spell of consecutive windows of one row with one anchor."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(at, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (row[1:] != row[:-1])]))
    return new, np.concatenate([new[1:], [len(starts)]]) - 1


def _names(sha: str) -> int:
    """Tells apart texts of one doc_id."""
    return int.from_bytes(bytes.fromhex(sha)[:8], "little", signed=True)


def profile(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, SHA-256 of the words joined by spaces, that as a number, and the hash of each anchor's run."""
    kind = dict(docs.dtypes)["doc_id"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, body, offsets in slices(batch.column(1)):
                _, _, hashes, at = words(body, offsets, fold=False)
                starts, places, grams = anchors(hashes, at, window)
                new, _ = _spells(starts, places, at)
                counts = np.bincount(np.searchsorted(at, starts[new], side="right") - 1, minlength=last - first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(grams[places[new]].view(np.int64)))
                raw = body.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(at)), pa.array(shas), pa.array([_names(s) for s in shas], pa.int64()), lists],
                    names=["doc_id", "n_words", "sha", "name", "grams"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, sha string, name long, grams array<long>")


_SUFFIX = "gram long, part int, id long, name long, start int, before int, windows int, words binary"


def suffixes(texts: DataFrame, window: int) -> DataFrame:
    """From rows (id, name, text, grams: array of struct<gram, size>): the anchored suffixes of shared runs.

    gram (hash of the group's prefix), part (-1: the group is whole), id, name, start (word index of the first window), before
    (words from there to the anchor), windows (how many start there in a row), words (of all of them, joined by spaces)."""
    size = window // 2
    middle = (window - size + 1) // 2

    def places(before: int, n: int) -> Iterator[tuple[bytes, int, int, int, int]]:
        """The longer prefixes of windows at both halves of the places: salt, first window, windows, and the prefix's words.

        Windows that start up to ``middle - 1`` words before the anchor have the words from there to ``window - middle + 1`` words
        later in common; the others those from ``middle`` words before the anchor to the end of the half-window run."""
        far = max(0, min(n, before - middle + 1))
        if far:
            yield b"far", 0, far, before - middle, before + size
        if far < n:
            yield b"near", far, n - far, before, before + window - middle + 1

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            ids, names = (np.asarray(batch.column(i), np.int64) for i in range(2))
            shared = batch.column(3)
            for first, last, body, offsets in slices(batch.column(2)):
                begin, end, hashes, at = words(body, offsets, fold=False)
                starts, anchor, grams = anchors(hashes, at, window)
                new, until = _spells(starts, anchor, at)
                rows = np.searchsorted(at, starts[new], side="right") - 1
                raw = body.tobytes()
                for i in range(first, last):
                    lo, hi = np.searchsorted(rows, [i - first, i - first + 1])
                    if lo == hi:
                        continue
                    a, b = offsets[i - first], offsets[i - first + 1]
                    if _names(hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest()) != names[i]:
                        continue
                    own = shared[i].values
                    wanted, sizes = np.asarray(own.field(0), np.int64), np.asarray(own.field(1), np.int64)
                    order = np.argsort(wanted)
                    wanted, sizes = wanted[order], sizes[order]
                    gram = grams[anchor[new[lo:hi]]].view(np.int64)
                    k = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
                    who = (int(ids[i]), int(names[i]))
                    for j in np.flatnonzero(wanted[k] == gram).tolist():
                        s, n = int(starts[new[lo + j]]), int(starts[until[lo + j]]) - int(starts[new[lo + j]]) + 1
                        text = raw[begin[s] : end[s + n + window - 2]].split()
                        before, many, at_ = int(anchor[new[lo + j]]) - s, int(sizes[k[j]]), s - int(at[i - first])
                        if many <= GROUP_SUFFIXES:
                            out.append((int(gram[j]), -1, *who, at_, before, n, b" ".join(text)))
                            continue
                        part = _hash(b"%d %d" % who, b"part") % math.isqrt(many)
                        for salt, skip, own_n, x, y in places(before, n):
                            out.append((_hash(b" ".join(text[x:y]), salt), part, *who, at_ + skip, before - skip, own_n, b" ".join(text[skip : skip + own_n + window - 1])))
                    if len(out) >= CHUNK:
                        yield _rows(out, _SUFFIX)
                        out = []
        if out:
            yield _rows(out, _SUFFIX)

    return texts.select("id", "name", "text", "grams").mapInArrow(run, _SUFFIX)


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _hash(text: bytes, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=salt).digest(), "little", signed=True)


_FOUND = "id long, name long, start int, stop int, node binary, starts binary"


def tree_repeats(rows: DataFrame, window: int) -> DataFrame:
    """From suffixes sorted by group and part: id, name, start, stop of window starts that repeat in a smaller document; and for
    groups in parts each window's least document there, with the window's ``node`` (128 bits of SHA-256) and ``starts``."""
    columns = ["gram", "part", "id", "name", "start", "before", "windows", "words"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:  # the last group may go on in the next batch
                table = pa.Table.from_batches(held).combine_chunks()
                gram, part = (np.asarray(table.column(i)) for i in range(2))
                new = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1])) + 1
                if len(new):
                    yield from solve(table.slice(0, int(new[-1])))
                    held = table.slice(int(new[-1])).combine_chunks().to_batches()
                    n = table.num_rows - int(new[-1])
        if n:
            yield from solve(pa.Table.from_batches(held))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, part, ids, names, start, before, windows = (np.asarray(table.column(i), np.int64) for i in range(7))
        split = [w.split() for w in table.column(7).to_pylist()]
        flat = list(chain.from_iterable(split))
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        flat = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
        size = np.array([len(w) for w in split])
        at = np.cumsum(size) - size
        # words from the anchor on, and leftwards from it; -1 - row beyond the text, which equals nothing
        ahead = _aligned(flat, at + before, size - before, window)
        left = _aligned(flat, at + before - 1, before, window - window // 2, -1)
        order = np.lexsort((*[ahead[:, k] for k in range(window - 1, -1, -1)], part, gram))
        gram, part, ids, names, start, before, windows, ahead, left = (x[order] for x in (gram, part, ids, names, start, before, windows, ahead, left))
        same = ahead[1:] == ahead[:-1]
        common = np.where(same.all(1), window, same.argmin(1))  # words that neighbours in the order share
        common[(gram[1:] != gram[:-1]) | (part[1:] != part[:-1])] = -1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        context = np.zeros(len(gram), np.int64)  # number of the words to the left, of the length in hand
        for b in range(window - window // 2 + 1):
            if b:
                _, context = np.unique(context * (len(number) + len(gram) + 1) + left[:, b - 1] + len(gram) + 1, return_inverse=True)
            use = np.flatnonzero((before >= b) & (before - b < windows))
            if not len(use):
                continue
            node = np.cumsum(np.concatenate([[0], common < window - b]))  # internal nodes of depth window - b
            _, place = np.unique(node[use] * len(gram) + context[use], return_inverse=True)
            least = np.full(place.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, place, ids[use])
            hit = use[ids[use] > least[place]]
            found.append((hit, start[hit] + before[hit] - b))
            first = np.flatnonzero((ids[use] == least[place]) & (part[use] >= 0))
            if len(first):
                yield from handed_on(use[first], place[first], names, ids, start[use[first]] + before[use[first]] - b, [split[order[r]][before[r] - b : before[r] - b + window] for r in use[first].tolist()])
        row = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        if not len(row):
            return
        pos = np.concatenate([f[1] for f in found])
        order = np.lexsort((pos, names[row], ids[row]))
        row, pos = row[order], pos[order]
        new = np.flatnonzero(np.concatenate([[True], (ids[row][1:] != ids[row][:-1]) | (names[row][1:] != names[row][:-1]) | (pos[1:] > pos[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(row)]]) - 1
        yield _found_rows(ids[row][new], names[row][new], pos[new], pos[last] + 1)

    def handed_on(rows: np.ndarray, place: np.ndarray, names: np.ndarray, ids: np.ndarray, pos: np.ndarray, text: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        """A row for each window and text of its least document, with all its starts there."""
        order = np.lexsort((pos, names[rows], place))
        rows, place, pos = rows[order], place[order], pos[order]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (names[rows][1:] != names[rows][:-1])]))
        node = [hashlib.sha256(b" ".join(text[order[i]])).digest()[:16] for i in new.tolist()]
        starts = [x.astype(np.int32).tobytes() for x in np.split(pos, new[1:])]
        yield _found_rows(ids[rows][new], names[rows][new], pos[new], pos[new] + 1, node, starts)

    return rows.select(*columns).mapInArrow(run, _FOUND)


def _found_rows(ids, names, start, stop, node=None, starts=None) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(ids), pa.array(names), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), *[pa.nulls(n, pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (node, starts)]]
    return pa.RecordBatch.from_arrays(columns, names=["id", "name", "start", "stop", "node", "starts"])


def met(rows: DataFrame) -> DataFrame:
    """From what parts hand on, dealt and sorted by node and id: the starts in documents other than the node's least."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, least = None, 0
        for batch in batches:
            ids, names, nodes, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), []
            for i, x in enumerate(nodes):
                if x != node:
                    node, least = x, ids[i]
                elif ids[i] > least:
                    out += [(ids[i], names[i], s) for s in np.frombuffer(batch.column(5)[i].as_py(), np.int32).tolist()]
            if out:
                ids, names, start = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield _found_rows(ids, names, start, start + 1)

    return rows.mapInArrow(run, _FOUND)


def _aligned(flat: np.ndarray, first: np.ndarray, n: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """[rows, width] words from ``first`` on by ``step``, of which row i has n[i]; beyond them a number of the row's own."""
    k = np.arange(width)
    at = np.clip(first[:, None] + step * k, 0, max(0, len(flat) - 1))
    return np.where(k < n[:, None], flat[at].astype(np.int64), -1 - np.arange(len(first))[:, None])


def _found(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Profiles, the least document of each word sequence, the texts that matter, and repeats (id, name, start, stop)."""
    spark = docs.sparkSession
    seen = cut(profile(docs, window))
    known = seen.where(f"n_words >= {window} AND doc_id IS NOT NULL")
    # copies of whole documents go at once: the least one has all their windows
    least = cut(known.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    n_seen = seen.count()
    first = spread_join(known, least, ["sha"], "n", n_seen).where("doc_id = least").groupBy(F.col("doc_id").cast("long").alias("id"), "name").agg(F.first("grams").alias("grams"))
    grams = cut(first.select("id", "name", F.explode("grams").alias("gram")).groupBy("id", "name", "gram").agg(F.count("*").alias("k")))
    shared = grams.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("k").alias("size"), F.count("*").alias("n")).where("lo < hi").select("gram", "size", "n")
    wanted = spread_join(grams, shared, ["gram"], "n", grams.count()).groupBy("id", "name").agg(F.collect_list(F.struct("gram", "size")).alias("grams"))
    texts = cut(docs.select("doc_id", "text").join(wanted, F.expr("doc_id = id")).select("id", "name", "text", "grams"))
    rows = cut(suffixes(texts, window))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_SUFFIXES)
    found = cut(tree_repeats(rows.repartition(tasks, "gram", "part").sortWithinPartitions("gram", "part"), window))
    across = met(found.where("node IS NOT NULL").repartition(tasks, "node").sortWithinPartitions("node", "id"))
    found = found.where("node IS NULL").union(across).select("id", "name", "start", "stop")
    return seen, least, texts, found


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal repeats: doc_id, start, stop (word indexes) of words to remove, for documents that aren't whole copies.

    Stretches found by different tasks may touch or overlap; ``removed`` merges them."""
    found = _found(docs, window)[3]
    return found.select(F.col("id").alias("doc_id"), "start", (F.col("stop") + window - 1).alias("stop"))


def removed(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of ``docs`` (integer doc_id, text).

    A word goes if a run of ``window`` words that covers it also starts in a document with a smaller doc_id. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words; rows with a null doc_id and
    texts shorter than the window keep all; equal rows fare equally; rows of one doc_id are never each other's
    repeats; an empty table gives no rows. Other columns are not read."""
    seen, least, known, found = _found(docs, window)
    by_doc = found.groupBy("id", "name").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = known.select("id", "name", "text").join(by_doc, ["id", "name"]).select("id", "name", "text", "spans")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, out = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64), []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                own = text.split()
                sha = hashlib.sha256(b" ".join(own)).hexdigest()
                if _names(sha) != names[i]:  # another text of that doc_id
                    continue
                edge, s = np.zeros(len(own) + 1, np.int64), batch.column(3)[i].values
                np.add.at(edge, np.asarray(s.field(0)), 1)
                np.add.at(edge, np.asarray(s.field(1)) + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
                out.append((int(ids[i]), sha, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=["id", "_sha", "n", "kept", "kept_text"])

    changed = changed.mapInArrow(run, "id long, _sha string, n long, kept string, kept_text string").dropDuplicates(["id", "_sha"])
    # every row of a sequence but its least document's is a copy
    usable = (F.col("n_words") >= window) & F.col("doc_id").isNotNull()
    rows = seen.drop("grams", "name")
    copies = spread_join(rows.where(usable), least, ["sha"], "n", seen.count()).drop("n")
    out = copies.unionByName(rows.where(~usable).withColumn("least", F.lit(None).cast("long"))).join(changed, F.expr("doc_id = id AND sha = _sha"), "left")
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256")]
    if texts:  # null: nothing was removed, the text stands as it is
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)
