"""Near-duplicate documents by HyperMinHash, with every link verified on the documents' own words.

1. A pass over the texts hashes word shingles and keeps, for each of 256 buckets, the least hash as a register of
   leading-zero count and mantissa bits. Empty registers borrow from a filled one in an order fixed by bucket.
   Registers are hashed by bands, as long as the threshold allows. Only the band hashes, the set's size and its digest (128 bits of
   two independent hash families) leave the pass.
2. Documents of equal sets are one class. Two sets of the asked similarity share a band but with a chance of MISS (at the
   threshold; far less above). The candidates of a band gather around its smallest class: a star group.
3. Within a star group, every pair of classes not yet connected is compared: by size, by the registers' Jaccard
   estimate less its expected collisions, then exactly: words are numbered by a dictionary, so equal shingles are equal words.
   A group larger than a block is split, and each block is solved with the group's shared pivots. What that leaves
   apart within a band meets in pairs of blocks, band by band.
4. Components of the verified links give each document its class id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm.blocks import pair_blocks, spread_join
from tracesift.llm.graph import components
from tracesift.llm.scratch import cut, frugal
from tracesift.llm.textscan import mix, runs, sequence, slices, word_hashes, words

BUCKETS, MANTISSA = 256, 10
#: A pair at the threshold shares no band with this chance at most.
MISS = 1e-4
BLOCK_SHINGLES = 40_000
PIVOTS = 16
#: How far below the threshold an estimate may fall before a pair is ruled out: over five standard deviations.
SLACK = 0.14

_rng = np.random.default_rng(41)
_ORDER = _rng.permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)
_SALT = _rng.integers(1, 1 << 62, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int, family: int = 0) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of rows: the first row's index, and each row's sorted distinct shingle hashes of a family."""
    for first, _, body, offsets in slices(texts):
        _, _, hashes, at = words(body, offsets, True, family)
        yield first, _sets_of(hashes, at, width)


def _sets_of(hashes: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    whole, sets = runs(hashes, width), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        else:
            sets.append(np.array([sequence(hashes[a:b])] if b > a else [], np.uint64))
    return sets


def exact_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as numbers that stand for the same words throughout ``texts``, and for no others."""
    split = [t.encode().lower().split() for t in texts]  # bytes know ASCII white space and letters only
    flat = list(chain.from_iterable(split))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    keys, many = word, len(number)
    for k in range(1, width):
        if many * len(number) >= 1 << 62:  # number the runs so far, so that a longer one still fits
            known, keys = np.unique(keys, return_inverse=True)
            many = len(known)
        n = max(0, len(word) - k)
        keys, many = keys[:n] * len(number) + word[k:], many * len(number)
    short: dict[tuple, int] = {}
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= width:
            own = keys[at : at + n - width + 1]
        else:
            own = np.array([-1 - short.setdefault(tuple(ws), len(short))] if n else [], np.int64)
        out.append(np.unique(mix(own.view(np.uint64))))  # the mixer is one to one
        at += n
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash sketches: one row of BUCKETS registers a set; 0 where no hash fell into the bucket.

    A hash's first 8 bits choose the bucket. Of the other 56, the register has the number of leading zeros and the MANTISSA
    bits after the first one; among registers of one bucket, more zeros and smaller mantissas mean smaller hashes."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    if not len(flat):
        return out
    slot = np.repeat(np.arange(len(sets)), n) * BUCKETS + (flat >> np.uint64(56)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))  # sets are sorted: the first is the least
    low = flat[least] << np.uint64(8)
    zeros = 53 - np.frexp((low >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)  # exact: 53 bits
    zeros = np.minimum(zeros, 50)
    mantissa = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[slot[least]] = (zeros + 1) * (1 << MANTISSA) + mantissa.astype(np.int64)
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers copy a filled one: of all filled buckets, the first in the bucket's own random order."""
    out = sketches.copy()
    for row in np.flatnonzero((sketches == 0).any(1) & (sketches != 0).any(1)):
        empty, full = np.flatnonzero(sketches[row] == 0), np.flatnonzero(sketches[row])
        out[row, empty] = sketches[row, full[_ORDER[empty][:, full].argmin(1)]]
    return out


def rows_a_band(limit: float) -> int:
    """The longest bands that a pair of Jaccard similarity ``limit`` still shares one of, but with a chance of MISS."""
    return max(r for r in range(1, 17) if r == 1 or (1 - limit**r) ** (BUCKETS // r) <= MISS)


def band_hashes(sketches: np.ndarray, rows: int) -> np.ndarray:
    """[sets, bands] hashes of filled sketches' bands of ``rows`` registers."""
    bands = BUCKETS // rows
    x = mix(sketches.astype(np.uint64) * _SALT + _SALT[::-1])[:, : bands * rows].reshape(len(sketches), bands, rows).sum(2, dtype=np.uint64)
    return mix(x + np.arange(bands, dtype=np.uint64) * _SALT[:bands]).view(np.int64)


def estimate(sketch: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch against others, less the matches expected from colliding registers.

    Two different least hashes of a bucket that got k hashes share a register with a chance of about 2 / 3 / 2**MANTISSA,
    whatever k is, as the leading-zero count adapts the register's scale to the hash."""
    used = (sketch != 0) | (others != 0)
    same = (sketch == others) & used
    n = np.maximum(used.sum(1), 1)
    chance = 2 / 3 / (1 << MANTISSA)
    return np.clip((same.sum(1) / n - chance) / (1 - chance), 0, 1)


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's digest (two longs) and band hashes of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, body, offsets in slices(batch.column(2)):
                begin, end, hashes, at = words(body, offsets, True)
                sets = _sets_of(hashes, at, width)
                other = _sets_of(word_hashes(body, begin, end, True, 1), at, width)
                n = np.array([len(s) for s in sets], np.int64)
                d = np.array([[s.sum(), t.sum()] for s, t in zip(sets, other, strict=True)], np.uint64).view(np.int64).reshape(-1, 2)
                bands = band_hashes(filled(registers(sets)), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (BUCKETS // rows), pa.int32()), pa.array(bands.reshape(-1)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], names=["doc_id", "text_hash", "n_shingles", "d0", "d1", "bands"])

    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, d0 long, d1 long, bands array<long>")


def text_hash() -> Column:
    """Tells apart texts of one doc_id; a null text is the empty one."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


class _Union:
    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)

    def join(self, a: int, others: np.ndarray) -> None:
        mine = self.of[a]
        for c in np.unique(self.of[others]):
            if c != mine:
                self.of[self.of == c] = mine


def links(ids: np.ndarray, shingles: list[np.ndarray], labels: np.ndarray, num: int, den: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links: pairs of sets with den * intersection >= num * union that connect what ``labels`` has apart.

    With ``left`` (a mask) only pairs of a left and another row are looked at. Sets nearest to the common sketch
    come first: they are the likeliest hubs, and what they connect needs no further comparison."""
    union, out = _Union(labels), []
    sizes = np.array([len(s) for s in shingles])
    if len(ids) < 2:
        return out
    sketches = registers(shingles)
    limit = num / den
    if len(ids) == 2:
        order = np.array([0])
    else:
        common = np.array([np.bincount(c).argmax() for c in sketches[:512].T], np.uint16)
        order = np.argsort(-((sketches == common) & (common != 0)).sum(1), kind="stable")
    flat = np.concatenate(shingles)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    done = np.zeros(len(ids), bool)
    for p in order:
        if left is not None and not left[p]:
            continue
        done[p] = True
        other = (union.of != union.of[p]) & ~done
        if left is not None:
            other &= ~left
        other &= (den * sizes >= num * sizes[p]) & (num * sizes <= den * sizes[p])
        rows = np.flatnonzero(other)
        if not len(rows):
            continue
        rows = rows[estimate(sketches[p], sketches[rows], sizes[p], sizes[rows]) >= limit - SLACK]
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            part = part[union.of[part] != union.of[p]]
            if not len(part):
                continue
            own = np.concatenate([flat[edges[r] : edges[r + 1]] for r in part])
            at = np.searchsorted(shingles[p], own)
            hit = shingles[p][np.minimum(at, sizes[p] - 1)] == own
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            linked = part[den * both >= num * (sizes[part] + sizes[p] - both)]
            if len(linked):
                new = linked[np.unique(union.of[linked], return_index=True)[1]]
                out += [(int(ids[p]), int(ids[r])) for r in new]
                union.join(p, linked)
    return out


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": np.array([p[0] for p in pairs], np.int64), "b": np.array([p[1] for p in pairs], np.int64)})


def _links(reps: DataFrame, docs: DataFrame, width: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """Verified links (a, b: nodes of ``reps``), enough of them to connect all that bands bring together."""
    banded = reps.select("node", "n_shingles", F.explode(F.array_distinct("bands")).alias("band"))
    lowest = cut(banded.groupBy("band").agg(F.min("node").alias("grp"), F.max("node").alias("high"), F.count("*").alias("n")).where("grp < high").select("band", "grp", "n"))
    n_bands = reps.count() * (BUCKETS // rows_a_band(num / den))
    star = cut(spread_join(banded, lowest, ["band"], "n", n_bands).select("node", "n_shingles", "grp").distinct())
    total = star.groupBy("grp").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n")).where("n > 1")
    blocks = total.select("grp", "n", F.ceil(F.col("total") / F.lit(block_shingles)).cast("int").alias("blocks"))
    member = cut(spread_join(star, blocks, ["grp"], "n", star.count()).drop("n"))
    wide = member.where("blocks > 1")
    pivots = wide.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node"))).where(f"k <= {PIVOTS}")
    place = member.select("node", "grp", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("block"))
    place = place.union(pivots.select("node", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))).groupBy("node").agg(F.collect_set(F.struct("grp", "block")).alias("places"))
    # one text of each node, however often it occurs
    wanted = reps.select("node", "doc_id", "text_hash").join(place, "node").select("doc_id", "text_hash", "node", "places")
    texts = docs.select("doc_id", text_hash(), "text").join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash")
    texts = cut(texts.agg(*[F.first(c).alias(c) for c in ("node", "text", "places")]).select("node", "text", "places"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        return _frame(links(ids, exact_sets(pdf["text"].tolist(), width), ids, num, den) if len(ids) > 1 else [])

    edges = cut(texts.select("node", "text", F.explode("places").alias("p")).groupBy("p.grp", "p.block").applyInPandas(solve, "a long, b long"))
    wide = cut(wide.groupBy("grp").agg(F.first("blocks").alias("blocks")))
    if wide.isEmpty():
        return edges
    # what the blocks of a group have left apart meets band by band; bands of the same members are one
    label = components(edges).toDF("node", "label")
    within = lowest.join(wide.select("grp"), "grp").select("band", "n")
    within = spread_join(banded, within, ["band"], "n", n_bands).drop("n").join(label, "node", "left").select("node", "n_shingles", "band", F.coalesce("label", "node").alias("label"))
    within = cut(within)
    counts = within.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
    each = counts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max(F.struct("n", "label", "size"))["size"].alias("main_size"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("mark").alias("mark"), F.count("*").alias("labels")).where("labels > 1")
    each = each.groupBy("n", "mark").agg(F.min(F.struct("band", "main", "main_size", "size")).alias("r")).select("n", "r.*")
    each = each.select("band", "n", "main", F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("main_size")) / F.lit(block_shingles))).cast("int").alias("lb"), F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(block_shingles))).cast("int").alias("rb"))
    meeting = spread_join(within, each, ["band"], "n", n_bands).groupBy("node").agg(F.collect_list(F.struct("band", "label", "main", "lb", "rb")).alias("bands"))
    both = cut(texts.select("node", "text").join(meeting, "node")).select("node", "text", F.explode("bands").alias("b")).select("node", "text", "b.*")
    a, b = pair_blocks(both.where("label <> main"), both, "band", "node", "lb", "rb")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return _frame([])
        pdf = pd.concat([x, y], ignore_index=True)
        left = np.arange(len(pdf)) < len(x)
        return _frame(links(pdf["node"].to_numpy(), exact_sets(pdf["text"].tolist(), width), pdf["label"].to_numpy(), num, den, left))

    return edges.union(cut(a.cogroup(b).applyInPandas(meet, "a long, b long")))


def classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, first for every row of ``docs`` (integer doc_id, text).

    Sets are linked where den * intersection >= num * union; component_id is the smallest doc_id reachable, and ``kept`` is whether
    it is the row's own. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than ``width`` words is
    one shingle; a null or wordless text has none and is linked with nothing. Rows of a null doc_id have a null component and
    belong to no class. Rows with one doc_id and different texts are classed by text. ``first``: the row has the class's
    least (doc_id, text_hash), as all of a class's rows that repeat it have; rows of no class are all first. An empty table gives
    no rows. Other columns are not read."""
    sig = cut(signatures(docs, width, rows_a_band(num / den)))
    digest = ["n_shingles", "d0", "d1"]
    known = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = known.groupBy(*digest).agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "bands")).alias("r"), F.count("*").alias("rows"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("node"), "r.*", *digest, "rows"))
    label = components(_links(reps, docs, width, num, den, block_shingles)).toDF("node", "label")
    label = cut(reps.select("node", "doc_id", "text_hash", *digest, "rows").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    best = label.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"), F.count("*").alias("n"))
    named = cut(spread_join(label.select("label", *digest, "rows"), best, ["label"], "n", label.count()).select(*digest, "rows", "best"))
    out = spread_join(known.drop("bands"), named, digest, "rows", sig.count())
    none = sig.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").drop("bands").withColumn("rows", F.lit(0).cast("long")).withColumn("best", F.struct(F.when(F.col("n_shingles") == 0, F.col("doc_id").cast("long")).alias("doc_id"), "text_hash"))
    out = out.unionByName(none)
    own = F.col("best.doc_id")
    least = own.isNull() | (own == F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"), least.alias("first"))
