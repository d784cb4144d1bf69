"""Near-duplicate vectors by sorted projection passes.

Each pass sorts the distinct vectors by the signs of random projections; the vectors of a run of equal signs are all
compared and linked, however long the run is. Passes carry the vectors in 16 bits a component with a bound of what that leaves out; the
few pairs whose cosine it leaves open are settled in double precision at the end. The number of signs follows from the number of vectors, the
number of passes from the signs: a pair exactly at the limit shares no run with a chance of MISS at most. Passes use
different projections; the union of their verified links gives the components. Within a component all direct links are
then counted: members close to the component's mean are linked with each other by the triangle inequality, and the few
others meet the members in blocks. Copies of a vector are compared once and counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm.blocks import pair_blocks
from tracesift.llm.graph import components
from tracesift.llm.scratch import cut, frugal
from tracesift.llm.topk import usable

#: A pair exactly at the limit is compared in no pass with this chance at most.
MISS = 1e-4
#: So many comparisons are worth carrying a row through a pass, in time and in shuffled bytes.
ROW_COST = 1536
#: What single precision adds to a product of two codes, at most.
ROUNDING = 1e-5
BLOCK_ROWS = 2048
PIVOTS = 16


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)
    return x


def _normal(v: np.ndarray) -> np.ndarray:
    """Unit vector in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


def units(embeddings: DataFrame) -> DataFrame:
    """vec_id, dims, unit (doubles as bytes) of the vectors that take part, one row for each vec_id."""
    clean = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    clean = clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_normal(np.array(v, np.float64)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "dims", "unit"])

    return clean.mapInArrow(run, "vec_id long, dims int, unit binary")


def _code(unit: np.ndarray) -> np.ndarray:
    """Rows of unit vectors as bytes: the scale, the length of what is left out, and 16 bits a component."""
    scale = np.abs(unit).max(1) / 32767
    code = np.rint(unit / scale[:, None]).astype(np.int16)
    left = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(1))
    return np.concatenate([np.stack([scale, left], 1).view(np.uint8), code.view(np.uint8)], 1)


def _decoded(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in single precision, and how far each is off at most."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    head = raw[:, :16].copy().view(np.float64)
    return raw[:, 16:].copy().view(np.int16).astype(np.float32) * head[:, :1].astype(np.float32), head[:, 1] + ROUNDING


def plan(rows: int, limit: float, miss: float = MISS) -> tuple[int, int]:
    """Passes and signs a pass for so many distinct vectors: the cheapest of those that keep ``miss`` at ``limit``.

    One random projection has equal signs for a pair of cosine c with a chance of 1 - acos(c) / pi, whatever the other vectors are.
    With no signs all vectors are one run and one pass compares every pair."""
    agree = 1 - math.acos(max(-1.0, min(1.0, limit))) / math.pi

    def passes(bits: int) -> int:
        chance = agree**bits
        return 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))

    bits = min((b for b in range(63) if agree**b > 1e-9), key=lambda b: passes(b) * (1 + rows / 2**b / ROW_COST))
    return passes(bits), bits


def hashed(vectors: DataFrame, passes: int, bits: int) -> DataFrame:
    """vec_id, dims, the vector's ``code``, and ``keys``: its ``bits`` signs in each pass as one number."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            all_dims = np.asarray(batch.column(1))
            for dims in np.unique(all_dims):
                part = batch.filter(pa.array(all_dims == dims))
                dims = int(dims)
                if dims not in planes:
                    planes[dims] = np.random.default_rng([97, dims]).normal(size=(dims, passes * bits))
                unit = _unit(part.column(2), dims)
                signs = unit @ planes[dims] > 0
                keys = signs.reshape(len(signs), passes, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * passes, pa.int32()), pa.array(keys.reshape(-1).astype(np.int64)))
                codes = pa.array([c.tobytes() for c in _code(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, lists], names=["vec_id", "dims", "code", "keys"])

    return vectors.select("vec_id", "dims", "unit").mapInArrow(run, "vec_id long, dims int, code binary, keys array<long>")


def _spanning(ids: np.ndarray, x: np.ndarray, off: np.ndarray, labels: np.ndarray, limit: float, n_left: int | None = None) -> pd.DataFrame:
    """Links (a, b) that connect what ``labels`` has apart, of all pairs or, with ``n_left``, of pairs of one of the first rows and a
    later one; ``sure`` is false where the vectors, which are ``off`` by so much at most, leave open whether they are linked."""
    _, root = np.unique(labels, return_inverse=True)
    out: list[np.ndarray] = []
    unsure: list[np.ndarray] = []
    for i in range(0, len(ids) if n_left is None else n_left, 256):
        last = min(i + 256, len(ids) if n_left is None else n_left)
        start = i if n_left is None else n_left
        cosine = x[i:last] @ x[start:].T
        slack = off[i:last, None] + off[start:] + off[i:last, None] * off[start:]
        if n_left is None:
            np.fill_diagonal(cosine, -2)
        near = cosine - slack >= limit
        for p in np.flatnonzero(near.any(1)):
            at = start + np.flatnonzero(near[p])
            at = at[root[at] != root[i + p]]
            if len(at):
                joined, first = np.unique(root[at], return_index=True)
                out.append(np.stack([np.full(len(joined), ids[i + p]), ids[at[first]]], 1))
                gone = np.zeros(root.max() + 1, bool)
                gone[joined] = True
                root[gone[root]] = root[i + p]
        a, b = np.nonzero((cosine + slack >= limit) & ~near)
        a, b = a + i, b + start
        apart = root[a] != root[b]
        unsure.append(np.stack([a[apart], b[apart]], 1))
    rest = np.concatenate(unsure) if unsure else np.zeros((0, 2), np.int64)
    rest = rest[root[rest[:, 0]] != root[rest[:, 1]]]  # most have been connected since
    pairs = np.concatenate([*out, ids[rest]]) if out or len(rest) else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0].astype(np.int64), "b": pairs[:, 1].astype(np.int64), "sure": np.arange(len(pairs)) < len(pairs) - len(rest)})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


_LINK = "a long, b long, sure boolean"


def settled(pairs: DataFrame, vectors: DataFrame, limit: float) -> DataFrame:
    """Distinct (a, b) of the sure ``pairs`` and those of the others whose cosine in double precision is at least ``limit``."""
    pairs = cut(pairs.distinct())
    unit = lambda key: vectors.select(F.col("vec_id").alias(key), F.col("unit").alias(f"u{key}"))
    rest = pairs.where("NOT sure").select("a", "b").join(unit("a"), "a").join(unit("b"), "b").select("a", "b", "ua", "ub")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [float(np.frombuffer(u, np.float64) @ np.frombuffer(v, np.float64)) >= limit for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.where("sure").select("a", "b").union(rest.mapInArrow(run, "a long, b long"))


def links(vectors: DataFrame, limit: float, miss: float = MISS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Verified links (a, b) of vectors that share a run in any pass, enough of them to connect all that runs connect.

    Runs don't depend on partitions. One longer than a block is split: each block is solved with the run's shared pivots
    first, then what remains outside the run's largest component meets the whole run."""
    signed = cut(hashed(vectors, *plan(vectors.count(), limit, miss)))
    run, keys = ["dims", "pass", "key"], F.posexplode("keys").alias("pass", "key")
    long_runs = signed.select("dims", keys).groupBy(*run).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    long_runs = cut(long_runs.select(*run, F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("blocks"), F.monotonically_increasing_id().alias("grp")))
    rows, columns = signed.select("vec_id", "dims", keys, "code"), ["vec_id", "dims", "pass", "key", "block", "code"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("vec_id").sort_values("vec_id")
        ids = pdf["vec_id"].to_numpy()
        return _spanning(ids, *_decoded(pdf["code"]), ids, limit)

    if long_runs.isEmpty():
        return settled(rows.groupBy(*run).applyInPandas(solve, _LINK), vectors, limit)
    large = rows.join(long_runs, run)
    pivots = large.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(f"k <= {PIVOTS}")
    spread = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = rows.join(long_runs, run, "left").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.coalesce("blocks", F.lit(1))).cast("int"))
    edges = cut(settled(split.select(*columns).union(spread.select(*columns)).groupBy(*run, "block").applyInPandas(solve, _LINK), vectors, limit))
    label = cut(components(edges)).withColumnRenamed("id", "_i")
    large = cut(large.join(label, F.expr("vec_id = _i"), "left").select("vec_id", "grp", "code", F.coalesce("component", "vec_id").alias("label")))
    counts = large.groupBy("grp", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n_all"))
    rest = counts.join(best, "grp").where("label <> main").groupBy("grp").agg(F.sum("n").alias("n_left"))
    info = cut(best.join(rest, "grp").select("grp", "main", *[F.ceil(F.col(c) / F.lit(block_rows)).cast("int").alias(n) for c, n in (("n_left", "lb"), ("n_all", "rb"))]))
    both = large.join(info, "grp")
    a, b = pair_blocks(both.where("label <> main"), both, "grp", "vec_id", "lb", "rb")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sure": np.zeros(0, bool)})
        pdf = pd.concat([x, y], ignore_index=True)
        return _spanning(pdf["vec_id"].to_numpy(), *_decoded(pdf["code"]), pdf["label"].to_numpy(), limit, len(x))

    return edges.union(settled(a.cogroup(b).applyInPandas(meet, _LINK), vectors, limit)).distinct()


def classes(embeddings: DataFrame, limit: float = 0.9, miss: float = MISS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (integer vec_id, embedding).

    Links have a cosine of at least ``limit`` in double precision. Vectors that are null, zero, or hold null or
    non-finite components, and rows with a null vec_id, link with nothing. Vectors of different lengths are never linked.
    Rows of one vec_id count as one vector, the smallest of them. Other columns are not read."""
    vectors = cut(units(embeddings))
    distinct = cut(vectors.groupBy("dims", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    label = cut(components(links(distinct, limit, miss, block_rows)))
    member = distinct.join(label.withColumnRenamed("id", "_id"), F.expr("vec_id = _id"), "left").where("copies > 1 OR component IS NOT NULL")
    member = cut(member.select("vec_id", F.coalesce("component", "vec_id").alias("grp"), "unit", "copies"))

    # the components' means, summed by task first
    @frugal
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(u, np.float64)
                held[g] = held[g] + x if g in held else x
            if len(held) > 100_000:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], names=["grp", "s"])

    part = member.select("grp", "unit").mapInArrow(sums, "grp long, s array<double>")
    mean = part.select("grp", F.posexplode("s").alias("i", "x")).groupBy("grp", "i").agg(F.sum("x").alias("x")).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    mean = cut(mean)  # stored, so that Spark can split a large component's partition of the join below
    near = math.cos(math.acos(limit) / 2) + 1e-9

    @frugal
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = []
            for u, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m = np.array(m)
                n = math.sqrt(float(m @ m))
                core.append(n > 0 and float(np.frombuffer(u, np.float64) @ m) / n >= near)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(core, pa.bool_())], names=["vec_id", "grp", "unit", "copies", "core"])

    marked = cut(member.join(mean, "grp").select("vec_id", "grp", "unit", "mean", "copies").mapInArrow(mark, "vec_id long, grp long, unit binary, copies long, core boolean"))
    info = marked.groupBy("grp").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("n_core"), F.count_if(~F.col("core")).alias("n_far"), F.count("*").alias("n_all"))
    info = info.select("grp", "n_core", *[F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(block_rows))).cast("int").alias(n) for c, n in (("n_far", "lb"), ("n_all", "rb"))], "n_far")
    both = marked.join(info.where("n_far > 0").select("grp", "lb", "rb"), "grp")
    a, b = pair_blocks(both.where("NOT core"), both, "grp", "vec_id", "lb", "rb")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        if len(x) and len(y):
            left, right = _matrix(x["unit"]), _matrix(y["unit"])
            ids, others = x["vec_id"].to_numpy(), y["vec_id"].to_numpy()
            hit = (left @ right.T >= limit) & (ids[:, None] != others)
            core = y["core"].to_numpy(bool)
            out = {"vec_id": np.concatenate([ids, others[core]]), "n": np.concatenate([hit @ y["copies"].to_numpy(np.int64), x["copies"].to_numpy(np.int64) @ hit[:, core]])}
        return pd.DataFrame(out)

    extra = a.cogroup(b).applyInPandas(meet, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("extra")).withColumnRenamed("vec_id", "_v")
    counted = marked.select("vec_id", "grp", "unit", "copies", "core").join(info.select("grp", "n_core"), "grp").join(extra, F.expr("vec_id = _v"), "left")
    counted = counted.select("unit", "grp", (F.when(F.col("core"), F.col("n_core")).otherwise(F.col("copies")) - 1 + F.coalesce("extra", F.lit(0))).alias("n"))
    counted = vectors.join(counted, "unit").select(F.col("vec_id").alias("_v"), "grp", "n")
    out = embeddings.select("vec_id").join(counted, F.expr("vec_id = _v"), "left")
    own = F.coalesce("grp", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
