"""Exact top-k search by MaxScore over sharded postings of integer vectors.

A vector is a document whose terms are its components. A shard holds the vectors of up to SHARD_BYTES and is indexed once: for each
term and sign, the list of its rows. For a query, terms are sorted by bound, the most that any row of the shard can gain by
them. Rows are visited in ranges. The terms whose bounds together cannot lift a row to the k-th score so far are non-essential; in each
range the postings of the other, essential terms are traversed, and the rows found there are scored by them. The non-essential
terms are probed for these rows only, largest bound first, while a row can still compete. After each range the k-th score has risen,
so fewer terms are essential in the next. All queries stream past a shard in batches; the shards' results are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm.scratch import cut, frugal

#: Bytes of a shard's components; its index takes about twice as much again.
SHARD_BYTES = 32 << 20
RANGE_ROWS = 8192


def usable(v: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


class Shard:
    """Rows of any lengths, their components end to end, and for each term and sign the rows in which it has that sign."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        order = np.argsort(ids, kind="stable")
        first = np.cumsum(sizes) - sizes
        self.ids, self.sizes = ids[order], sizes[order]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = flat[np.repeat(first[order] - self.first, self.sizes) + np.arange(len(flat))]
        self.dims = int(self.sizes.max(initial=0))
        self.even = bool((self.sizes == self.dims).all())
        self.top = int(np.abs(self.flat).max(initial=0))
        row = np.repeat(np.arange(len(ids), dtype=np.int32), self.sizes)
        term = (np.arange(len(flat)) - np.repeat(self.first, self.sizes)).astype(np.int64)
        # one list for each (term, sign), rows ascending
        slot = 2 * term + (self.flat < 0)
        live = np.flatnonzero(self.flat)
        live = live[np.argsort(slot[live], kind="stable")]
        self.rows, self.values = row[live], self.flat[live]
        self.lists = np.searchsorted(slot[live], np.arange(2 * self.dims + 1))
        self.high, self.low = np.zeros(self.dims, np.int64), np.zeros(self.dims, np.int64)
        np.maximum.at(self.high, term, self.flat)
        np.minimum.at(self.low, term, self.flat)
        self.steps = np.array([[a + np.searchsorted(self.rows[a:z], at) for at in (*range(0, len(ids), RANGE_ROWS), len(ids))] for a, z in zip(self.lists[:-1], self.lists[1:], strict=True)], np.int64).reshape(2 * self.dims, -1)

    def probe(self, rows: np.ndarray, term: int) -> np.ndarray:
        """The rows' components of a term; 0 where they are shorter."""
        if self.even:
            return self.flat[rows * self.dims + term]
        there = term < self.sizes[rows]
        return np.where(there, self.flat[np.where(there, self.first[rows] + term, 0)], 0)

    def search(self, q: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but ``skip``, ties to smaller ids."""
        q = np.concatenate([q, np.zeros(max(0, self.dims - len(q)), np.int64)])[: self.dims]
        bound = np.maximum(0, np.maximum(q * self.high, q * self.low))
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # what terms[i:] can add at most
        ids, scores, level = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for step, at in enumerate(range(0, len(self.ids), RANGE_ROWS)):
            n = min(RANGE_ROWS, len(self.ids) - at)
            # rows that no essential term raises score less than the level
            essential = len(terms) if level is None else int(np.argmax(rest < level)) if rest[-1] < level else len(terms)
            everyone = level is None or rest[-1] >= level
            part, met = np.zeros(n, np.int64), np.full(n, everyone)
            for t in terms[:essential]:
                if not q[t]:
                    continue
                for sign in (0, 1):
                    a, z = self.steps[2 * t + sign, step], self.steps[2 * t + sign, step + 1]
                    here = self.rows[a:z] - at
                    part[here] += q[t] * self.values[a:z]
                    if (q[t] > 0) == (sign == 0):
                        met[here] = True
            alive = np.flatnonzero(met)
            alive = alive[self.ids[at + alive] != skip]
            part = part[alive]
            for i in range(essential, len(terms)):
                if i % 4 == 0:
                    keep = part + rest[i] >= level
                    if not keep.all():
                        alive, part = alive[keep], part[keep]
                if not len(alive):
                    break
                if q[terms[i]]:
                    part = part + q[terms[i]] * self.probe(at + alive, terms[i])
            ids, scores = np.concatenate([ids, self.ids[at + alive]]), np.concatenate([scores, part])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                level = scores[-1]
        return ids, scores


def search(vectors: DataFrame, is_query: Column, k: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``vectors``: vec_id, terms (array of longs, null: takes no part). Each query's k best other rows.

    Returns query_id, rank, vec_id, score. Missing components count as 0. Rows of one vec_id are one vector, the
    smallest of them. An empty table, or one without queries, gives no rows. Other columns are not read.
    A vector is shuffled once and held by one task, a shard at a time; each query goes to each shard. Scores must fit into 63 bits."""
    spark = vectors.sparkSession
    clean = vectors.where("vec_id IS NOT NULL AND terms IS NOT NULL").groupBy("vec_id").agg(F.min("terms").alias("terms"), F.max(is_query).alias("q"))
    clean = cut(clean)
    total = clean.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("d")).first()
    shards = max(1, -(-8 * (total["d"] or 0) // shard_bytes), min(spark.sparkContext.defaultParallelism, total["n"] // 4096))
    own = clean.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "terms")
    asked = clean.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "terms")
    both = own.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    names = ["query_id", "vec_id", "score"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index, rows = None, None, []
        for batch in batches:
            asks = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(asks)) + 1, [len(asks)]]) if len(asks) else np.zeros(1, np.int64)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, z - a)
                shard, asking = divmod(int(asks[a]), 2)
                if shard != number:
                    number, index, rows = shard, None, []
                ids, lists = np.asarray(part.column(2), np.int64), part.column(3)
                sizes, flat = np.diff(np.asarray(lists.offsets, np.int64)), np.asarray(lists.flatten(), np.int64)
                if not asking:
                    rows.append((ids, sizes, flat))
                    continue
                if index is None:
                    index = Shard(*[np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], []))])
                    rows = []
                found, at = [], np.concatenate([[0], np.cumsum(sizes)])
                for i, q in enumerate(ids.tolist()):
                    hits, scores = index.search(flat[at[i] : at[i + 1]], k, q)
                    found.append(np.stack([np.full(len(hits), q), hits, scores]))
                found = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and ``terms`` = floor(scale * component); null for vectors that take no part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return embeddings.select("vec_id", F.when(usable(F.col("embedding")), whole).alias("terms"))
