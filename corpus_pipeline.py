"""A corpus pipeline over ``documents``: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
stores each stage's result and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import mixing, neardup, packing, secrets, toxicity
from tracesift.llm.queries import fold_of, tokenizer_path
from tracesift.llm.scratch import cut

REJECT = 0.3


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity score rejects. The lexicon is learnt from labelled documents of the training fold."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold_of(4) != 2)
    return toxicity.flagged(docs, model, REJECT, keep=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class (five words, 0.8): that of the smallest doc_id, and of its texts the first by hash.

    Documents without words stay: they are linked with nothing. A row is told by its doc_id and text, so rows that share a
    doc_id fare as their texts do; of rows with one doc_id and one text one stays, that of the least other columns. Null
    texts count as empty. Rows of a null doc_id belong to no class, and all stay. An empty table stays empty."""
    classes = neardup.classes(docs, width=5, num=80, den=100)
    found = cut(classes.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.bool_and("first").alias("first"), F.count("*").alias("n")).where("NOT first OR n > 1"))
    mark = neardup.text_hash()
    rest = lambda kind, cond: docs.join(found.where(cond).select("doc_id", "text_hash"), (docs["doc_id"] == found["doc_id"]) & (mark == found["text_hash"]), kind).select(*[docs[c] for c in docs.columns])
    alone = rest("left_anti", "true")
    if found.where("first").isEmpty():
        return alone
    others = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    once = rest("left_semi", "first").groupBy("doc_id", mark).agg(F.min(F.struct("text", *others)).alias("r"))
    return alone.union(once.select("doc_id", "r.*").select(*[f"`{c}`" for c in docs.columns]))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; no document is dropped."""
    out = secrets.masked(docs, cut(secrets.scan(docs)))
    return out.withColumn("n_chars", F.when(out["text"].isNull(), out["n_chars"]).otherwise(F.length("text").cast("long")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all."""
    return mixing.materialise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row and their places in sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.sequences(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("minhash_neardup", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The first and last stages (a learnt lexicon, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
