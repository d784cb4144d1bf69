"""The corpus pipeline: each stage on what its predecessor kept, against plain Python where SQL has no form."""

import corpus_pipeline as P
from test_texts import brute_classes

from tracesift.llm import mixing
from tracesift.llm.scratch import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = cut(P.toxic(spark, docs, sf_dir))
    assert kept.columns == names and 0 < kept.count() <= docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    alone = cut(P.near_duplicates(spark, kept, sf_dir))
    want = {i for i, (_, c) in brute_classes(rows, 5, 80, 100).items() if i == c}
    assert {r.doc_id for r in alone.collect()} == want and alone.columns == names
    masked = cut(P.secret_scans(spark, alone, sf_dir))
    assert masked.columns == names and masked.count() == alone.count()
    assert not masked.where("text RLIKE 'AKIA[A-Z0-9]{16,}'").count()
    mixed = cut(P.source_mixing(spark, masked, sf_dir))
    assert mixed.columns == names
    taken = {r.doc_id: r.taken / max(r.size, 1) for r in mixing.take(masked).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(abs(times.get(i, 0) - t) <= 0.5 for i, t in taken.items() if t)
    packed = P.best_fit_packing(spark, mixed, sf_dir)
    assert packed.where("piece = 0").count() == mixed.count() and packed.agg({"length": "max"}).first()[0] <= 4096


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0 and P.ORACLE_SQL is None
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_neardup", "secret_scans", "source_mixing", "best_fit_packing"]


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    text, other = "one two three four five six seven", "quite another text of eight words in all"
    rows = [(3, text), (3, text), (4, text), (5, other), (5, other), (6, None), (6, None), (7, "short"), (None, text), (None, text), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, text), (5, other), (6, None), (7, "short"), (None, text), (None, text), (None, None)], key=str)


def test_rows_that_share_a_doc_id_fare_as_their_texts_do(spark):
    text, other = "one two three four five six seven", "quite another text of eight words in all"
    rows = [(3, text), (5, other), (5, text), (8, text + " eight"), (9, other), (9, "a third text that has nothing to do with them")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()}
    assert got == {(3, text), (5, other), (8, text + " eight"), (9, "a third text that has nothing to do with them")}


def test_stages_on_edge_rows(spark, edge, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names: every stage keeps the columns, and clean rows their texts."""
    labels = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge.withColumn("n_chars", edge["size"])
    for name, stage in P.STAGES[:-1]:
        out = cut(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.collect()}
        assert {3, 4, 5, 6, 8, None} <= ids, name
        if name == "minhash_neardup":
            assert 2 not in ids and out.where("doc_id = 6").count() == 1 and 7 not in ids
        if name == "secret_scans":
            assert "[SECRET]" in out.where("doc_id = 9").first().text and out.where("doc_id = 1").first()._blob == docs.where("doc_id = 1").first()._blob
        docs = out
        assert cut(stage(spark, empty.withColumn("n_chars", empty["size"]), str(tmp_path))).count() == 0, name
    packed = P.best_fit_packing(spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()
