"""Connected components: results, and plans that don't grow within a step."""

import numpy as np

from tracesift.llm import graph


def test_components_store_what_a_join_plans_again(spark, monkeypatch):
    sizes, cut = [], graph.cut

    def counted(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Join ") + plan.count("Aggregate "))
        return cut(df)

    monkeypatch.setattr(graph, "cut", counted)
    ids = np.random.default_rng(3).permutation(60).tolist()
    pairs = list(zip(ids[:39], ids[1:40], strict=True)) + [(ids[40], i) for i in ids[41:59]] + [(ids[59], ids[59]), (None, ids[0])]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: min(g) for g in (ids[:40], ids[40:59]) for i in g}
    assert max(sizes) <= 6
