"""How much the levels of a graph write on their way."""

from rowloom.operators import graph


def test_levels_write_few_rows(spark, monkeypatch):
    written = []

    def counted(kept):
        def run(df):
            made = kept(df)
            written.append((made[0] if isinstance(made, tuple) else made).count())
            return made
        return run

    for name in ("materialize", "materialize_counted"):
        monkeypatch.setattr(graph, name, counted(getattr(graph, name)))
    # 100 owners of runs of 20 nodes each, as customers and their orders.
    nodes = spark.range(2000)
    steps = nodes.where("id % 20 < 19").selectExpr("id as src", "id + 1 as dst")
    edges = steps.unionByName(nodes.selectExpr("-(id div 20) - 1 as src", "id as dst")).localCheckpoint()
    levels = graph.load_levels(edges)
    assert levels.where("node < 0 and level <> 0 or node >= 0 and level <> node % 20 + 1").isEmpty()
    assert levels.count() == 2100
    assert sum(written) < 8 * edges.count(), sum(written)
