"""Layers of graphs with long chains, joins and cycles, against the definition; and the number of rounds."""

import random

from weft.operators import layout as L


def brute(nodes, edges):
    arcs = {(a, b) for a, b in edges if a != b and a in nodes and b in nodes}
    left, layer, out = set(nodes), 0, {}
    while True:
        ready = left - {b for a, b in arcs if a in left}
        if not ready:
            return out | dict.fromkeys(left, layer)
        out |= dict.fromkeys(ready, layer)
        left, layer = left - ready, layer + 1


def found(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node_id string")
    e = spark.createDataFrame(list(edges), "from_node_id string, to_node_id string")
    return {r.node_id: r.layer for r in L.layers(n, e).collect()}


def test_layers_of_odd_graphs(spark):
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(40)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(12)] + [("n3", "n20"), ("n12", "n20"), ("n20", "n21"), ("n30", "n31"), ("n31", "n32"), ("n32", "n30"), ("n32", "n33"), ("n33", "n34"), ("n34", "n21"), ("n5", "n5"), ("n1", "gone"), ("gone", "n2")]
    edges += [(nodes[a], nodes[b]) for a, b in (sorted(rng.sample(range(22, 30), 2)) for _ in range(12))]
    assert found(spark, nodes, edges) == brute(nodes, edges)
    assert found(spark, ["a", "b"], [("a", "b"), ("b", "a")]) == {"a": 0, "b": 0} and found(spark, [], []) == {}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: rounds.append(1) or cut(df))
    nodes = [f"n{i}" for i in range(5000)]
    assert found(spark, nodes, list(zip(nodes, nodes[1:]))) == {f"n{i}": i for i in range(5000)}
    assert len(rounds) < 30  # 13 doublings, two peels, and what is written around them
