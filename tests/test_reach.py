"""The walk from a set of seeds against one walk for each seed, in plain Python."""

import random

import pytest

from metaweave.operators import traverse


def by_hand(edges, seeds, reverse, depth, rels=None):
    """Each seed's own walk; of each node the nearest other seed, the smaller name of equally near ones, and the smallest (relation, parent) on its last step."""
    step = {}
    for rel, src, dst in edges:
        if rels is None or rel in rels:
            a, b = (dst, src) if reverse else (src, dst)
            step.setdefault(a, set()).add((b, rel))
    best, expanded = {}, set()
    for seed in {s for s in seeds if s is not None}:
        at = {seed: 0}
        frontier = [seed]
        for level in range(1, depth + 1):
            expanded |= set(frontier)
            via = {}
            for a in frontier:
                for b, rel in step.get(a, ()):
                    if b not in at and a != b:
                        via[b] = min(via.get(b, (rel, a)), (rel, a))
            for b, (rel, a) in via.items():
                at[b] = level
                best[b] = min(best.get(b, (level, seed, rel, a)), (level, seed, rel, a))
            frontier = list(via)
    followed = {(rel, src, dst) for rel, src, dst in edges if (rels is None or rel in rels) and (dst if reverse else src) in expanded}
    return {(q, *v) for q, v in best.items()}, followed


@pytest.mark.parametrize("number,density,reverse,depth,rels", [(1, 1.2, False, 1, None), (2, 1.5, True, 3, None), (3, 3.0, True, 5, ["A"]), (4, 2.0, False, 4, ["A", "B"])])
def test_as_by_hand(spark, number, density, reverse, depth, rels):
    r = random.Random(number)
    names = [f"n{i:02}" for i in range(40)]
    edges = sorted({(r.choice("ABC"), r.choice(names), r.choice([names[0], r.choice(names)])) for _ in range(int(40 * density))})
    seeds = r.sample(names, 12) + [names[0], names[0], None, "elsewhere"]
    e = spark.createDataFrame(edges, "rel_type string, src string, dst string")
    found = traverse.reach(e, spark.createDataFrame([(s,) for s in seeds], "qname string"), reverse, depth, rels)
    nodes, followed = by_hand(edges, seeds, reverse, depth, rels)
    assert {(x.qname, x.depth, x.seed, x.rel_type, x.parent) for x in found.nodes.collect()} == nodes
    assert found.nodes.count() == len(nodes)
    assert {(x.rel_type, x.src, x.dst) for x in found.edges.collect()} == followed


def test_nothing(spark):
    e = spark.createDataFrame([("A", "x", "x"), ("A", "x", "y"), ("A", "y", "x")], "rel_type string, src string, dst string")
    none = spark.createDataFrame([], "qname string")
    assert traverse.reach(e, none, False, 2).nodes.count() == 0
    assert traverse.reach(e.limit(0), spark.createDataFrame([("x",)], "qname string"), False, 2).nodes.count() == 0
    assert [x.qname for x in traverse.reach(e, spark.createDataFrame([("x",)], "qname string"), False, 5).nodes.collect()] == ["y"]
    with pytest.raises(ValueError):
        traverse.reach(e, none, False, 6)
