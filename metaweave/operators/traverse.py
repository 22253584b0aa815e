"""Graph traversal: level by level, with what was reached written after each level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Levels a traversal may ask for.
MAX_DEPTH = 5


@dataclass
class Reached:
    """nodes: seed, qname, depth, rel_type and parent of the first edge; edges: the edges that were followed; truncated: whether the cap ended it."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _oriented(edges: DataFrame, reverse: bool, rels: list[str] | None) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    d = edges.filter(F.col("rel_type").isin(rels)) if rels else edges
    return d.select(F.col(a).alias("at"), F.col(b).alias("to"), "rel_type")


def walk(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int = 3, rels: list[str] | None = None, cap: int | None = None, check_depth: bool = True) -> Reached:
    """Breadth-first from each row of seeds (qname), all seeds at once; a node's first edge is the smallest (rel_type, parent).

    A frontier is joined with the edges on their start; Spark broadcasts it while its written size is small and
    shuffles it otherwise. With a cap, whole levels are taken in the order (depth, rel_type, qname) until a seed
    has so many nodes, its own among them.
    """
    if check_depth and not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    e = _oriented(edges, reverse, rels)
    none = F.lit(None).cast("string")
    frontier = materialize(seeds.select(F.col("qname").alias("seed"), "qname", F.lit(0).alias("depth"), none.alias("rel_type"), none.alias("parent")).distinct())
    seen, truncated, level = frontier, False, 0
    while level < depth:
        level += 1
        step = frontier.select("seed", F.col("qname").alias("at")).join(e, "at").groupBy("seed", F.col("to").alias("qname")).agg(F.min(F.struct("rel_type", F.col("at").alias("parent"))).alias("via"))
        new = step.join(seen.select("seed", "qname"), ["seed", "qname"], "left_anti").select("seed", "qname", F.lit(level).alias("depth"), "via.rel_type", "via.parent")
        if cap is not None:
            have = seen.groupBy("seed").agg(F.count("*").alias("have"))
            place = F.row_number().over(Window.partitionBy("seed").orderBy("rel_type", "qname"))
            new = new.join(have, "seed").withColumn("place", place).filter((F.col("place") <= cap) & (F.col("place") + F.col("have") <= cap)).drop("place", "have")
        frontier = materialize(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if cap is not None:
        truncated = not seen.groupBy("seed").count().filter(F.col("count") >= cap).isEmpty()
    expanded = seen.filter(F.col("depth") < depth).select(F.col("qname").alias("at")).distinct()
    back = ("to", "at") if reverse else ("at", "to")
    followed = e.join(expanded, "at", "left_semi").select(F.col(back[0]).alias("src"), F.col(back[1]).alias("dst"), "rel_type").distinct()
    return Reached(seen, followed, truncated)


def reach(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int = 3, rels: list[str] | None = None) -> Reached:
    """What any of the seeds reaches, each node once: qname, seed, depth, rel_type, parent of the nearest seed (the smallest of equally near ones) other than the node itself.

    A node keeps its two nearest seeds and no more: a third one is at no neighbour among the nearest two that aren't the neighbour itself, so
    a level has two rows a node, however many seeds there are. Seeds are among the nodes only if another seed reaches them. Repeated seeds count once.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    e = _oriented(edges, reverse, rels).filter("at <> to")
    none = F.lit(None).cast("string")
    frontier = materialize(seeds.select(F.col("qname").alias("seed"), "qname", F.lit(0).alias("depth"), none.alias("rel_type"), none.alias("parent")).filter("qname IS NOT NULL").dropDuplicates(["qname"]))
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.select("seed", F.col("qname").alias("at")).join(e, "at").groupBy(F.col("to").alias("qname"), "seed").agg(F.min(F.struct("rel_type", F.col("at").alias("parent"))).alias("via"))
        new = step.join(seen.select("qname", "seed"), ["qname", "seed"], "left_anti")
        first = new.withColumn("place", F.row_number().over(Window.partitionBy("qname").orderBy("seed"))).filter("place <= 2")
        have = seen.groupBy("qname").agg(F.count("*").alias("have"))
        kept = first.join(have, "qname", "left").filter(F.col("place") + F.coalesce("have", F.lit(0)) <= 2)
        frontier = materialize(kept.select("seed", "qname", F.lit(level).alias("depth"), "via.rel_type", "via.parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    nearest = seen.filter("seed <> qname").groupBy("qname").agg(F.min(F.struct("depth", "seed", "rel_type", "parent")).alias("x"))
    nodes = nearest.select("x.seed", "qname", "x.depth", "x.rel_type", "x.parent")
    expanded = seen.groupBy(F.col("qname").alias("at")).agg(F.min("depth").alias("d")).filter(F.col("d") < depth).select("at")
    back = ("to", "at") if reverse else ("at", "to")
    followed = _oriented(edges, reverse, rels).join(expanded, "at", "left_semi").select(F.col(back[0]).alias("src"), F.col(back[1]).alias("dst"), "rel_type").distinct()
    return Reached(nodes, followed, False)


def trace(edges: DataFrame, qname: str, reverse: bool, depth: int = 3, rels: list[str] | None = None, cap: int | None = None) -> Reached:
    """From one node; the node itself isn't among the nodes returned."""
    seeds = edges.sparkSession.createDataFrame([(qname,)], "qname string")
    r = walk(edges, seeds, reverse, depth, rels, cap)
    return Reached(r.nodes.filter("depth > 0"), r.edges, r.truncated)


def hydrate(reached: DataFrame, nodes: DataFrame, unknown: str | None = None) -> DataFrame:
    """Labels of the nodes reached; those without a row are dropped, or get this label."""
    labels = nodes.select("qname", "label")
    if unknown is None:
        return reached.join(labels, "qname")
    return reached.join(labels, "qname", "left").withColumn("label", F.coalesce("label", F.lit(unknown)))


def neighborhood(edges: DataFrame, qname: str, depth: int = 2, rels: list[str] | None = None, cap: int | None = None) -> Reached:
    """Both directions at once; each edge once."""
    if not 1 <= depth <= 4:
        raise ValueError("depth must be 1 to 4")
    both = edges.select("rel_type", "src", "dst").unionByName(edges.select("rel_type", F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = edges.sparkSession.createDataFrame([(qname,)], "qname string")
    r = walk(both, seeds, False, depth, rels, cap)
    near = r.nodes.filter(F.col("depth") < depth).select("qname")
    own = edges.filter(F.col("rel_type").isin(rels)) if rels else edges
    touched = own.join(near.withColumnRenamed("qname", "src"), "src", "left_semi").select("src", "dst", "rel_type").union(own.join(near.withColumnRenamed("qname", "dst"), "dst", "left_semi").select("src", "dst", "rel_type")).distinct()
    return Reached(r.nodes, touched, r.truncated)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    q = nodes.select("qname").distinct()
    return edges.join(q.withColumnRenamed("qname", "src"), "src", "left_semi").join(q.withColumnRenamed("qname", "dst"), "dst", "left_semi")


def overview(nodes: DataFrame, edges: DataFrame, labels: list[str], cap: int = 1500) -> tuple[DataFrame, DataFrame]:
    """The first nodes of these labels by qname, and the edges between them."""
    some = nodes.filter(F.col("label").isin(labels)).orderBy("qname").limit(cap)
    return some, induced(edges, some)


def schema_view(nodes: DataFrame, edges: DataFrame, labels: list[str], rels: list[str]) -> DataFrame:
    """Edges of these relations with at least one end among the nodes of these labels: one hop both ways."""
    q = nodes.filter(F.col("label").isin(labels)).select("qname").distinct()
    own = edges.filter(F.col("rel_type").isin(rels)).select("rel_type", "src", "dst")
    return own.join(q.withColumnRenamed("qname", "src"), "src", "left_semi").select("rel_type", "src", "dst").union(own.join(q.withColumnRenamed("qname", "dst"), "dst", "left_semi").select("rel_type", "src", "dst")).distinct()


def fan_in(edges: DataFrame, qname: str, rels: list[str]) -> DataFrame:
    """Who points at a node, by relation."""
    return edges.filter((F.col("dst") == qname) & F.col("rel_type").isin(rels)).select("rel_type", "src").distinct()


def typed_flow(edges: DataFrame, entry: str, rels: list[str], cap: int = 100) -> Reached:
    """Forward over these relations without a bound on depth, until nothing is new or the cap is reached; with every edge of the nodes visited."""
    seeds = edges.sparkSession.createDataFrame([(entry,)], "qname string")
    r = walk(edges, seeds, False, 10_000, rels, cap, check_depth=False)
    out = edges.filter(F.col("rel_type").isin(rels)).join(r.nodes.select(F.col("qname").alias("src")), "src", "left_semi").select("src", "dst", "rel_type")
    return Reached(r.nodes, out, r.truncated)
