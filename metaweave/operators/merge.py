"""Upserts by content hash, deletions, renames: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

INSERTED, UPDATED, UNCHANGED = "inserted", "updated", "unchanged"


def last_of_each(facts: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last fact of each key in the batch; `times` tells how many there were, `first` the earliest one's hash."""
    return facts.groupBy(*key).agg(F.max_by(F.struct(*[c for c in facts.columns if c not in key]), order).alias("f")).select(*key, "f.*")


def merge_actions(stored: DataFrame, facts: DataFrame, key: list[str], changed_by: str) -> DataFrame:
    """key and what the merge of each fact does: inserted, updated (changed_by differs) or unchanged. One full outer join on the key, of the facts' side."""
    s = stored.select(*key, F.col(changed_by).alias("__old"), F.lit(True).alias("__had"))
    d = facts.join(s, key, "left")
    action = F.when(F.col("__had").isNull(), INSERTED).when(F.col("__old").eqNullSafe(F.col(changed_by)), UNCHANGED).otherwise(UPDATED)
    return d.select(*key, action.alias("action"))


def merge(stored: DataFrame, facts: DataFrame, key: list[str], now: int, changed_by: str = "source_hash", modified: bool = True, seen: Observation | None = None) -> DataFrame:
    """stored with facts (one of each key): new rows as they are; changed ones with the fact's content, the first time seen kept; unchanged ones seen again.

    Both sides are shuffled once, on the key. Times are milliseconds; last_modified_at moves only with content.
    seen: gets how many were inserted, updated and unchanged once the result has been written.
    """
    content = [c for c in stored.columns if c not in (*key, "first_seen_at", "last_seen_at", "last_modified_at")]
    s = stored.select(*key, F.struct(*[c for c in stored.columns if c not in key]).alias("o"), F.lit(True).alias("__had"))
    f = facts.select(*key, F.struct(*[c for c in facts.columns if c not in key]).alias("f"), F.lit(True).alias("__new"))
    d = s.join(f, key, "full_outer")
    new, had = F.col("__new").isNotNull(), F.col("__had").isNotNull()
    changed = new & had & ~F.col(f"o.{changed_by}").eqNullSafe(F.col(f"f.{changed_by}"))
    fresh = new & (~had | changed)
    if seen is not None:
        d = d.observe(seen, F.count_if(new & ~had).alias(INSERTED), F.count_if(changed).alias(UPDATED), F.count_if(new & had & ~changed).alias(UNCHANGED))
    out = [F.col(k) for k in key] + [F.when(fresh, F.col(f"f.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in content]
    times = {"first_seen_at": F.when(had, F.col("o.first_seen_at")).otherwise(F.lit(now)), "last_seen_at": F.when(new, F.lit(now)).otherwise(F.col("o.last_seen_at"))}
    if modified:
        times["last_modified_at"] = F.when(fresh, F.coalesce(F.col("f.last_modified_at"), F.lit(now)) if "last_modified_at" in facts.columns else F.lit(now)).otherwise(F.col("o.last_modified_at"))
    return d.select(*out, *[c.cast("long").alias(n) for n, c in times.items() if n in stored.columns]).select(stored.columns)


def counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def batch_actions(stored: DataFrame, facts: DataFrame, key: list[str], order: str, changed_by: str = "source_hash") -> DataFrame:
    """As merge_actions, for facts that repeat a key and apply in order: each is compared with what stood before it."""
    w = Window.partitionBy(*key).orderBy(order)
    s = stored.select(*key, F.col(changed_by).alias("__old"), F.lit(True).alias("__had"))
    d = facts.join(s, key, "left").withColumns({"__n": F.row_number().over(w), "__prev": F.lag(changed_by).over(w)})
    before = F.when(F.col("__n") == 1, F.col("__old")).otherwise(F.col("__prev"))
    action = F.when((F.col("__n") == 1) & F.col("__had").isNull(), INSERTED).when(before.eqNullSafe(F.col(changed_by)), UNCHANGED).otherwise(UPDATED)
    return d.select(*key, order, action.alias("action"))


def detect_deletions(stored: DataFrame, touched: DataFrame, finished_labels: list[str] | None = None, errors: int = 0, full: bool = True) -> DataFrame:
    """Rows that a full sync without errors did not touch, within the labels whose source was read to its end."""
    if errors or not full:
        return stored.limit(0)
    d = stored.filter(F.col("label").isin(finished_labels)) if finished_labels is not None else stored
    return d.join(touched.select("qname").distinct(), "qname", "left_anti")


def _named(rows: DataFrame, gone: DataFrame) -> list[str]:
    """The columns by which rows go: with the org, where both have one."""
    return [c for c in ("org_id",) if c in rows.columns and c in gone.columns]


def delete_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    key = [*_named(nodes, gone), "qname"]
    return nodes.join(gone.select(*key).distinct(), key, "left_anti").select(nodes.columns)


def delete_edges_for(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the edges that touch a node that goes, at either end."""
    org = _named(edges, gone)
    q = gone.select(*org, "qname").distinct()
    for end in ("src", "dst"):
        edges = edges.join(q.withColumnRenamed("qname", end), [*org, end], "left_anti").select(edges.columns)
    return edges


def _latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: what was seen last (ties: the largest content), with the first and last time any of them was seen."""
    times = [c for c in ("first_seen_at", "last_seen_at") if c in rows.columns]
    rest = [c for c in rows.columns if c not in (*key, *times)]
    if not rest and not times:
        return rows.dropDuplicates(key)
    order = F.struct(*[F.col(c) for c in ("last_seen_at",) if c in times], *rest)
    out = rows.groupBy(*key).agg(F.max(order).alias("o"), *[(F.min if c == "first_seen_at" else F.max)(c).alias(f"__{c}") for c in times])
    return out.select(*key, *[F.col(f"o.{c}").alias(c) for c in rest], *[F.col(f"__{c}").alias(c) for c in times]).select(rows.columns)


def renamed(rows: DataFrame, renames: DataFrame, names: tuple[str, ...], key: list[str]) -> DataFrame:
    """rows with these columns renamed (renames: old, new; each old name once), all at once: chains and swaps of one batch each move a step.

    Where two rows meet under one key they become one.
    """
    out = rows
    for c in names:
        out = out.join(renames.select(F.col("old").alias(c), F.col("new").alias("__new")), c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return _latest(out.select(rows.columns), key)


def rename_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """edges with both ends renamed (renames: old, new), and each edge once."""
    return renamed(edges, renames, ("src", "dst"), [c for c in ("org_id", "rel_type", "src", "dst") if c in edges.columns])


def rename_nodes(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """nodes under their new names, seen first when they were; one that takes another's name becomes one with it."""
    return renamed(nodes, renames, ("qname",), [c for c in ("org_id", "qname") if c in nodes.columns])


def record_service_ids(known: DataFrame, seen: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """known after seeing (org_id, service_id, qname, label; each id once), and the renames that shows: old, new. A name that several ids leave for different ones goes to the first of these."""
    key = ["org_id", "service_id"]
    d = known.select(*key, F.struct("qname", "label", "first_seen_at", "last_seen_at").alias("o")).join(seen.select(*key, F.struct("qname", "label").alias("s")), key, "full_outer")
    renames = d.filter("o.qname <> s.qname").groupBy("org_id", F.col("o.qname").alias("old")).agg(F.min("s.qname").alias("new"))
    after = d.select(*key, F.coalesce("s.qname", "o.qname").alias("qname"), F.coalesce("s.label", "o.label").alias("label"), F.coalesce(F.col("o.first_seen_at"), F.lit(now)).cast("long").alias("first_seen_at"), F.when(F.col("s").isNotNull(), F.lit(now)).otherwise(F.col("o.last_seen_at")).cast("long").alias("last_seen_at"))
    return after, renames


def merge_snippets(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """By hash; a changed text loses its explanation."""
    key = ["org_id", "qname"]
    d = stored.select(*key, F.struct(*[c for c in stored.columns if c not in key]).alias("o")).join(facts.select(*key, F.struct(*[c for c in facts.columns if c not in key]).alias("f")), key, "full_outer")
    keep = F.col("f").isNull() | F.col("o.hash").eqNullSafe(F.col("f.hash"))
    pick = lambda c: F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"f.{c}") if c in facts.columns else F.lit(None)).alias(c)
    return d.select(*key, *[pick(c) for c in stored.columns if c not in key]).select(stored.columns)
