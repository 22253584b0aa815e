"""Members from tables: what an org's interfaces return, as DataFrames, made into members and baseline edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import skip_category

#: Suffixes of companion objects, which aren't read. Fixed values.
COMPANIONS = ["__Share", "__History", "__Feed", "__ChangeEvent", "__Tag", "__ViewStat", "__VoteStat", "History", "Share", "Feed", "ChangeEvent"]


def include_objects(objects: DataFrame, denied: DataFrame | None = None, whitelist: DataFrame | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """objects: name, custom, queryable. Those worth a look: no companions and archives, nothing denied; custom ones of no or a wanted namespace; of the others entities that can be queried, or what the whitelist names."""
    name = F.col("name")
    d = objects
    for suffix in COMPANIONS:
        d = d.filter(~name.endswith(suffix) | (F.length(name) == len(suffix)))
    d = d.filter(~name.endswith("__b"))
    if denied is not None:
        d = d.join(denied.select("name"), "name", "left_anti")
    own = F.regexp_extract(name, r"^(\w+?)__\w+__[a-z]$", 1)
    d = d.filter(~F.col("custom") | (own == "") | own.isin(namespaces or []))
    if whitelist is None:
        return d.filter(F.col("custom") | F.col("queryable"))
    listed = whitelist.select("name", F.lit(True).alias("listed"))
    return d.join(listed, "name", "left").filter(F.col("custom") | F.col("queryable") | F.coalesce("listed", F.lit(False))).drop("listed")


def normalize_rows(rows: DataFrame, namespace: str, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Columns without `namespace__` and `__c` or `__r`; JSON columns that can't be read as JSON become `{"_raw": text}`."""
    names = {}
    for c in rows.columns:
        new = c.removeprefix(f"{namespace}__")
        for suffix in ("__c", "__r"):
            new = new.removesuffix(suffix)
        names[c] = new
    d = rows.withColumnsRenamed(names)
    for c in json_columns:
        d = d.withColumn(c, F.when(F.try_parse_json(F.col(c)).isNotNull(), F.col(c)).when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("_raw")))))
    return d


def attach_children(parents: DataFrame, children: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """parents with an array of their children's rows as JSON, in their order column `seq`; the children are grouped before the join."""
    lists = children.groupBy(F.col(parent_key).alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*[c for c in children.columns if c not in (parent_key,)])).alias("j")))), lambda x: x["j"]).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def expand_templates(entries: DataFrame, namespaces: list[str]) -> DataFrame:
    """A registry's query templates for each namespace: `%ns%` is replaced. Both are configuration, some dozens of rows."""
    ns = F.explode(F.array(*[F.lit(n) for n in namespaces]))
    return entries.withColumn("namespace", ns).withColumn("query", F.replace("template", F.lit("%ns%"), F.col("namespace"))).drop("template")


def applicable(entries: list[dict], caps: dict) -> list[dict]:
    """Registry entries whose condition holds for what the org can do."""
    from ..parse.rules import applies

    return [e for e in entries if applies(e.get("applies_when"), caps)]


def baseline_edges(dependencies: DataFrame, types: list[str] | None = None, namespace: str | None = None) -> DataFrame:
    """Rows of a dependency table (component_ and ref_ with type, name, and where there are such, id and namespace) as REFERENCES edges, each pair once.

    An edge is dynamic if either side's name is its id: then an id stands in the source in place of a name.
    """
    d = dependencies
    if types:
        d = d.filter(F.col("component_type").isin(types) | F.col("ref_type").isin(types))
    has = lambda c: c in dependencies.columns

    def side(p: str) -> Column:
        """The name without the prefix of its own namespace, or else of the org's."""
        name, own = F.coalesce(F.col(f"{p}_name"), F.lit("")), F.lit(namespace or "")
        if has(f"{p}_namespace"):
            own = F.coalesce(F.nullif(F.col(f"{p}_namespace"), F.lit("")), own)
        prefix = F.concat(own, F.lit("__"))
        bare = F.when((own != "") & name.startswith(prefix), F.substring(name, F.length(prefix) + 1, F.length(name))).otherwise(name)
        return F.concat(F.col(f"{p}_type"), F.lit(":"), bare)

    literal = F.lit(False)
    for p in ("component", "ref"):
        literal = literal | (F.coalesce(F.col(f"{p}_id") == F.col(f"{p}_name"), F.lit(False)) if has(f"{p}_id") else F.lit(False))
    d = d.select(side("component").alias("src"), side("ref").alias("dst"), literal.alias("dynamic"), F.col("component_type").alias("a"), F.col("ref_type").alias("b"))
    one = d.groupBy("src", "dst").agg(F.max("dynamic").alias("dynamic"), F.min("a").alias("a"), F.min("b").alias("b"))
    attributes = F.to_json(F.struct(F.lit("mcd").alias("source"), F.col("a").alias("mcdSrcType"), F.col("b").alias("mcdDstType"), F.when(F.col("dynamic"), True).alias("dynamic")))
    return one.select(F.lit("REFERENCES").alias("rel_type"), "src", "dst", attributes.alias("attributes"))


def baseline_counts(dependencies: DataFrame, types: list[str] | None = None) -> DataFrame:
    """member_type and how many rows of a dependency table have it as their source and as their target."""
    side = lambda p: dependencies.select(F.col(f"{p}_type").alias("member_type"), F.lit(p).alias("p"))
    d = side("component").union(side("ref"))
    d = d.filter(F.col("member_type").isin(types)) if types else d
    return d.groupBy("member_type").agg(F.count_if(F.col("p") == "component").alias("as_source"), F.count_if(F.col("p") == "ref").alias("as_target"))


def managed_stub(body: Column, namespace: Column, own: str | None) -> Column:
    """Source of other namespaces isn't shown: it counts as empty."""
    return F.when(namespace.isNull() | (namespace == F.lit(own)), body).otherwise(F.lit(""))


def read_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], only: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """All sources' members together, and a report of those that failed: name, message, category. A failure ends no other source."""
    out, failed = None, []
    for name, make in sources.items():
        if only and name not in only:
            continue
        try:
            d = make()
            d.schema  # resolves the plan
        except Exception as error:
            failed.append((name, str(error)))
            continue
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    report = spark.createDataFrame(failed, "source string, message string").withColumn("category", skip_category(F.col("message")))
    return out, report


def skip_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source")).alias("sources"))
