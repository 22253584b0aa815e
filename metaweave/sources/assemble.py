"""Members out of an org's rows: components with their resources, objects with their descriptions, processes with their elements; and which way each type is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MEMBERS

#: Types read by queries for code, and types of packs that only orgs with the older namespace have. Fixed values.
CODE_TYPES = ["ApexClass", "ApexTrigger", "ApexPage", "ApexComponent", "AuraDefinitionBundle", "LightningComponentBundle", "StaticResource"]
PACK_TYPES = ["DataRaptor", "IntegrationProcedure", "OmniScript", "VlocityCard"]
#: Types whose rows have elements in another table. Fixed values.
WITH_ELEMENTS = ["OmniProcess"]


def _text(name: str, d: DataFrame, kind: str = "string") -> Column:
    return (F.col(name) if name in d.columns else F.lit(None)).cast(kind)


def _member(category: Column, kind: Column, name: Column, at: Column, uri: Column, namespace: Column, content: Column) -> list[Column]:
    values = [category, kind, name, at, uri, F.lit(False), namespace, content]
    return [v.cast(f.dataType).alias(f.name) for v, f in zip(values, MEMBERS)]


def described_types(described: DataFrame) -> DataFrame:
    """Rows of a description of types (name, and what else there is), each name once and none empty."""
    return described.filter(F.coalesce("name", F.lit("")) != "").dropDuplicates(["name"])


def routes(types: DataFrame, legacy_packs: bool = False) -> DataFrame:
    """name and strategy: `registry` for packs of an org with the older namespace (these are there even if no description names them), `query` for code, `list_read` for the rest."""
    name = F.col("name")
    by_type = F.when(F.lit(legacy_packs) & name.isin(PACK_TYPES), "registry").when(name.isin(CODE_TYPES), "query").otherwise("list_read")
    d = described_types(types).select("name")
    if legacy_packs:
        d = d.unionByName(types.sparkSession.createDataFrame([(p,) for p in PACK_TYPES], "name string")).distinct()
    return d.select("name", by_type.alias("strategy"))


def component_members(bundles: DataFrame, resources: DataFrame, managed: bool = False, skip: list[str] | None = None) -> DataFrame:
    """bundles: id, name, namespace, last_modified_at; resources: bundle_id, path, source. A member for each bundle, its files as JSON by path.

    Bundles of a namespace get no files (their source isn't shown), unless managed says so. A bundle without resources stays, without files; a null
    source is an empty file; of several rows of a path the largest source stays. Resources of unknown bundles, and bundles that skip names, go.
    Both sides meet by bundle id in one shuffle each; a bundle is one member, and so one row.
    """
    b = bundles.filter(~F.col("name").isin(skip)) if skip else bundles
    hidden = (F.coalesce("namespace", F.lit("")) != "") & F.lit(not managed)
    shown = resources.select(F.col("bundle_id").alias("id"), "path", F.coalesce("source", F.lit("")).alias("source")).filter("path IS NOT NULL")
    files = shown.groupBy("id", "path").agg(F.max("source").alias("source")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "source")))).alias("files"))
    d = b.withColumn("hidden", hidden).join(files, "id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    listed = F.when(F.col("hidden") | F.col("files").isNull(), none).otherwise(F.col("files"))
    content = F.to_json(F.struct(F.col("name").alias("bundleName"), listed.alias("files"), F.when(F.col("hidden"), True).alias("managed")))
    kind = F.lit("LightningComponentBundle")
    return d.select(*_member(F.lit("lwc"), kind, F.col("name"), F.col("last_modified_at"), F.concat(F.lit("tooling/LightningComponentBundle/"), F.col("name")), F.col("namespace"), content))


#: What a field's element has, in order: its name there, the column, the type. Fixed values.
FIELD_PARTS = [
    ("fullName", "name", "string"), ("label", "label", "string"), ("type", "type", "string"), ("length", "length", "int"), ("precision", "precision", "int"),
    ("scale", "scale", "int"), ("unique", "unique", "boolean"), ("externalId", "external_id", "boolean"), ("required", "required", "boolean"), ("custom", "custom", "boolean"),
    ("referenceTo", "reference_to", "array<string>"), ("relationshipName", "relationship_name", "string"), ("formula", "formula", "string"), ("description", "help", "string"),
]


def object_members(objects: DataFrame, descriptions: DataFrame, fields: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """objects: name (those that members.include_objects leaves), with label and custom_setting if there; descriptions: object, with label, plural_label,
    sharing_model, replicateable, description if there; fields: object, ordinal, name, and what FIELD_PARTS says if there (nullable in place of required).

    A member for each object with a description, as the XML that the parser of objects reads, fields in order of ordinal and name. Objects whose description
    failed have no row in descriptions and go; repeated rows of an object or a field count once; fields without a name go.
    """
    o = objects.filter(~F.col("name").isin(skip)) if skip else objects
    o = o.select(F.col("name").alias("object"), _text("label", o).alias("own_label"), F.coalesce(_text("custom_setting", o, "boolean"), F.lit(False)).alias("setting")).dropDuplicates(["object"])
    x = descriptions
    x = x.select("object", _text("label", x).alias("label"), _text("plural_label", x).alias("plural"), _text("sharing_model", x).alias("sharing"), F.coalesce(_text("replicateable", x, "boolean"), F.lit(False)).alias("history"), _text("description", x).alias("text")).dropDuplicates(["object"])
    f = fields.filter("name IS NOT NULL")
    given = {"label": F.coalesce(_text("label", f), F.col("name")), "type": F.coalesce(_text("type", f), F.lit("Text"))}
    if "nullable" in f.columns:
        given["required"] = ~F.coalesce("nullable", F.lit(True))
    element = F.struct(*[given.get(c, _text(c, f, kind)).cast(kind).alias(n) for n, c, kind in FIELD_PARTS])
    one = f.select("object", F.coalesce(_text("ordinal", f, "long"), F.lit(0)).alias("ordinal"), "name", element.alias("field")).dropDuplicates(["object", "name"])
    lists = one.groupBy("object").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "field"))), lambda e: e["field"]).alias("fields"))
    d = o.join(x, "object").join(lists, "object", "left")
    body = F.struct(
        F.col("object").alias("fullName"), F.coalesce("label", "own_label", "object").alias("label"), F.col("plural").alias("pluralLabel"), F.col("sharing").alias("sharingModel"),
        F.when(F.col("setting"), "List").alias("customSettingsType"), F.col("history").alias("enableHistory"), F.col("text").alias("description"), F.col("fields"),
    )
    content = F.to_xml(body, {"rowTag": "CustomObject"})
    return d.select(*_member(F.lit("object"), F.lit("CustomObject"), F.col("object"), F.lit(None), F.concat(F.lit("describe/"), F.col("object")), F.lit(None), content))


def process_members(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """rows: member_type, id, and developer_name, name, last_modified_at if there; elements: process_id, id, type, name, property_set (text of JSON).

    A member for each row: the row as JSON, and for types that have elements (WITH_ELEMENTS) these with it, in order of id. A property set that isn't JSON is
    `{"_raw": text}`, an empty or null one `{}`. Named by developer_name, else name, else id. Elements are grouped before they meet their process.
    """
    text = F.col("property_set")
    raw = F.parse_json(F.to_json(F.struct(text.alias("_raw"))))
    tree = F.when(F.coalesce(text, F.lit("")) == "", F.parse_json(F.lit("{}"))).otherwise(F.coalesce(F.try_parse_json(text), raw))
    e = elements.filter("process_id IS NOT NULL").select(F.col("process_id").alias("id"), F.col("id").alias("at"), F.to_json(F.struct(F.coalesce("type", F.lit("")).alias("Type"), tree.alias("propertySet"), F.col("name"))).alias("element"))
    lists = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "element"))), lambda x: x["element"]).alias("elements"))
    name = F.coalesce(_text("developer_name", rows), _text("name", rows), F.col("id").cast("string"))
    own = F.to_json(F.struct(*[c for c in rows.columns if c != "member_type"]))
    d = rows.withColumns({"__own": own, "__name": name}).select("member_type", "id", "__own", "__name", _text("last_modified_at", rows, "long").alias("__at")).join(lists, "id", "left")
    more = F.concat(F.expr("left(__own, length(__own) - 1)"), F.lit(',"elements":['), F.array_join("elements", ","), F.lit("]}"))
    content = F.when(F.col("member_type").isin(WITH_ELEMENTS) & F.col("elements").isNotNull(), more).otherwise(F.col("__own"))
    return d.select(*_member(F.lit("omni"), F.col("member_type"), F.col("__name"), F.col("__at"), F.concat(F.lit("omnistudio/"), F.col("member_type"), F.lit("/"), F.col("__name")), F.lit(None), content))
