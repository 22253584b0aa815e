"""Members out of rows: nulls, repeats, what has no partner, empty tables."""

import json

from metaweave.parse import registry
from metaweave.sources import assemble


def test_components(spark):
    b = spark.createDataFrame([(1, "a", None, 5), (2, "b", "pack", 6), (3, "c", "", None), (4, "d", None, 1)], "id int, name string, namespace string, last_modified_at long")
    r = spark.createDataFrame([(1, "a/a.js", "x"), (1, "a/a.js", "y"), (1, "a/a.html", None), (1, None, "z"), (2, "b/b.js", "hidden"), (9, "n.js", "nobody's"), (4, "d.js", "d")], "bundle_id int, path string, source string")
    made = {m.member_name: m for m in assemble.component_members(b, r, skip=["d"]).collect()}
    content = {k: json.loads(m.content) for k, m in made.items()}
    assert content["a"] == {"bundleName": "a", "files": {"a/a.html": "", "a/a.js": "y"}}
    assert content["b"] == {"bundleName": "b", "files": {}, "managed": True} and made["b"].namespace == "pack"
    assert content["c"] == {"bundleName": "c", "files": {}} and "d" not in made
    shown = {m.member_name: json.loads(m.content) for m in assemble.component_members(b, r, managed=True).collect()}
    assert shown["b"]["files"] == {"b/b.js": "hidden"}
    assert assemble.component_members(b.limit(0), r).count() == 0
    assert [json.loads(m.content)["files"] for m in assemble.component_members(b, r.limit(0)).collect()] == [{}] * 4


def test_objects(spark):
    o = spark.createDataFrame([("A__c",), ("A__c",), ("B__c",), ("C__c",)], "name string")
    d = spark.createDataFrame([("A__c", "Ä & <b>"), ("C__c", None)], "object string, label string")
    f = spark.createDataFrame([("A__c", "X__c", False, ["B__c", "C__c"]), ("A__c", "X__c", False, ["B__c", "C__c"]), ("A__c", None, True, None), ("A__c", "Y__c", None, None)], "object string, name string, nullable boolean, reference_to array<string>")
    made = assemble.object_members(o, d, f)
    assert sorted(m.member_name for m in made.collect()) == ["A__c", "C__c"]
    from pyspark.sql import functions as F

    facts = registry.parse_members(made.withColumn("org_id", F.lit("org1")), kinds=["CustomObject"])
    nodes = {n.qname: json.loads(n.attributes) for n in registry.nodes_of(facts).collect()}
    assert nodes["CustomObject:A__c"]["label"] == "Ä & <b>" and nodes["CustomObject:C__c"]["label"] == "C__c"
    assert nodes["CustomField:A__c.X__c"]["required"] is True and nodes["CustomField:A__c.Y__c"]["required"] is False
    assert len([q for q in nodes if q.startswith("CustomField")]) == 2
    assert sorted(e.dst for e in registry.edges_of(facts).filter("rel_type = 'REFERENCES_OBJECT'").collect()) == ["CustomObject:B__c", "CustomObject:C__c"]


def test_processes(spark):
    p = spark.createDataFrame([("OmniProcess", "1", "One", "shown"), ("OmniProcess", "2", None, None), ("OmniUiCard", "3", "Three", None)], "member_type string, id string, name string, developer_name string")
    e = spark.createDataFrame([("1", "b", "T2", None, "not json"), ("1", "a", None, "n", '{"x": [1, null]}'), ("1", "c", "T3", "m", ""), ("3", "d", "T", "o", "{}"), (None, "e", "T", "p", "{}")], "process_id string, id string, type string, name string, property_set string")
    made = {m.member_name: json.loads(m.content) for m in assemble.process_members(p, e).collect()}
    assert set(made) == {"shown", "2", "Three"}
    assert made["shown"]["elements"] == [{"Type": "", "propertySet": {"x": [1, None]}, "name": "n"}, {"Type": "T2", "propertySet": {"_raw": "not json"}}, {"Type": "T3", "propertySet": {}, "name": "m"}]
    assert "elements" not in made["2"] and "elements" not in made["Three"]


def test_routes(spark):
    d = spark.createDataFrame([("ApexClass",), ("OmniScript",), ("Profile",), ("Profile",), ("",), (None,)], "name string")
    assert {r.name: r.strategy for r in assemble.routes(d).collect()} == {"ApexClass": "query", "OmniScript": "list_read", "Profile": "list_read"}
    assert {r.name: r.strategy for r in assemble.routes(d, True).collect()} == {"ApexClass": "query", "Profile": "list_read"} | dict.fromkeys(assemble.PACK_TYPES, "registry")
