import json

import pytest
from pyspark.sql import functions as F

from metaweave import render, schema
from metaweave.operators import audit, diff, filters, merge, resolve, traverse
from metaweave.parse import registry
from metaweave.plans import tools
from metaweave.store import GraphStore

DAY = audit.DAY


def graph(spark, pairs, rel="CALLS"):
    return spark.createDataFrame([(rel, a, b) for a, b in pairs] or [], "rel_type string, src string, dst string")


def names(df):
    return sorted(r[0] for r in df.select("qname").collect())


def test_traversal(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")])
    assert names(traverse.trace(e, "b", False, 1).nodes) == ["c"]
    assert names(traverse.trace(e, "a", False, 5).nodes) == ["b", "c", "d", "e", "f"]
    assert names(traverse.trace(e, "none", False, 3).nodes) == []
    with pytest.raises(ValueError):
        traverse.trace(e, "a", False, 6)
    hub = graph(spark, [(f"n{i:03}", "hub") for i in range(60)])
    assert not traverse.trace(hub, "hub", True, 2, cap=100).truncated
    cut = traverse.trace(hub, "hub", True, 2, cap=20)
    assert cut.truncated and cut.nodes.count() == 19
    flow = traverse.typed_flow(e, "x", ["CALLS"])
    assert names(flow.nodes) == ["x"] and not flow.truncated


def test_merge(spark):
    stored = spark.createDataFrame([("o", "a", "h1", 1, 1, 1), ("o", "b", "h1", 1, 1, 1)], "org_id string, qname string, source_hash string, first_seen_at long, last_seen_at long, last_modified_at long")
    facts = spark.createDataFrame([("o", "a", "h1", 0), ("o", "b", "h2", 1), ("o", "c", "h1", 2), ("o", "c", "h1", 3), ("o", "c", "h9", 4)], "org_id string, qname string, source_hash string, n int")
    key = ["org_id", "qname"]
    found = sorted((r.qname, r.action) for r in merge.batch_actions(stored, facts, key, "n").collect())
    assert found == [("a", "unchanged"), ("b", "updated"), ("c", "inserted"), ("c", "unchanged"), ("c", "updated")]
    out = {r.qname: r for r in merge.merge(stored, merge.last_of_each(facts, key, "n").drop("n"), key, 9).collect()}
    assert (out["a"].last_modified_at, out["a"].last_seen_at, out["b"].last_modified_at, out["b"].first_seen_at, out["c"].source_hash) == (1, 9, 9, 1, "h9")
    again = merge.merge(stored, stored.select(*key, "source_hash"), key, 9)
    assert diff.diff_nodes(stored.withColumn("label", F.lit("x")), again.withColumn("label", F.lit("x"))).isEmpty()


def test_renames_and_deletions(spark):
    e = graph(spark, [("a", "b"), ("c", "b")])
    r = spark.createDataFrame([("b", "z"), ("a", "y"), ("c", "y")], "old string, new string")
    assert [tuple(x) for x in merge.rename_edges(e, r).collect()] == [("CALLS", "y", "z")]
    known = spark.createDataFrame([("o", "1", "a", "L", 1, 1)], schema.SERVICE_IDS)
    after, renames = merge.record_service_ids(known, spark.createDataFrame([("o", "1", "b", "L"), ("o", "2", "c", "L")], "org_id string, service_id string, qname string, label string"), 5)
    assert after.count() == 2 and [tuple(x) for x in renames.collect()] == [("o", "a", "b")]
    n = spark.createDataFrame([("a", "X"), ("b", "Y")], "qname string, label string")
    touched = spark.createDataFrame([], "qname string")
    assert names(merge.detect_deletions(n, touched, ["X"])) == ["a"]
    assert merge.detect_deletions(n, touched, errors=1).isEmpty()


def test_resolvers(spark):
    m = spark.createDataFrame([("ApexMethod:A.f(1)", "{}"), ("ApexMethod:A.f(2)", "{}"), ("ApexMethod:A.g(0)", '{"isInvocable": true}')], "qname string, attributes string")
    e = graph(spark, [("x", "ApexMethod:A.f(?)"), ("x", "ApexMethod:A.g(?)"), ("x", "ApexMethod:B.h(?)")])
    r = resolve.resolve_arity(e, m)
    how = F.get_json_object("attributes", "$.ambiguous").alias("ambiguous")
    assert sorted((x.dst, x.ambiguous) for x in r.edges.select("dst", how).collect() if x.ambiguous) == [("ApexMethod:A.f(1)", "true"), ("ApexMethod:A.f(2)", "true"), ("ApexMethod:A.g(0)", "false")]
    assert tuple(r.counters.first()) == (3, 2, 1, 1, 3)
    f = graph(spark, [("Flow:F", "ApexClass:A"), ("Flow:F", "ApexClass:Q")], "FLOW_INVOKES_APEX")
    r = resolve.resolve_invocable(f, m)
    assert r.edges.first().dst == "ApexMethod:A.g(0)" and tuple(r.counters.first()) == (2, 1, 0, 1)
    two = resolve.resolve_invocable(f, m.union(spark.createDataFrame([("ApexMethod:A.h(1)", '{"isInvocable": true}'), ("ApexMethod:Q.x(?)", '{"isInvocable": true}')], m.schema)))
    assert {(x.dst, x.rel_type, x.ambiguous) for x in two.edges.collect()} == {("ApexMethod:A.g(0)", "FLOW_INVOKES_APEX_METHOD", True), ("ApexMethod:A.h(1)", "FLOW_INVOKES_APEX_METHOD", True)} and tuple(two.counters.first()) == (2, 1, 1, 1)
    n = spark.createDataFrame([("A", "A:Name1", '{"deep": [{"k": "name2"}]}'), ("B", "B:Name2", "{}"), ("C", "C:name2", '{"self": "name2", "s": "two words", "t": "true"}')], "label string, qname string, attributes string")
    r = resolve.infer_references(n)
    assert [(x.src, x.dst, x.via_key) for x in r.edges.collect()] == [("A:Name1", "C:name2", "k")]
    assert resolve.infer_references(n.union(spark.createDataFrame([("D", "D:name2", "{}")], n.schema)), per_source=1).counters.first().truncated_sources == 1


def test_diff_text(spark):
    assert filters.glob_to_regex("A?c*[0-9]{x,y}.z") == r"^A[^/]c[^/]*[0-9](?:x|y)\.z$"
    m = diff.manifest_members(spark.createDataFrame([("LightningComponentBundle:b", "LightningComponentBundle", "only_in_a"), ("LightningComponentBundle:a<", "LightningComponentBundle", "changed"), ("Flow:f", "Flow", "only_in_b"), ("ApexMethod:m", "ApexMethod", "changed")], "qname string, label string, side string"))
    text = diff.manifest_xml(m, False)
    assert text.index("a&lt;") < text.index("<members>b<") and "LightningComponentBundle" in text and "59.0" in text and "Flow" not in text
    assert "<members>f<" in diff.manifest_xml(m, True)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = GraphStore(spark, "file://" + str(tmp_path_factory.mktemp("store")))
    s.upsert_org("org1", "dev", "https://x", "60.0", 5)
    source = "public class A { public void f() { B.g(1); for (X x : xs) { update x; } } }"
    members = [("org1", "ApexClass", "A", "a.cls", None, source), ("org1", "ApexClass", "B", "b.cls", None, "public class B { public static void g(Integer i) { } }"), ("org1", "ApexClass", "T", "t.cls", None, "@IsTest class T { @IsTest static void t() { B.g(1); } }"), ("org1", "Flow", "Bad", "f.xml", None, "<Flow")]
    facts = registry.parse_members(spark.createDataFrame(members, "org_id string, member_type string, member_name string, source_uri string, namespace string, content string"))
    assert s.merge_nodes(registry.nodes_of(facts).withColumn("last_modified_at", F.lit(1).cast("long")), 10)["inserted"] == 7
    s.merge_edges(registry.edges_of(facts).dropDuplicates(["rel_type", "src", "dst"]), 10)
    s.merge_snippets(registry.snippets_of(facts))
    return s


def test_store(store, spark):
    assert store.read("nodes").count() == 7 and store.read("snippets").count() == 3
    store.upsert_org("org1", "dev2", "https://y", "61.0", 99)
    store.touch_sync("org1", "2024-01-02T00:00:00Z")
    row = store.read("orgs").first()
    assert (row.alias, row.created_at, row.last_synced_at) == ("dev2", 5, 1704153600000)
    with pytest.raises(ValueError):
        store.touch_sync("org1", "yesterday")
    one = store.create_snapshot("org1", "one", True, 1 * DAY)
    store.create_snapshot("org1", "two", False, 1 * DAY)
    assert diff.diff_nodes(store.snapshot(one), store.snapshot("current")).isEmpty()
    with pytest.raises(ValueError):
        store.snapshot("none")
    assert store.prune("org1", 7, 100 * DAY) == 1
    assert [r.label for r in store.snapshots("org1").collect()] == ["two"]


def test_tools(store, spark):
    call = lambda tool, /, **x: tools.dispatch(tool, store, **x)
    assert len(tools.TOOLS) == 28
    assert call("ping", now=7).data["ts"] == 7
    assert names(call("trace_upstream", org="org1", qname="ApexMethod:B.g(1)").data["nodes"]) == ["ApexClass:A", "ApexClass:B", "ApexClass:T", "ApexMethod:A.f(0)", "ApexMethod:T.t(0)"]
    assert "flowchart" in call("trace_downstream", org="org1", qname="ApexClass:A").markdown
    snap = call("snapshot_create", org="org1", name="base", kind="auto", now=3).data["id"]
    assert call("what_broke", org="org1").summary == "no changes"
    changed = store.read("nodes").filter("qname = 'ApexMethod:B.g(1)'").select("org_id", "label", "qname", "attributes", F.lit("new").alias("source_hash"))
    store.merge_nodes(changed, 20)
    r = call("what_broke", org="org1", since=snap)
    assert {x.qname: x.risk for x in r.data["risks"].collect()} == {"ApexClass:A": "at_risk", "ApexClass:B": "covered", "ApexMethod:A.f(0)": "at_risk", "ApexMethod:T.t(0)": "at_risk"}
    assert call("point_in_time_diff", org="org1", before=snap).data["nodes"].count() == 1
    d = "--- a/x/classes/B.cls\n+++ b/x/classes/B.cls\n"
    assert call("impact_from_git_diff", org="org1", diff_text=d).data["seeds"].count() == 1
    assert call("test_gap_intelligence_from_git_diff", org="org1", diff_text=d).data["covered"].count() == 1
    assert not call("dead_code_audit", org="org1", now=2000 * DAY).data["cached"]
    store.populate_analysis("org1", 2000 * DAY)
    r = call("dead_code_audit", org="org1")
    assert r.data["cached"] and {x.qname: x.confidence for x in r.data["dead"].collect()}["ApexClass:A"] == "high"
    assert {x.risk_type for x in call("governor_risk_check", org="org1").data["risks"].collect()} == {"dml_in_loop"}
    doc = call("export_sarif", org="org1", now=2000 * DAY)
    n = doc.data["findings"].count()
    assert not doc.data["truncated"] and len(doc.data["sarif"]["runs"][0]["results"]) == n > 1
    cut = render.sarif(doc.data["findings"], cap=n - 1)["runs"][0]
    assert cut["properties"] == {"truncated": True} and len(cut["results"]) == n - 1
    assert doc.data["lint"] == [] and json.loads(render.to_json(doc.data["sarif"]))["version"] == "2.1.0"
    assert "rule" in render.lint_sarif({"version": "2.1.0", "runs": [{"results": [{"ruleId": "x", "level": "note", "message": {"text": "t"}}]}]})[0]
    assert call("find_nodes", org="org1", pattern="ApexClass:*").data["total"] == 3
    assert call("explain_code", org="org1", qname="ApexMethod:A.f(0)", annotation="why").data["explanation"] == "why"
    assert call("explain_code", org="org1", qname="ApexMethod:A.f(0)").data["explanation"] == "why"
    assert call("staleness_check", org="org1", now=1704153600000 + 8 * DAY).data == {"days": 8, "stale": True}
    assert call("list_orgs", known=["other"], default="org1").data["orgs"].count() == 2
    assert call("cross_org_diff", org_a="org1", org_b="org2").data["diff"].count() == 7
    assert "<members>" in call("deployment_manifest_gen", org_from="org1", org_to="org2").data["package"]
    assert call("cross_layer_flow_map", org="org1", entry="nothing").data["participants"] == ["nothing"]
    assert call("freshness_report", org="org1", now=2000 * DAY, bucket="dead").data["rows"].count() == 5
    for bad in (lambda: call("nothing"), lambda: call("ping", odd=1), lambda: call("find_similar", org="org1", qname="a", text="b"), lambda: call("trace_upstream", org="../x", qname="a"), lambda: call("get_ingest_job", job_id="j")):
        with pytest.raises(tools.ToolError):
            bad()


def test_project(store, spark, tmp_path):
    base = tmp_path / "force-app/main/default"
    for path, text in {"classes/B.cls": "public class B { public static void g(Integer i) { Integer j = i; } }", "lwc/tile/tile.js": "export default 1;", "lwc/tile/tile.html": "<template></template>", "objects/Acc/Acc.object-meta.xml": "<CustomObject><label>Acc</label></CustomObject>", "objects/Acc/fields/F__c.field-meta.xml": "<CustomField><fullName>F__c</fullName></CustomField>", "permissionsets/P.permissionset-meta.xml": "<PermissionSet/>"}.items():
        f = base / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "sfdx-project.json").write_text('{"packageDirectories": [{"path": "force-app"}]}')
    r = tools.dispatch("wip_impact", store, org="org1", project_root=f"file://{tmp_path}")
    changes = {x.qname: x.change for x in r.data["changes"].collect()}
    assert changes["ApexClass:B"] == "changed" and changes["CustomField:Acc.F__c"] == "added" and changes["LWC:tile"] == "added"
    assert "ApexMethod:A.f(0)" in names(r.data["dependents"])
    assert tools.dispatch("wip_test_gap", store, org="org1", project_root=f"file://{tmp_path}").data["uncovered"].count() > 0
