import json

import pytest

from metaweave.functions.governor import scan_source
from metaweave.parse import registry
from metaweave.parse.base import Context, field_refs, parse_xml
from metaweave.parse.rules import load_yaml
from metaweave.parse.selectors import Expression

C = Context()


def edges(kind, name, content, context=C):
    return {(r, s, d) for r, s, d, _ in registry.parse_member(kind, name, content, context).edges}


MEMBERS = "org_id string, member_type string, member_name string, source_uri string, namespace string, content string"


def facts_of(spark, members, namespace=None):
    """Facts of members (type, name, content), each as kind, type, qname, dst and attributes."""
    d = spark.createDataFrame([("o", *m[:2], "u", namespace, m[2]) for m in members], MEMBERS)
    return [(r.kind, r.type, r.qname, r.dst, json.loads(r.attributes)) for r in registry.parse_members(d, kinds=[m[0] for m in members]).collect()]


def planned_edges(spark, kind, name, content, namespace=None):
    return {f[1:4] for f in facts_of(spark, [(kind, name, content)], namespace) if f[0] == "edge"}


@pytest.fixture
def thing():
    """A type Thing whose node has an attribute for each template."""

    def make(**props):
        registry.PLANS.pop("Thing", None)
        lines = "".join(f"      {k}: {json.dumps(v)}\n" for k, v in props.items())
        registry.register_rule(load_yaml(f"type: Thing\nroot: Thing\ninput: xml-string\nnodes:\n  - label: Thing\n    qname: 'Thing:${{record.name}}'\n    props:\n{lines}"))

    yield make
    registry.PLANS.pop("Thing", None)


def test_selectors(spark, thing):
    xml = "<Thing><a><b>x</b></a><list><v>1</v><v>2</v></list><list><v>3</v></list><s>ns__Obj.Field</s><f>false</f><t k='q'>2.50</t><deep><in><w>1</w></in><w>a &amp; b</w><w/></deep><e/></Thing>"
    props = {
        "path": ("${record.a.b}", "x"), "none": ("${record.gone.b.c}", None), "flat": ("${record.list.*.v}", [1, 2, 3]), "part": ("${split(record.s, '.')[1]}", "Field"),
        "beyond": ("${split(record.s, '.')[7]}", None), "bool": ("${bool(record.f)}", False), "or": ("${record.none || record.a.b == 'x' && !record.none}", "true"), "both": ("${record.f && record.a.b}", "false"),
        "strip": ("${toString(record.s)}", "Obj.Field"), "raw": ("${toString(record.s) | raw}", "ns__Obj.Field"), "mixed": ("Q:${record.a.b}-${record.none}", "Q:x-"), "all": ("${matchAll('a1b22', '[0-9]+')}", ["1", "22"]),
        "csv": ("${splitCsv(' a, ,b ')}", ["a", "b"]), "number": ("${record.t}", 2.5), "attribute": ("${record.t2.@_k}", None), "walk": ("${walkAll(record.deep, 'w')}", ["1", "a & b"]), "item": ("${record.list.v[1]}", 2),
        "miss": ("${match(record.s, 'zzz')}", ""), "group": ("${match(record.s, 'OBJ.(F)', 'i')}", "F"), "prefix": ("${stripPrefix(record.a.b, 'x')}", ""), "low": ("${lower(record.s)}", "obj.field"), "ns": ("${ns}", "ns"),
        "same": ("${record.a.b == 'x'}", True), "differs": ("${record.a.b != 'y'}", True), "absent": ("${record.none == null}", True), "plain": (7, 7), "stripped": ("${stripNs(record.s)}", "Obj.Field"), "literal": ("${'it'}", "it"), "caps": ("${caps.any}", None), "empty": ("${bool(record.e)}", False),
    }
    thing(**{k: v[0] for k, v in props.items()})
    (_, _, qname, _, got), = facts_of(spark, [("Thing", "t", xml)], "ns")
    assert qname == "Thing:t" and {k: got[k] for k in props} == {k: v[1] for k, v in props.items()}
    for bad in ("nothing(", "unheard(record.a)", "record.a | cooked"):
        with pytest.raises(ValueError):
            Expression(bad)


def test_yaml_rule(spark):
    rule = load_yaml("type: Other\nroot: Other\ninput: xml-string\nnodes:\n  - {label: Other, qname: 'Other:${record.name}', props: {n: '${record.n}'}}\nedges:\n  - {relType: USES, iterate: '${record.use}', when: '${item}', src: 'Other:${record.name}', dst: 'Used:${item}'}\n  - {relType: HAS, iterate: '${record.part}', when: \"${item.kind == 'x'}\", src: 'Other:${record.name}', dst: 'Part:${item.id}'}\n")
    registry.register_rule(rule)
    try:
        xml = "<Other><n>1</n><use>a</use><use>b</use><use/><part><id>p</id><kind>x</kind></part><part><id>q</id></part></Other>"
        other = json.dumps({"n": "y", "use": "one", "part": [{"id": 5, "kind": "x"}, {"id": "r", "kind": ["y", "x"]}]})
        got = facts_of(spark, [("Other", "t", xml), ("Other", "j", other), ("Other", "bad", "<Other><n"), ("Other", "none", ""), ("Other", "root", "<Else><n>1</n></Else>")])
        assert [(f[2], f[4].get("n")) for f in got if f[1] == "Other"] == [("Other:t", 1), ("Other:j", "y"), ("Other:root", None)]
        assert {f[1:4] for f in got if f[0] == "edge"} == {("USES", "Other:t", "Used:a"), ("USES", "Other:t", "Used:b"), ("HAS", "Other:t", "Part:p"), ("USES", "Other:j", "Used:one"), ("HAS", "Other:j", "Part:5")}
        assert {f[2] for f in got if f[1] == "ParseError"} == {"ParseError:Other:bad", "ParseError:Other:none"}
        with pytest.raises(ValueError):
            registry.register_rule(rule)
    finally:
        registry.PLANS.pop("Other")
    with pytest.raises(ValueError):
        load_yaml("type: X\nnope: 1")


def test_rules(spark):
    xml = "<?xml version='1.0'?>\n<!-- x --><Profile xmlns='http://a/b'><fieldPermissions><field>ns__A.F</field><readable>true</readable></fieldPermissions><tabVisibilities><tab>T</tab><visibility>On</visibility></tabVisibilities></Profile>"
    assert planned_edges(spark, "Profile", "P", xml, "ns") == {("GRANTS_FIELD_ACCESS", "Profile:P", "CustomField:A.F"), ("GRANTS_TAB_ACCESS", "Profile:P", "CustomTab:T")}
    page = json.dumps({"body": '<apex:page controller="Ctl" extensions="E1, E2">'})
    assert planned_edges(spark, "ApexPage", "P", page) == {("CONTROLLED_BY", "ApexPage:P", "ApexClass:Ctl"), ("EXTENDS_CONTROLLER", "ApexPage:P", "ApexClass:E1"), ("EXTENDS_CONTROLLER", "ApexPage:P", "ApexClass:E2")}
    layout = "<Layout><layoutSections><layoutColumns><layoutItems><field>F1</field></layoutItems></layoutColumns><layoutColumns><layoutItems><field>F2</field></layoutItems></layoutColumns></layoutSections></Layout>"
    assert planned_edges(spark, "Layout", "Acc-Main", layout) == {("RENDERS_FIELD", "Layout:Acc-Main", "CustomField:Acc.F1"), ("RENDERS_FIELD", "Layout:Acc-Main", "CustomField:Acc.F2")}
    share = "<SharingRules><sharingOwnerRules><fullName>R</fullName><accessLevel>All</accessLevel><sharedTo><roleAndSubordinates>Boss</roleAndSubordinates></sharedTo></sharingOwnerRules></SharingRules>"
    got = facts_of(spark, [("SharingRules", "Acc", share)])
    assert got[0][4]["audit"] is True
    assert ("SHARING_TO_ROLE", "SharingRule:Acc.R", "Role:Boss", True) in {(*f[1:4], f[4].get("includesSubordinates")) for f in got}
    assert planned_edges(spark, "CustomMetadata", "T.R", "<CustomMetadata/>") == {("INSTANCE_OF", "CustomMetadataRecord:T.R", "CustomMetadataType:T")}
    assert facts_of(spark, [("CustomMetadata", "T", "<CustomMetadata><label>l</label></CustomMetadata>")])[0][1:3] == ("CustomMetadataType", "CustomMetadataType:T")


def test_every_declarative_type_stands_what_is_odd(spark):
    """Broken XML and no content give an error node, another root, an empty one and JSON without fields a node or nothing; no type needs a Python worker."""
    odd = ["<{r}", "", None, "<{r}/>", "<Other><label>x</label></Other>", "{{}}", "{{not json", "<{r}><components/><labels/><rules/><columns/></{r}>"]
    members = [(kind, f"n{k}", x if x is None else x.format(r=root)) for kind, (root, _) in registry.PLANS.items() for k, x in enumerate(odd)]
    got = facts_of(spark, members)
    errors = {f[2] for f in got if f[1] == "ParseError"}
    assert errors == {f"ParseError:{kind}:n{k}" for kind in registry.PLANS for k in (0, 1, 2)}
    assert {f[1] for f in got if f[2].endswith(":n3")} >= set(registry.PLANS) - {"CustomLabels", "CustomMetadata", "SharingRules"}
    d = spark.createDataFrame([("o", k, "n", "u", None, "<a/>") for k in registry.PLANS], MEMBERS)
    text = registry.parse_members(d, kinds=list(registry.PLANS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and text.count("from_xml") >= len(registry.PLANS)


def test_apex():
    source = """public class A extends B implements C, D.E {
  // insert x;
  public void one(Map<String, Integer> m, Integer n) {
    List<X> q = [SELECT Id, Name FROM X WHERE Id = :n];
    H.go(f(1, 2), 'a, b');
    insert q;
  }
  @InvocableMethod public static void two() { H.none(); }
}"""
    f = registry.parse_member("ApexClass", "A", source, C)
    assert {n[1] for n in f.nodes} == {"ApexClass:A", "ApexMethod:A.one(2)", "ApexMethod:A.two(0)"}
    e = {x[:3] for x in f.edges}
    assert ("CALLS", "ApexMethod:A.one(2)", "ApexMethod:H.go(2)") in e and ("CALLS", "ApexMethod:A.two(0)", "ApexMethod:H.none(0)") in e
    assert ("EXECUTES_SOQL", "ApexMethod:A.one(2)", "CustomObject:X") in e and ("READS_FIELD", "ApexMethod:A.one(2)", "CustomField:X.Name") in e
    assert ("EXTENDS", "ApexClass:A", "ApexClass:B") in e and ("IMPLEMENTS", "ApexClass:A", "ApexInterface:D.E") in e
    assert [x for x in e if x[0] == "EXECUTES_DML"] == [("EXECUTES_DML", "ApexMethod:A.one(2)", "DML:insert")]
    assert len(f.snippets) == 2
    assert registry.parse_member("ApexClass", "Broken", "public class Broken { void f( {", C).nodes[0][0] == "ParseError"
    test = registry.parse_member("ApexClass", "T", "@IsTest private class T { @IsTest static void t() { A.one(null, 1); new Z(); } }", C)
    assert {x[2] for x in test.edges if x[0] == "IS_TEST_FOR"} == {"ApexClass:A", "ApexClass:Z"}
    trigger = registry.parse_member("ApexTrigger", "T", "trigger T on Acc (before insert, after  update) {}", C)
    assert trigger.edges[0][3]["events"] == ["before insert", "after update"]


def test_components():
    files = {"x.js": "import get from '@salesforce/apex/A.get';\nimport N from '@salesforce/schema/Acc.Name';\n// get()\n@wire(get) w;", "x.html": "<template><template for:each={rows} for:item='r'><c-a-b-c key={r.id} onsave={h}></c-a-b-c></template>{N}<p>{title}</p></template>"}
    e = edges("LightningComponentBundle", "x", json.dumps({"files": files}))
    assert {("IMPORTS_APEX", "LWC:x", "ApexMethod:A.get(?)"), ("USES_WIRE", "LWC:x", "ApexMethod:A.get(?)"), ("READS_FIELD", "LWC:x", "CustomField:Acc.Name"), ("EMBEDS_LWC", "LWC:x", "LWC:aBC"), ("LISTENS_TO_EVENT", "LWC:x", "LWCEvent:save"), ("LWC_BINDS_FIELD", "LWC:x", "CustomField:Acc.Name"), ("LWC_BINDS_PROPERTY", "LWC:x", "LWCProperty:title")} <= e
    assert not any(r == "CALLS_APEX_FROM_LWC" or "r.id" in d for r, _, d in e)
    one, two = (registry.parse_member("LightningComponentBundle", "x", json.dumps({"files": dict(order)}), C).nodes[0][3] for order in (files.items(), reversed(files.items())))
    assert one == two


def test_flow_and_object():
    flow = "<Flow><apiVersion>60.0</apiVersion><start><object>ns__A</object></start><subflows><flowName>S</flowName></subflows><recordLookups><object>B</object></recordLookups><recordLookups><object>B</object></recordLookups></Flow>"
    e = edges("Flow", "ns__F", flow, Context(namespace="ns"))
    assert e == {("CONTAINS", "Flow:F", "FlowVersion:F.v60"), ("TRIGGER_FIRES_ON", "FlowVersion:F.v60", "CustomObject:A"), ("FLOW_INVOKES_SUBFLOW", "FlowVersion:F.v60", "Flow:S"), ("REFERENCES_OBJECT", "FlowVersion:F.v60", "CustomObject:B")}
    content = {"apiName": "A", "objectXml": "<CustomObject><label>A</label><fields><fullName>X__c</fullName><referenceTo>B</referenceTo></fields></CustomObject>", "fields": {"X__c": "<CustomField><fullName>X__c</fullName><referenceTo>Z</referenceTo></CustomField>", "Y__c": "<CustomField><fullName>Y__c</fullName><formula>B__r.Z__c + A.X__c</formula></CustomField>"}}
    e = edges("CustomObject", "A", json.dumps(content))
    assert ("REFERENCES_OBJECT", "CustomField:A.X__c", "CustomObject:B") in e and not any(d == "CustomObject:Z" for _, _, d in e)
    assert ("READS_FIELD", "CustomField:A.Y__c", "CustomField:B.Z__c") in e
    assert registry.parse_member("Flow", "F", "<Flow", C).nodes[0][0] == "ParseError"


def test_omni():
    tree = json.dumps({"elements": [{"Type": "Integration Procedure Action", "propertySet": {"integrationProcedureKey": "K"}}, {"Type": "DataRaptor Post Action", "propertySet": {"bundle": "D"}}, {"remoteOptions": {}}, {"Type": "Remote Action"}]})
    assert edges("VlocityIntegrationProcedure", "P", tree) == {("IP_CALLS_IP", "IntegrationProcedure:P", "IntegrationProcedure:K"), ("IP_CALLS_DR", "IntegrationProcedure:P", "DataRaptor:D"), ("IP_INVOKES_REMOTE", "IntegrationProcedure:P", "Remote:unknown")}
    assert edges("VlocityDataRaptor", "D", json.dumps({"Type": "Load", "m": "Acc.Name"})) == {("DR_WRITES_FIELD", "DataRaptor:D", "CustomField:Acc.Name")}
    assert field_refs("A__r.B__c and A.B__c") == ["A.B__c"]


def test_registry():
    with pytest.raises(ValueError):
        registry.register("Flow", lambda *a: None)
    with pytest.raises(ValueError):
        registry.register("Layout", lambda *a: None)
    assert registry.parse_member("Unheard", "U", "abc", C).nodes[0][2]["rawSize"] == 3
    assert registry.parse_member("Flow", "F", "", C).nodes[0][0] == "ParseError"
    assert parse_xml("<a x='1'><b>true</b><b>2</b></a>") == ("a", {"@_x": "1", "b": [True, 2]})


def test_governor():
    code = "for (A a : [SELECT Id FROM A]) { update a; }\n/* while (1) { insert x; } */ do { } while (x);\ninsert y;"
    assert sorted(scan_source(code))[0][:2] == ("dml_in_loop", 1)
    assert {k for k, _, _ in scan_source(code)} == {"dml_in_loop", "unbounded_query"}
    assert scan_source("trigger t on A (before insert) { f(Trigger.new); }") == []
    assert scan_source("trigger t on A (before insert) { f(Trigger.old); }") == [("no_bulk", -1, "trigger without Trigger.new iteration")]
