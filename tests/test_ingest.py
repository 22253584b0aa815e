import hashlib
import io
import sys
import warnings
import zipfile

from pyspark.sql import functions as F

from metaweave import ingest, schema
from metaweave.functions import scalar
from metaweave.operators import vector
from metaweave.plans import api, tools
from metaweave.sources import archives, connectors
from metaweave.sources import members as m
from metaweave.store import GraphStore


def members(spark, rows):
    return spark.createDataFrame([("org1", kind, kind, name, 1, "u", gone, None, text) for kind, name, gone, text in rows], "org_id string, category string, member_type string, member_name string, last_modified_at long, source_uri string, obsolete boolean, namespace string, content string")


A = "public class A { public void f() { B.g(1); } @InvocableMethod public static void h() { } }"
B = "public class B { public static void g(Integer i) { } }"
FLOW = "<Flow><actionCalls><actionType>apex</actionType><actionName>A</actionName></actionCalls></Flow>"


def test_sync(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    store.upsert_org("org1", "dev", "", "", 1)
    lwc = '{"files": {"x.js": "import h from \'@salesforce/apex/A.h\';"}}'
    first = ingest.sync(store, members(spark, [("ApexClass", "A", False, A), ("ApexClass", "B", False, B), ("Flow", "F", False, FLOW), ("LightningComponentBundle", "x", False, lwc)]), "org1", now=10, embedder=None)
    assert first.parse_errors == 0 and first.deleted == 0 and first.nodes["inserted"] == 9
    e = {(r.rel_type, r.src, r.dst) for r in store.read("edges").collect()}
    assert ("FLOW_INVOKES_APEX_METHOD", "FlowVersion:F.v0", "ApexMethod:A.h(0)") in e
    again = ingest.sync(store, members(spark, [("ApexClass", "A", False, A)]), "org1", now=20, embedder=None)
    assert again.nodes == {"inserted": 0, "updated": 0, "unchanged": 3} and again.snapshot
    assert again.deleted == 2  # class B and its method; flows weren't read
    gone = ingest.sync(store, members(spark, [("Flow", "F", True, "")]), "org1", mode="incremental", now=30, embedder=None)
    assert gone.deleted == 1 and "Flow:F" not in {r.qname for r in store.read("nodes").collect()}
    broken = ingest.sync(store, members(spark, [("ApexClass", "C", False, "class C {")]), "org1", now=40, embedder=None)
    assert broken.parse_errors == 1 and broken.deleted == 0
    assert store.read("orgs").first().last_synced_at == 40
    assert ingest.choose_mode("auto", 1, True) == "incremental" and ingest.choose_mode("auto", None, True) == "full"
    assert {r["id"] for r in api.orgs(store)} == {"org1"} and api.relations(store, "org1")
    assert {r["qname"] for r in api.search(store, "org1", "method:a", 5)} == {"ApexMethod:A.f(0)", "ApexMethod:A.h(0)"}
    near = api.neighborhood(store, "org1", "ApexClass:A", 9)
    assert "ApexMethod:A.h(0)" in {x["qname"] for x in near["nodes"]} and not near["truncated"]
    assert api.overview(store, "org1", ["ApexClass", "ApexMethod"])["edges"] and api.full(store, "org1", 3)["nodes"] and api.schema_graph(store, "org1") == {"nodes": [], "edges": []}
    own = store.read("nodes").filter("label = 'ApexMethod'")
    made = vector.embed(own, F.col("qname"), lambda: vector.hashing_embedder(16)).withColumn("org_id", F.lit("org1"))
    assert store.upsert_vectors(made)["inserted"] == 2 and store.upsert_vectors(made)["unchanged"] == 2
    hits = tools.dispatch("find_similar", store, org="org1", qname="ApexMethod:A.f(0)", k=5).data["hits"].collect()
    assert [h.qname for h in hits] == ["ApexMethod:A.h(0)"]
    assert vector.stale_vectors(own, store.read("node_vectors"), F.col("qname")).count() == 0
    store.rebuild()
    assert store.read("nodes").count() == 0


def fetch(kind):
    yield (kind, "N", 5, "u", False, None, "c")


def changes(since):
    return [("Flow", "b", 7, "u", False, None, "c"), ("Flow", "a", 3, "u", True, None, None)]


def test_sources(spark, tmp_path):
    import types

    sys.modules["fetching_for_tests"] = types.SimpleNamespace(fetch=fetch, changes=changes)
    reader = connectors.MemberSource({"fetch": "fetching_for_tests:fetch", "types": "Flow,ApexClass"}).reader(None)
    assert [list(reader.read(p))[0][0] for p in reader.partitions()] == ["Flow", "ApexClass"]
    feed = connectors.MemberSource({"fetch": "fetching_for_tests:changes", "since": "4"}).simpleStreamReader(None)
    rows, at = feed.read(feed.initialOffset())
    assert [r[1] for r in rows] == ["b"] and at == {"at": 7}
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("omni/x.json", "{}")
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    assert [(r.path, r.content) for r in archives.read_archives(spark, f"file://{tmp_path}").collect()] == [("omni/x.json", "{}")]
    objects = spark.createDataFrame([("Account", False, True), ("AccountHistory", False, True), ("X__c", True, False), ("p__Y__c", True, True), ("Z", False, False), ("A__b", True, True)], "name string, custom boolean, queryable boolean")
    assert sorted(r.name for r in m.include_objects(objects).collect()) == ["Account", "X__c"]
    assert sorted(r.name for r in m.include_objects(objects, whitelist=spark.createDataFrame([("Z",)], "name string"), namespaces=["p"]).collect()) == ["Account", "X__c", "Z", "p__Y__c"]
    rows = spark.createDataFrame([("{}", "bad{")], "ns__A__c string, ns__B__c string")
    assert m.normalize_rows(rows, "ns", ("A", "B")).first().asDict() == {"A": "{}", "B": '{"_raw":"bad{"}'}
    deps = spark.createDataFrame([("T", "a", "U", "b"), ("T", "a", "U", "b"), ("T", None, "U", "b")], "component_type string, component_name string, ref_type string, ref_name string")
    assert sorted((r.src, r.dst) for r in m.baseline_edges(deps).collect()) == [("T:", "U:b"), ("T:a", "U:b")]
    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "parent int, seq int, v string")
    assert {r.id: r.elements for r in m.attach_children(parents, children, "id", "parent", "elements").collect()} == {1: ['{"seq":1,"v":"x"}', '{"seq":2,"v":"y"}'], 2: []}
    good, report = m.read_sources(spark, {"one": lambda: parents, "two": lambda: 1 / 0, "three": lambda: (_ for _ in ()).throw(RuntimeError("socket timed out"))})
    assert good.count() == 2 and {r.category: r.n for r in m.skip_summary(report).collect()} == {"unknown": 2}
    assert m.applicable([{"n": 1, "applies_when": {"capability": "x"}}, {"n": 2, "applies_when": {"not": {"capability": "x"}}}], {"x": True}) == [{"n": 1, "applies_when": {"capability": "x"}}]


def test_scalars(spark):
    d = spark.createDataFrame([("pkg__DR_Name", "my-long-name", "A__r.B__c + C.D * 2 + A__r.B__c", "a\nb\nc", "mail x@y.com 1.2.3.4 Bearer a.b")], "q string, k string, f string, t string, p string")
    r = d.select(
        scalar.normalize_key(F.concat(F.lit("DataRaptor:"), "q"), "pkg").alias("a"), scalar.kebab_to_camel(F.col("k")).alias("b"), scalar.formula_fields(F.col("f")).alias("c"),
        scalar.line_of(F.col("t"), F.lit(3)).alias("d"), scalar.scrub(F.col("p")).alias("e"), scalar.split_csv(F.lit(" a,,b ")).alias("f"), scalar.strip_namespace(F.col("q"), "pkg").alias("g"),
        scalar.bundle_hash(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("h"), scalar.bundle_hash(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("i"),
        scalar.diagram_label(F.lit("x" * 40)).alias("j"), scalar.first_match(F.lit("ab12"), "([a-z]+)[0-9]").alias("k"), scalar.truthy(F.lit("false")).alias("l"), scalar.layer(F.lit("ApexClass")).alias("m"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("name", "myLongName", ["A.B__c", "C.D"], 2, "mail <email> 1.2.3.4 <bearer-token>", ["a", "b"], "DR_Name")
    assert r.h == r.i == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest() and r.j == "x" * 27 + "\u2026" and (r.k, r.l, r.m) == ("ab", True, "Apex")
    for good in ("ApexClass", "A_1"):
        assert schema.check_name(good) == good
    for bad in ("", "1a", "a-b", "x" * 65):
        try:
            schema.check_name(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_tombstones_take_their_edges(spark, tmp_path):
    from metaweave.streaming.merge import apply_batch

    store = GraphStore(spark, f"file://{tmp_path}/s")
    fact = "org_id string, label string, qname string, attributes string, source_hash string, ordinal long, obsolete boolean"
    row = lambda q, n, gone: ("org1", "Flow", f"Flow:{q}", "{}", q, n, gone)
    apply_batch(store, spark.createDataFrame([row("a", 1, False), row("b", 2, False), row("c", 3, False)], fact), 1)
    store.merge_edges(spark.createDataFrame([("org1", "R", "Flow:a", "Flow:b", "{}"), ("org1", "R", "Flow:b", "Flow:c", "{}"), ("org1", "R", "Flow:a", "Flow:c", "{}")], "org_id string, rel_type string, src string, dst string, attributes string"), 1)
    apply_batch(store, spark.createDataFrame([row("b", 4, True)], fact), 2)
    assert {r.qname for r in store.read("nodes").collect()} == {"Flow:a", "Flow:c"}
    assert [(r.src, r.dst) for r in store.read("edges").collect()] == [("Flow:a", "Flow:c")]


def test_org_identifiers_and_scrubbing():
    for good in ("dev", "a-b_1", "00D000000000001", "0" * 18):
        assert schema.check_org(good) == good
    for bad in ("", "1dev", "a.b", "a@b", "..", "CON", "com3", "a" * 65, "a/b", None):
        try:
            schema.check_org(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    value = scalar.scrub_value({"a": ["Bearer x.y", {"b": "u@v.org"}], "n": 5})
    assert value == {"a": ["<bearer-token>", {"b": "<email>"}], "n": 5}
    deep = "x"
    for _ in range(12):
        deep = [deep]
    assert "<max-depth>" in str(scalar.scrub_value(deep))


def test_renames_of_a_sync_happen_at_once(spark, tmp_path):
    """A chain, a swap and two names that become one: nodes keep their first time, edges follow both ends and meet."""
    store = GraphStore(spark, f"file://{tmp_path}/s")
    store.upsert_org("org1", "dev", "", "", 1)
    schema_ = "org_id string, category string, member_type string, member_name string, last_modified_at long, source_uri string, obsolete boolean, namespace string, content string, service_id string"

    def sync(names, at):
        rows = [("org1", "c", "Thing", n, 1, "u", False, None, "x", i) for i, n in names]
        return ingest.sync(store, spark.createDataFrame(rows, schema_), "org1", now=at, embedder=None, analyse=False, snapshot=False)

    sync([("1", "a"), ("2", "b"), ("3", "c"), ("4", "p"), ("5", "q"), ("6", "x"), ("7", "y")], 10)
    edge = "org_id string, rel_type string, src string, dst string, attributes string"
    t = lambda n: f"Thing:{n}"
    store.merge_edges(spark.createDataFrame([("org1", "R", t(s), t(d), "{}") for s, d in (("a", "b"), ("b", "c"), ("p", "q"), ("q", "p"), ("a", "x"), ("a", "y"), ("x", "y"))], edge), 11)
    report = sync([("1", "b"), ("2", "c"), ("3", "a"), ("4", "q"), ("5", "p"), ("6", "z"), ("7", "z"), ("8", "new")], 20)
    assert report.renamed == 7
    assert {(r.src, r.dst, r.first_seen_at) for r in store.read("edges").filter("rel_type = 'R'").collect()} == {(t(s), t(d), 11) for s, d in (("b", "c"), ("c", "a"), ("q", "p"), ("p", "q"), ("b", "z"), ("z", "z"))}
    assert {(r.qname, r.first_seen_at, r.last_seen_at) for r in store.read("nodes").collect()} == {(t(n), 10, 20) for n in "abcpqz"} | {(t("new"), 20, 20)}
    assert sync([("1", "b")], 30).renamed == 0


def test_the_baseline_of_a_sync(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    store.upsert_org("org1", "dev", "", "", 1)
    rule = "<DuplicateRule><duplicateRuleMatchRules><matchingRule>M</matchingRule></duplicateRuleMatchRules></DuplicateRule>"
    deps = spark.createDataFrame([("DuplicateRule", "D", "i1", None, "MatchingRule", "M", "i2", "ns"), ("Layout", "ns__L", "i3", "ns", "CustomField", "003x", "003x", None)], "component_type string, component_name string, component_id string, component_namespace string, ref_type string, ref_name string, ref_id string, ref_namespace string")
    for at in (10, 20):
        report = ingest.sync(store, members(spark, [("DuplicateRule", "D", False, rule)]), "org1", now=at, embedder=None, dependencies=deps)
        assert report.baseline == {"inserted": int(at == 10), "updated": 0, "unchanged": int(at == 20)}
    got = {(r.src, r.dst): r.attributes for r in store.read("edges").filter("rel_type = 'REFERENCES'").collect()}
    assert set(got) == {("DuplicateRule:D", "MatchingRule:M"), ("Layout:L", "CustomField:003x")}
    assert "mcd" not in got["DuplicateRule:D", "MatchingRule:M"] and got["Layout:L", "CustomField:003x"] == '{"source":"mcd","mcdSrcType":"Layout","mcdDstType":"CustomField","dynamic":true}'


def test_archives_are_read_by_entry(spark, tmp_path):
    """Many entries in many tasks; a bomb, a broken entry and a file that is no archive are errors of their own."""
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(200):
            z.writestr(f"d/{k}.txt", f"{k}-" + "x" * 500)
        z.writestr("d/", "")
        z.writestr("bomb.txt", "0" * 200_000)
        z.writestr("twice.txt", "one")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            z.writestr("twice.txt", "two")
    data = bytearray((tmp_path / "many.zip").read_bytes())
    (tmp_path / "odd name.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "lies.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.txt", "1" * 50_000)
        z.writestr("good.txt", "good")
    lies = bytearray((tmp_path / "lies.zip").read_bytes())
    at = lies.index(b"PK\x01\x02") + 24
    lies[at : at + 4] = (10).to_bytes(4, "little")  # the directory says 10 bytes
    (tmp_path / "lies.zip").write_bytes(lies)
    d = archives.read_archives(spark, f"file://{tmp_path}", quota=10_000, chunk=5_000)
    assert d.rdd.getNumPartitions() > 20 and len(data) > 0
    got = d.collect()
    by = lambda name: [r for r in got if r.archive.endswith(name)]
    assert {r.path: r.content for r in by("many.zip") if r.path.startswith("d/")} == {f"d/{k}.txt": f"{k}-" + "x" * 500 for k in range(200)}
    assert sorted(r.content for r in by("many.zip") if r.path == "twice.txt") == ["one", "two"]
    assert [("quota" in r.error, r.content) for r in got if r.path == "bomb.txt"] == [(True, None)]
    lied = {r.path: r for r in by("lies.zip")}
    assert lied["good.txt"].content == "good" and (lied["big.txt"].error or len(lied["big.txt"].content) <= 10)
    assert [(r.path, bool(r.error), "not found" in r.error.lower()) for r in by("name.zip")] == [(None, True, False)]
