import pytest

from metaweave.__main__ import main


def test_commands(spark, tmp_path):
    base = tmp_path / "p/force-app/main/default/classes"
    base.mkdir(parents=True)
    (base / "A.cls").write_text("public class A { public void f() { B.g(1); } }")
    (tmp_path / "p/sfdx-project.json").write_text("{}")
    at = ["--store", f"file://{tmp_path}/s"]
    main([*at, "ingest", "--source", f"file://{tmp_path}/p"])
    assert main([*at, "orgs"])[0]["nodes"] == 2
    name = main([*at, "snapshot", "create", "one"])
    assert main([*at, "snapshot", "diff", name]) == {"nodes": [], "edges": []}
    assert [s["label"] for s in main([*at, "snapshot", "list"])] == ["one"]
    found = main([*at, "audit"])
    assert found["total"] == 1 and found["by_prefix"] == [{"prefix": "ApexMethod", "n": 1}]
    with pytest.raises(SystemExit):
        main([*at, "audit", "--delete-dangling"])
    assert main([*at, "audit", "--delete-dangling", "--yes"])["deleted"] == 1
    assert main([*at, "tool", "find_nodes", '{"org": "org1", "pattern": "Apex*"}'])["data"]["total"] == 2
    main([*at, "snapshot", "delete", name])
    assert main([*at, "snapshot", "prune"]) == 0
    main([*at, "ingest", "--source", f"file://{tmp_path}/p"])


def test_options(spark, tmp_path, capsys):
    rows = [("ApexClass", "A", "public class A { }"), ("ApexClass", "B", "public class B { }"), ("Flow", "F", "<Flow><apiVersion>60</apiVersion></Flow>")]
    members = spark.createDataFrame(rows, "member_type string, member_name string, content string").selectExpr("*", "1L AS last_modified_at", "'' AS source_uri", "false AS obsolete", "cast(null AS string) AS namespace")
    members.write.parquet(f"file://{tmp_path}/m")
    spark.createDataFrame([("ApexClass", "A", "ApexClass", "B")], "component_type string, component_name string, ref_type string, ref_name string").write.parquet(f"file://{tmp_path}/d")
    at = ["--store", f"file://{tmp_path}/s"]
    quick = ["--members", "--no-vectors", "--no-analysis", "--no-snapshot"]
    main([*at, "ingest", "--source", f"file://{tmp_path}/m", *quick, "--orgs", "one,con,two", "--dependencies", f"file://{tmp_path}/d"])
    said = capsys.readouterr().out
    assert {o["id"] for o in main([*at, "orgs"])} == {"one", "two"} and "con not an org identifier" in said

    def names(org):
        return sorted(m["qname"] for m in main([*at, "tool", "find_nodes", f'{{"org": "{org}", "pattern": "{{Apex,Flow}}*"}}'])["data"]["matches"])

    whole = names("one")
    assert whole == names("two") and {"ApexClass:A", "ApexClass:B"} < set(whole)
    found = main([*at, "tool", "trace_upstream", '{"org": "one", "qname": "ApexClass:B", "depth": 1}'])["data"]["nodes"]
    assert [x["qname"] for x in found] == ["ApexClass:A"]
    # without B: nothing is deleted if asked so, then B, and no flow, as flows aren't read
    members.filter("member_name = 'A'").write.parquet(f"file://{tmp_path}/less")
    less = ["--source", f"file://{tmp_path}/less", *quick, "--mode", "full", "--only", "ApexClass"]
    main([*at, "--org", "one", "ingest", *less, "--no-deletions"])
    assert names("one") == whole
    main([*at, "--org", "one", "ingest", *less])
    assert names("one") == [q for q in whole if q != "ApexClass:B"]
