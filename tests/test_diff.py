"""Unified diffs, and manifests as files."""

import pytest

from metaweave.operators import diff, filters

TEXT = """\
--- a/classes/A.cls
+++ b/classes/A.cls
@@ -1 +1 @@
-x
+y
--- /dev/null
+++ b/a/new.cls
--- a/gone.cls
+++ /dev/null
+++ b/alone.cls
--- /dev/null
+++ /dev/null
--- a/first.cls
--- a/second.cls
+++ b/third.cls\t2001-01-01
+++ b/third.cls
--- a/b/x y.cls  
+++ a/x y.cls  """
FOUND = {("classes/A.cls", "modified"), ("a/new.cls", "added"), ("gone.cls", "deleted"), ("alone.cls", "added"), ("third.cls", "added"), ("a/x y.cls", "modified")}


@pytest.mark.parametrize("span", [1, 2, 3, 7, 100_000])
def test_headings_meet_over_spans(spark, monkeypatch, span):
    monkeypatch.setattr(diff, "DIFF_SPAN", span)
    lines = spark.createDataFrame([*enumerate(TEXT.split("\n")), (99, None)], "n long, line string")
    assert {(r.path, r.status) for r in diff.parse_diff(lines).collect()} == FOUND
    assert diff.parse_diff(lines.limit(0)).count() == 0


def test_manifest_files(spark, tmp_path):
    rows = [("ApexClass:B", "ApexClass", "only_in_a"), ("ApexClass:B", "ApexClass", "only_in_a"), ("ApexClass:A<&", "ApexClass", "changed"), ("Flow:F", "Flow", "only_in_b"), ("Flow:G", "Flow", "changed"), ("ApexMethod:m", "ApexMethod", "changed"), ("Flow:", "Flow", "changed")]
    d = spark.createDataFrame(rows, "qname string, label string, side string").repartition(4)
    for made in (d, d.limit(0)):
        members = diff.manifest_members(made)
        for destructive in (False, True):
            path = tmp_path / f"{made is d}-{destructive}"
            diff.write_manifest(made, f"file://{path}", destructive)
            text = "".join(f.read_text() for f in sorted(path.glob("part-*")))
            assert text == diff.manifest_xml(members, destructive)


def test_first_of_labels(spark):
    n = spark.createDataFrame([(label, f"{label}:{i}") for label, many in (("A", 5), ("B", 2)) for i in range(many)], "label string, qname string")
    kept, cut = filters.first_of_labels(n, 3)
    assert sorted(r.qname for r in kept.collect()) == ["A:0", "A:1", "A:2", "B:0", "B:1"] and cut
    assert filters.first_of_labels(n, 6)[1] is False and filters.first_of_labels(n, None)[0] is n
    assert filters.first_of_labels(n.limit(0), 1)[1] is False
