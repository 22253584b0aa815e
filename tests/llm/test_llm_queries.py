"""The registered queries on the smallest tables, and the pipeline."""

import re

import duckdb
import pytest

import corpus_pipeline
from metaweave.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, duck, same):
    same(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


COLUMNS = {
    "op1": {"doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256"},
    "op2": {"doc_id", "fingerprint", "component_id"},
    "op3": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op6": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op8": {"doc_id", "held_out", "lang_pred", "score"},
    "op9": {"page_id", "host", "path", "rule", "verdict"},
    "op10": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op11": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op12": {"doc_id", "n_shingles", "component_id", "kept"},
    "op13": {"item_id", "rank", "doc_id", "score"},
}


def test_columns(spark):
    found = {n.split("_")[0]: f for n, f in queries.QUERIES.items()}
    assert set(found) == set(COLUMNS)
    for n in ("op3", "op6", "op7", "op11", "op12", "op13"):
        assert COLUMNS[n] <= set(found[n](spark, SMALL).columns)


def test_held_out_accuracy(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SMALL}/documents.parquet'").fetchall())
    held = [r for r in queries.QUERIES["op8_language_id"](spark, SMALL).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def test_pipeline(spark):
    """Each stage against a plain version of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.Table(stage(spark, docs, SMALL)).read()
        kept[name] = (before.collect(), docs.collect(), docs.columns)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name][2] == corpus_pipeline.COLUMNS
    before, after, _ = kept["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}
    before, after, _ = kept["exact_dedup"]
    last = {}
    for r in before:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in after} == set(last.values())
    before, after, _ = kept["simhash_near_dedup"]
    sets = {}
    for r in before:
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert {r.doc_id for r in after} == set(label.values())
    before, after, _ = kept["substring_dedup"]
    text = {r.doc_id: r.text for r in after}
    first = {}
    split = {r.doc_id: r.text.split() for r in before}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    for r in before:
        gone = set()
        for k in range(len(split[r.doc_id]) - 49):
            if first[tuple(split[r.doc_id][k : k + 50])] < r.doc_id:
                gone |= set(range(k, k + 50))
        assert text[r.doc_id].split() == [w for k, w in enumerate(split[r.doc_id]) if k not in gone]
        assert gone or text[r.doc_id] == r.text
    before, after, _ = kept["best_fit_packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    used = {}
    for r in after:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 2
