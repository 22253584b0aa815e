"""Vector codes, MinHash near duplicates and lexical search against plain versions, on odd input too."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from metaweave.llm import lexical, minhash, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, code string, place int"


def vectors():
    r = random.Random(5)
    rows = [(k, [r.choice([-1, 0, 0.5, 1.25]) + r.random() / 8 for _ in range(32)], r.choice([None, 1, 2])) for k in range(300)]
    rows += [(k, list(rows[7][1]), 1) for k in range(400, 500)] + [(400, list(rows[7][1]), 1)] * 3 + [(12, list(rows[9][1]), 2)]
    rows += [(500, None, 1), (501, [0.0] * 31 + [None], 1), (502, [math.nan] * 32, 1), (503, [math.inf] + [0.0] * 31, 2), (504, [], 3), (505, [1.0] * 5, 3), (None, [2.0] * 32, None), (506, [1e30] + [0.0] * 31, 4)]
    return [(*x, "x", 1, "y", 2) for x in rows]


def plain_codes(rows, parts, entries, rounds):
    kept = [x for x in rows if x[1] is not None and all(c is not None and math.isfinite(c) for c in x[1])]
    length = parts * max(1, -(-max(len(x[1]) for x in kept) // parts))
    most = math.isqrt((1 << 60) // length)
    whole = [[max(-most, min(most, math.floor(256 * float(np.float32(c))))) for c in x[1]] + [0] * (length - len(x[1])) for x in kept]
    w = length // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(c)) for c in kept[k][1]]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, a: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(rounds):
        to = [[near(p, v[p]) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, t in zip(cut, to) if t[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for x, v in zip(kept, cut):
        to = [near(p, v[p]) for p in range(parts)]
        out.append((x[0], x[2], "".join(f"{e:02x}" for e in to), sum(far(v[p], books[p][e]) for p, e in enumerate(to))))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = Counter()
    for x in out:
        total[x[1]] += x[3]
    return sorted(((*x, total[x[1]], digest) for x in out), key=str)


def test_codes_by_definition(spark):
    rows = vectors()
    d = spark.createDataFrame(rows, VECTORS)
    want = plain_codes(rows, 16, 64, 2)
    got = vector_codes.vector_codes(d).select("id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(x) for x in got), key=str) == want
    some = [x for x in rows if x[0] is not None and x[0] % 7 == 0]  # fewer rows than entries, other parts
    got = vector_codes.vector_codes(spark.createDataFrame(some, VECTORS), parts=3, rounds=1).select("id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_codes(some, 3, 64, 1)
    assert vector_codes.vector_codes(d.limit(0)).collect() == [] and vector_codes.vector_codes(d.filter("vec_id IN (500, 502)")).collect() == []


def test_many_labels_are_joined_by_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    rows = vectors()
    got = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS)).select("id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_codes(rows, 16, 64, 2)


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_cells_find_the_nearest_and_look_at_few(bits):
    r = np.random.default_rng(1)
    entries = r.integers(-60, 60, (64, 4))
    entries[40] = entries[3]
    q = np.concatenate([r.integers(-80, 80, (500, 4)), entries])
    best, far, looked = vector_codes.Cells(entries, bits).nearest(q)
    whole = np.square(q[:, None] - entries[None]).sum(axis=2)
    assert (best == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all() and best[-24] == 3
    assert looked < len(q) * 64 / 3 or bits < 3


def sets_of(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def near_rows():
    r = random.Random(8)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 300))
    texts = []
    for _ in range(25):  # families of copies with some words changed, of few words and of many
        base = [word() for _ in range(r.choice([3, 5, 6, 8, 11, 20, 60, 200]))]
        for _ in range(r.randint(1, 12)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    rows = [(k, x) for k, x in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "Éa b c"), (906, "éa b c"), (907, "x y z"), (None, texts[0]), (None, None), (2**63 - 1, texts[4]), (5, texts[5]), (6, "again " + texts[9]), (None, "lone text"), (None, "lone text")]
    rows.append((910, " ".join(word() for _ in range(60_000))))
    return [(*x, 1, "h", 2, "r", "t") for x in rows]


NEAR = "doc_id long, text string, i int, h string, m int, r string, t string"


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_by_definition(spark, words):
    rows = near_rows()
    got = sorted((tuple(x) for x in minhash.minhash_components(spark.createDataFrame(rows, NEAR), words).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    sets = [sets_of(x[1], words) for x in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if k == x else k for k in label]
    last = 2**70
    least = {}
    for k, x in zip(label, rows):
        least[k] = min(least.get(k, last), last if x[0] is None else x[0])
    want = []
    for k, x, s in zip(label, rows, sets):
        c = None if least[k] == last else least[k]
        want.append((x[0], len(s), c, x[0] == c))
    assert got == sorted(want, key=str)


def test_minhash_of_nothing(spark):
    d = spark.createDataFrame(near_rows(), NEAR)
    assert minhash.minhash_components(d.limit(0)).collect() == []
    assert [tuple(x) for x in minhash.minhash_components(d.filter("doc_id = 900")).collect()] == [(900, 0, 900, True)]


def test_signatures_within_the_radius_share_a_key():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**16, (400, minhash.SIZE)).astype(np.uint16)
    b = a.copy()
    for k in range(len(b)):
        b[k, r.permutation(minhash.SIZE)[: minhash.RADIUS]] ^= np.uint16(1)
    x, y = minhash.chunk_keys(a), minhash.chunk_keys(b)
    assert (x == y).any(axis=1).all() and len(np.unique(x)) == x.size
    links = minhash.near_links(np.concatenate([a[:40], b[:40]]))
    assert {tuple(sorted(p)) for p in links.tolist()} == {(k, k + 40) for k in range(40)}


def test_crowded_keys_across_batches():
    import pyarrow as pa

    key = [1, 1, 2, 3, 3, 3, 4, 5, 5]
    for cut in range(1, 9):
        batches = [pa.RecordBatch.from_pydict({"key": key[a : a + cut], "m": list(range(a, min(a + cut, 9)))}) for a in range(0, 9, cut)]
        assert [m for b in minhash.crowded(iter(batches)) for m in b.column("m").to_pylist()] == [0, 1, 3, 4, 5, 7, 8]


def plain_search(items, docs, k, repeats=False):
    term = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    own = [(i, Counter(term(x))) for i, x in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            s = 0
            for t, times in Counter(term(text)).items():
                if c[t]:
                    m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                    s += (times if repeats else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, repeats, at_once", [(5, False, 200_000), (50, True, 200_000), (3, False, 20)])
def test_search_by_definition(spark, k, repeats, at_once):
    r = random.Random(6)
    word = lambda: r.choice(["über", "naïve", "日本語", "a1", "B2", "c", "d", "e", "f"] + [f"w{x}" for x in range(40)])
    text = lambda n: "".join(word() + r.choice([" ", "-", "_", "\n", ".", "'", " "]) for _ in range(n))
    docs = [(x, text(r.choice([0, 1, 5, 30, 200]))) for x in range(150)]
    docs += [(200 + x, docs[7][1]) for x in range(60)] + [(3, docs[3][1]), (None, docs[7][1]), (None, None), (300, None), (301, "..."), (302, text(50_000)), (2**63 - 1, docs[7][1])]
    items = [(x, text(r.choice([1, 3, 12]))) for x in range(12)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w5"), (50, None), (51, ""), (52, "-- !"), (53, "notthere")]
    d = spark.createDataFrame([(*x, 1, "h", 2, 3) for x in docs], "doc_id long, text string, i int, h string, q int, score int").repartition(3)
    q = spark.createDataFrame([(*x, 1, "h", 2) for x in items], "item_id long, text string, q int, t string, rank int")
    got = lexical.search(q, d, k, repeats, at_once=at_once).select("item", "rank", "doc", "score").collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_search(items, docs, k, repeats)
    assert lexical.search(q, d.limit(0)).collect() == [] and lexical.search(q.limit(0), d).collect() == []
