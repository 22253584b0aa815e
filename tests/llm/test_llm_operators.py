"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.llm import bpe, components, exact_dedup, fingerprint, language_id, line_dedup, packing, repeats, simhash, substring_dedup, suffix_dedup, url_filter

P = pytest.importorskip("public_tokenizers")
#: Names that operators use inside, as further columns of the input.
CLASH = "i long, h long, t string, row string, marks string, part int, n int, s int, key long, r string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "t", "r", "m", 3, 4, 5, 6, "q") for i, x in rows], "doc_id long, text string, " + CLASH)


def corpus(seed, n=40, size=120):
    """Documents that share passages, repeat lines, and have copies; null, empty and blank ones; repeated rows; equal and null ids."""
    r = random.Random(seed)
    words = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "s", ","]) + str(r.randint(0, 30)) for _ in range(k))
    shared = [words(60) for _ in range(4)]
    lines = [words(6) for _ in range(5)]
    out = []
    for i in range(n):
        x = words(r.randint(0, size))
        if r.random() < 0.5:
            x += " " + r.choice(shared)[r.randint(0, 40) :] + "\n" + words(r.randint(0, 9))
        if r.random() < 0.4:
            x += "\n" + "\n".join(lines[: r.randint(1, 5)]) + "\n" + words(3)
        out.append((i * 3 % 101, x))
    out += [(500 + k, out[k][1]) for k in range(8)] + [(600, None), (601, ""), (602, "\n\n \n"), out[3], out[3], (700, "é🙂ß " * 30), (701, "é🙂ß " * 30), (None, out[5][1]), (None, None), (9, words(70) + " " + shared[0])]
    return out


def order(rows):
    """What stands before what: by id, null last."""
    return [(2**63 - 1 if i is None else i, x or "") for i, x in rows]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def removed(rows, symbols, window):
    """For each row which symbols a window covers that starts in a row with a smaller id."""
    first = {}
    keyed = [(i, symbols(x)) for i, x in order(rows)]
    for i, s in keyed:
        for k in range(len(s) - window + 1):
            w = tuple(s[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, s in keyed:
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if first[tuple(s[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, s, gone))
    return out


def real(i):
    return None if i == 2**63 - 1 else i


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    got = sorted((str(r.doc_id), r.n_bytes, len(r.spans), sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    want = []
    for i, s, gone in removed(rows, lambda x: x.encode(), suffix_dedup.WINDOW):
        want.append((str(real(i)), len(s), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), sha(bytes(b for b, g in zip(s, gone) if not g))))
    assert got == sorted(want)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    """Texts longer than a piece, within one process."""
    text = ("".join(random.Random(5).choice("abcdefgh") for _ in range(900))).encode()
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    cut = list(suffix_dedup.pieces(text, 50))
    assert len(cut) == 5 and all(text[a : a + len(p)] == p for a, p in cut)
    starts = [a + k for a, p in cut for k in range(len(p) - 49)]
    assert starts == list(range(len(text) - 49))


def test_sorted_suffixes():
    r = np.random.default_rng(0)
    rows = r.integers(0, 3, (600, 50), dtype=np.uint8)
    rows[200:400], rows[400:500, :40] = rows[:200], rows[:100, :40]
    group = r.integers(0, 3, 600)
    by, label = suffix_dedup.sort_suffixes(rows, group)
    keys = [(int(group[k]), rows[k].tobytes()) for k in by]
    assert keys == sorted(keys) and all((keys[k] == keys[k - 1]) == (label[k] == label[k - 1]) for k in range(1, len(keys)))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed, size=200)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, sha(r.kept)) for r in substring_dedup.document_spans(frame(spark, rows)).collect())
    want = [(str(real(i)), len(s), sum(gone), sha(" ".join(w for w, g in zip(s, gone) if not g))) for i, s, gone in removed(rows, re.compile(r"[^\x20\x09-\x0D]+").findall, 50)]
    assert got == sorted(want) and sum(w[2] for w in want)
    assert substring_dedup.document_spans(frame(spark, [])).count() == 0


def test_substring_dedup_small_windows(spark):
    rows = corpus(3, n=25, size=40)
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.document_spans(frame(spark, rows), window=7).collect())
    assert got == sorted((str(real(i)), sum(gone)) for i, _, gone in removed(rows, str.split, 7))


def test_cut_words():
    assert substring_dedup.cut_words(" a b\n c  d ", [1], [3]) == " a d "
    assert substring_dedup.cut_words("a b", [0], [2]) == ""


def test_line_dedup(spark):
    rows = corpus(4)
    got = sorted((str(r.doc_id), r.n_lines, sha(r.kept)) for r in line_dedup.remove_repeated_lines(frame(spark, rows)).collect())
    seen, want, done = set(), [], {}
    keyed = sorted(set(order(rows)), key=lambda x: x[0])
    by_id = {}
    for i, x in keyed:
        by_id.setdefault(i, []).append(x)
    assert max(map(len, by_id.values())) <= 2
    hashes = {r.x: r.h for r in spark.createDataFrame([(x,) for _, x in keyed], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    for i in sorted(by_id):
        for x in sorted(by_id[i], key=lambda x: hashes[x]):
            lines, gone = x.split("\n"), set()
            for k in range(len(lines) - 2):
                w = tuple(lines[k : k + 3])
                if not "".join(w).strip(" "):
                    continue
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
            done[i, x] = (str(real(i)), len(lines), sha("\n".join(line for k, line in enumerate(lines) if k not in gone)))
    want = [done[k] for k in order(rows)]
    assert got == sorted(want)
    assert line_dedup.remove_repeated_lines(frame(spark, [])).count() == 0


def test_exact_dedup(spark, monkeypatch):
    rows = corpus(6) + [(1000 + k, "hot") for k in range(50)]
    groups = {}
    for i, x in rows:
        groups.setdefault(x or "", []).append(i)
    for hot in (exact_dedup.HOT_ROWS, 5):
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
        d = exact_dedup.exact_dedup(frame(spark, rows))
        got = sorted((r.row.text or "", str(r.row.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in d.collect())
        keep = {x: max((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
        assert got == sorted((x or "", str(i), keep[x or ""], len(groups[x or ""]), sha(x or "")) for i, x in rows)
        kept = exact_dedup.kept_rows(frame(spark, rows))
        assert kept.columns == frame(spark, []).columns
        assert sorted((r.text or "", r.doc_id) for r in kept.collect()) == sorted(keep.items())
    assert exact_dedup.kept_rows(frame(spark, [])).count() == 0
    folded = exact_dedup.exact_dedup(frame(spark, [(1, "A  b"), (2, " a B ")]), normalise=exact_dedup.case_folded)
    assert {r.keep_id for r in folded.collect()} == {2} and {r.row.text for r in folded.collect()} == {"A  b", " a B "}


def plain_fingerprint(x, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    grams = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    import xxhash

    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_links(spark):
    rows = corpus(7)
    rows += [(2000 + k, x.replace("alpha", "omega", 1) if x else x) for k, (_, x) in enumerate(rows[:30])]
    prints = [plain_fingerprint(x, 4) for _, x in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for (i, _), g in zip(order(rows), label):
        least[g] = min(least.get(g, i), i)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.document_components(frame(spark, rows), 4, 4).collect())
    assert got == sorted((str(real(i)), f"{p:016x}", str(real(least[g]))) for (i, _), p, g in zip(order(rows), prints, label))
    assert simhash.document_components(frame(spark, []), 4, 4).count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_bit_planes(width):
    r = np.random.default_rng(width)
    base = r.integers(0, 2**63, (20, width), dtype=np.uint64)
    f = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 63, base.shape, dtype=np.uint64)) for _ in range(6)] + [base])
    true = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    for radius in (0, 1, 2, 4, 7, 32):
        got = simhash.Planes(f).within(np.arange(len(f)), radius, slice(0, None))[:, : len(f)]
        assert (got == (true <= radius)).all()


def test_bucket_keys_lose_nothing(spark):
    """Each pair within the radius shares a key, for as many fingerprints as make any number of blocks."""
    r = random.Random(1)
    pairs = []
    for k in range(60):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append((k, *(x - 2**64 if x >= 2**63 else x for x in (a, b))))
    d = spark.createDataFrame(pairs, "k int, a long, b long")
    for n in (10, 10**8, 10**11):
        keys = [simhash.bucket_keys(64, n, 4, [c]) for c in "ab"]
        assert d.filter(~F.arrays_overlap(*keys)).count() == 0


def test_near_duplicates_by_similarity(spark):
    r = random.Random(2)
    long = [" ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(300)) for _ in range(12)]
    near = [" ".join(w if k not in (50, 150) else "x" for k, w in enumerate(x.split())) for x in long]
    far = [" ".join(w if k % 4 else "y" for k, w in enumerate(x.split())) for x in long]
    rows = [(k, x) for k, x in enumerate(long)] + [(100 + k, x) for k, x in enumerate(near)] + [(200 + k, x) for k, x in enumerate(far)] + [(300, None), (301, ""), (5, long[5]), (5, long[5])]
    kept = simhash.kept_rows(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(12), *range(200, 212), 300])
    assert simhash.kept_rows(frame(spark, [])).count() == 0


def test_repeats_dont_hide_near_duplicates(spark):
    """A passage of 100 words that occurs 20 times in one text and once in the other leaves the sets of shingles alike."""
    r = random.Random(6)
    rows = []
    for k in range(4):
        words = [r.choice(WORDS) + str(r.randint(0, 9999)) for _ in range(1000)]
        rows += [(k, " ".join(words)), (100 + k, " ".join(words[:500] + 20 * words[400:500] + words[500:]))]
    assert sorted(x.doc_id for x in simhash.kept_rows(frame(spark, rows)).collect()) == list(range(4))


def family(seed, n, size, edits):
    """Texts of one template, each with up to so many words of its own: some pairs are alike enough, most are not."""
    r = random.Random(seed)
    base = [r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(size)]
    out = {}
    for k in range(n):
        words = base[:]
        for at in r.sample(range(size), r.randint(0, edits)):
            words[at] = f"x{r.randint(0, 10**9)}"
        out[" ".join(words)] = k
    return list(out)


def united(texts, similarity=0.8):
    """Brute force: the root of each text's group."""
    sets = [set(simhash.shingles(x, 5)) for x in texts]
    forest = components.Forest(len(texts))
    for k in range(len(texts)):
        for j in range(k):
            if len(sets[j] & sets[k]) >= similarity * len(sets[j] | sets[k]):
                forest.join(j, k)
    return [forest.find(k) for k in range(len(texts))]


@pytest.mark.parametrize("exact", [False, True])
def test_dense_groups_lose_no_link(spark, exact):
    texts = [x for seed, shape in enumerate([(375, 60, 3), (466, 200, 12), (451, 100, 6)]) for x in family(seed, *shape)] + ["", " \n", "a b", "a  b"]
    got = {r.i: r.component for r in simhash.near_duplicates(frame(spark, list(enumerate(texts))), exact=exact).collect()}
    assert [got[k] for k in range(len(texts))] == united(texts)


def test_large_groups_in_blocks(spark, monkeypatch):
    """A group of many blocks, most of whose texts are outside its largest part, and buckets cut into blocks."""
    monkeypatch.setattr(simhash, "JUDGED", 60)
    monkeypatch.setattr(simhash, "SHINGLES", 4000)
    monkeypatch.setattr(simhash.split_buckets, "__defaults__", (50,))
    texts = family(7, 500, 100, 8) + family(8, 150, 150, 2)
    got = {r.i: r.component for r in simhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == united(texts)


def test_links_within():
    """As few pairs as unite all that are near, whatever the order."""
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (3, 2), dtype=np.uint64)
    f = np.concatenate([base[k] ^ (np.uint64(1) << r.integers(0, 63, (80, 2), dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, (80, 2), dtype=np.uint64)) for k in range(3)])
    r.shuffle(f)
    for radius in (1, 3, 4, 6, 70):
        one, two = components.Forest(len(f)), components.Forest(len(f))
        for k in range(len(f)):
            for j in range(k):
                if np.bitwise_count(f[j] ^ f[k]).sum() <= radius:
                    one.join(j, k)
        got = simhash.links_within(f, radius)
        assert all(np.bitwise_count(f[a] ^ f[b]).sum() <= radius and two.join(int(a), int(b)) for a, b in got)
        assert [one.find(k) for k in range(len(f))] == [two.find(k) for k in range(len(f))]


def test_judged_links():
    """As few links as unite what all alike pairs would; shared members are counted in products and in pairs."""
    r = np.random.default_rng(5)
    pool = np.sort(r.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.sort(np.append(r.choice(pool, n, replace=False), r.integers(0, 2**63, 3, dtype=np.uint64))) for n in r.integers(0, 60, 90)] + [np.zeros(0, np.uint64)] * 2
    sets[5] = sets[4]
    n = len(sets)
    true = np.array([[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets])
    got = simhash.shared_counts(sets)
    assert (got[~np.eye(n, dtype=bool)] == true[~np.eye(n, dtype=bool)]).all()
    label = np.where(np.arange(n) % 7 == 0, 0, np.arange(n))
    one, two = components.Forest(n), components.Forest(n)
    for k in range(n):
        one.join(k, int(label[k])), two.join(k, int(label[k]))
        for j in range(k):
            if true[j, k] >= 0.6 * (len(sets[j]) + len(sets[k]) - true[j, k]):
                one.join(j, k)
    for a, b in simhash.judged_links(sets, label, 0.6):
        two.join(int(a), int(b))
    assert [one.find(k) for k in range(n)] == [two.find(k) for k in range(n)]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op7", "op10"])
def test_the_largest_id_is_not_null(spark, name):
    rows = [(2**63 - 1, "a b c\nd e f\ng h i"), (None, "x y\nz"), (3, "one two\nthree\nfour")]
    run = {"op1": line_dedup.remove_repeated_lines, "op2": lambda d: simhash.document_components(d, 4, 4), "op3": suffix_dedup.remove_repeats, "op7": substring_dedup.document_spans, "op10": fingerprint.compare}[name]
    assert sorted((r.doc_id for r in run(frame(spark, rows)).collect()), key=str) == sorted([2**63 - 1, None, 3], key=str)


@pytest.mark.parametrize("window", [127, 128, 300])
def test_long_windows(spark, window):
    r = random.Random(window)
    passage = [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(window + 20)]
    own = lambda k: [f"own{k}x{j}" for j in range(40)]
    rows = [(k, " ".join(own(k) + passage[k:] + own(k + 10))) for k in range(4)] + [(9, " ".join(passage[: window - 1]))]
    got = sorted((x.doc_id, x.n_removed) for x in substring_dedup.document_spans(frame(spark, rows), window).collect())
    assert got == sorted((i, sum(g)) for i, _, g in removed(rows, str.split, window)) and sum(x[1] for x in got)
    got = sorted((x.doc_id, x.n_bytes - len(x.kept)) for x in suffix_dedup.remove_repeats(frame(spark, rows), window).collect())
    assert got == sorted((i, sum(g)) for i, _, g in removed(rows, lambda x: x.encode(), window)) and sum(x[1] for x in got)


def test_windows_have_a_bound(spark):
    for run in (substring_dedup.document_spans, suffix_dedup.remove_repeats):
        with pytest.raises(ValueError, match="32767"):
            run(frame(spark, []), 40_000)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    forest = components.Forest(3000)
    for a, b in links:
        forest.join(a, b)
    nodes = {x for p in links for x in p}
    got = {(x.u, x.v) for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(x, forest.find(x)) for x in nodes if forest.find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_best_fit_places_as_one_at_a_time():
    r = random.Random(4)
    for size in (10, 64, 100):
        lengths = sorted((r.randint(1, size) for _ in range(300)), reverse=True)
        left = []
        for n in lengths:
            fits = [x for x in left if x >= n]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - n)
            else:
                left.append(size - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.best_fit(counts, size)
        used = {}
        for n, c in counts.items():
            for k in range(c):
                plan = runs[n][np.searchsorted(runs[n][:, 0], k, side="right") - 1]
                j = k - plan[0]
                used.setdefault(plan[2] + j // plan[1], []).append((int(plan[3] + j % plan[1] * n), n))
        for own in used.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= size
        assert sorted(size - sum(n for _, n in own) for own in used.values()) == sorted(left)


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    rows = corpus(8) + [(800, "word " * 9000), (801, "x" * 5000), (802, "<|endoftext|> it's ¡İ “Œuvre”!!")]
    d = packing.pack(frame(spark, rows), path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = sorted((str(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in rows)
    docs = {}
    for r in d:
        assert len(r.ids) == r.length <= 4096 and r.start == 4096 * r.piece
        docs.setdefault(r.doc_id, []).append(r)
    got = []
    for own in docs.values():
        firsts = [r for r in own if r.piece == 0]
        for f in firsts:
            got.append((str(f.doc_id), tuple(f.ids) + tuple(x for k in range(1, 9) for r in own if r.piece == k for x in r.ids)))
    assert sorted(got) == want
    places = {}
    for r in d:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert packing.pack(frame(spark, []), path).count() == 0


def test_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(path, P.PATTERN)
    r = random.Random(5)
    tokens = list(ranks)
    texts = ["", "a", " " * 300, "aaaa" * 100, "don't I'LL", "\n\n x\t y"] + ["".join(r.choice("abtheion rs") for _ in range(60)) for _ in range(200)] + [b"".join(r.choice(tokens) for _ in range(9)).decode("utf-8", "ignore") for _ in range(400)] + ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1500), r.randint(0x4E00, 0x9FFF), 0x1F600])) for _ in range(30)) for _ in range(200)]
    for x in texts:
        ids = c.encode(x).tolist()
        assert ids == plain.encode_ordinary(x)
        assert b"".join(c.decode(ids)).decode() == x
    rows = corpus(9)
    got = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.round_trip(frame(spark, rows), path, P.PATTERN).collect())
    ids = [plain.encode_ordinary(x or "") for _, x in rows]
    assert got == sorted((str(i), len(k), sha(" ".join(map(str, k))), sha(x or "")) for (i, x), k in zip(rows, ids))
    both = bpe.decode(bpe.encode(frame(spark, rows), path, P.PATTERN), path, P.PATTERN)
    assert sorted((str(x.doc_id), bytes(x.data).decode()) for x in both.collect()) == sorted((str(i), x or "") for i, x in rows)
    assert bpe.round_trip(frame(spark, []), path, P.PATTERN).count() == 0


def test_bpe_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_ARCS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    path = P.path("byte_bpe_50k.tiktoken")
    small, whole = bpe.Codec(bpe.load_ranks(path), P.PATTERN), bpe.codec(path, P.PATTERN)
    for x in ("strengthening notwithstanding " * 5, "abcdefghijklmnopqrstuvwxyz" * 20, "ñandúes über-größen"):
        assert small.encode(x).tolist() == whole.encode(x).tolist()


def test_utf8_stream():
    data = "aé€🙂z".encode()
    for size in (1, 2, 3):
        s = bpe.Utf8Stream()
        parts = [s.feed(data[k : k + size]) for k in range(0, len(data), size)] + [s.close()]
        assert b"".join(parts) == data and all(p.decode() or True for p in parts)


def test_language_id(spark):
    r = random.Random(6)
    kinds = {"xx": "an the of ing tion er".split(), "yy": "el os ción que ara".split(), "zz": "ung sch ein keit ber".split()}
    text = lambda parts, k: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(k))
    rows = [(k, text(p, r.randint(20, 80)), name) for k, (name, p) in enumerate(list(kinds.items()) * 60)]
    rows += [(1000, None, "xx"), (1001, "12 34 ...", "xx"), (1002, "", None), (1003, "½ Ⅷ ٣ \u0301", None), (None, text(kinds["yy"], 50), None), (5, rows[5][1], "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language_id.language_id(d).collect()}
    import zlib

    for i, _, name in rows[:180]:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert not out[i].held_out or out[i].lang_pred == name
        assert 0 <= out[i].score <= 1
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 4 and out[None].lang_pred == "yy"
    empty = spark.createDataFrame([], d.schema)
    assert language_id.language_id(empty).count() == 0
    unlearned = language_id.language_id(d.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in unlearned.collect()} == {"und"}


def test_document_vectors_by_definition():
    v, n = language_id.document_vectors(["Ab c!", "", "ab"])
    want = np.zeros(language_id.DIM)
    s = " ab c "
    for k in range(len(s) - 2):
        a, b, c = (language_id.letter_vector(ord(x)).astype(int) for x in s[k : k + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert (v[0] == want).all() and n.tolist() == [4, 0, 2]


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_url_filter(spark):
    urls = ["http://A.Example.COM/en/x?q", "https://www.example.com/en/1", "http://b.com", "http://b.com/", "http://xcom/en/", "ftp://q.net/es/#a", "nonsense", None, "", "://", "http://h?x/y", "http://" + "a" * 3000 + "/z"]
    rows = [(k, u, "x") for k, u in enumerate(urls)] + [(90, urls[0], "x"), (90, urls[0], "x"), (None, urls[1], "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, code string")
    out = {}
    for x in url_filter.url_filter(d, RULES).collect():
        out.setdefault(x.page_id, []).append(x)
    assert sum(map(len, out.values())) == len(rows) and len(out[90]) == 2
    rule = {k: (out[k][0].host, out[k][0].path, out[k][0].rule) for k in range(len(urls))}
    assert rule[0] == ("a.example.com", "/en/x", "example.com/en/") and rule[1] == ("www.example.com", "/en/1", "www.example.com/en/")
    assert rule[2] == ("b.com", "", None) and rule[3] == ("b.com", "/", "com/") and rule[4] == ("xcom", "/en/", None)
    assert rule[5] == ("q.net", "/es/", "net/es/") and rule[6] == rule[7] == rule[8] == rule[9] == ("", "", None) and rule[10] == ("h", "", None)
    assert out[0][0].verdict == "block" and out[1][0].verdict == "allow" and all(x.verdict in ("allow", "block") for k in out.values() for x in k)
    assert url_filter.url_filter(d.limit(0), RULES).count() == 0


def test_url_models(spark):
    """The models' table against the definition, and what they tell apart."""
    good, bad = ["http://news.org/en/story", "http://news.org/de/item"] * 30, ["http://win.org/casino/bet", "http://win.org/slots"] * 30
    rows = [(k, u) for k, u in enumerate([u.replace("http://", f"http://a{k}.com/") for k, u in enumerate(good)] + [u.replace("http://", f"http://b{k}.net/es/") for k, u in enumerate(bad)] + ["http://x.info/en/story/item", "http://x.info/casino/slots/bet"])]
    d = spark.createDataFrame(rows, "page_id long, url string")
    out = {x.page_id: x for x in url_filter.url_filter(d, RULES).collect()}
    assert out[120].verdict == "allow" and out[121].verdict == "block" and out[120].score > out[121].score
    grams = spark.createDataFrame([(u, g) for u, g in zip(good[:4] + bad[:4], [True] * 4 + [False] * 4)], "__u string, good boolean").select(F.explode(url_filter.gram_codes(F.col("__u"))).alias("code"), "good")
    rows = grams.collect()
    table = {x.code: x.r for x in url_filter.markov_model(grams).filter(F.col("code").isin([x.code for x in rows])).collect()}
    s = url_filter.SYMBOLS

    def p(code, own):
        out = 1 / s
        for n in range(1, url_filter.ORDER + 2):
            gram, context = code % s**n, code % s**n // s
            mine = [c % s**n for c in own if c % s**n // s == context]
            if mine:
                out = (mine.count(gram) + len(set(mine)) * out) / (len(mine) + len(set(mine)))
        return out

    sides = [[x.code for x in rows if x.good == g] for g in (True, False)]
    for code in table:
        assert table[code] == pytest.approx(np.log(p(code, sides[0])) - np.log(p(code, sides[1])))


def test_fingerprints(spark):
    rows = [(i, x) for i, x in corpus(10) if i not in (None, 9)] + [(5000, "z " * 20000), (5001, None)]
    rows = list({i: (i, x) for i, x in rows}.values())
    out = {r.doc_id: r for r in fingerprint.compare(frame(spark, rows)).collect()}
    ids = sorted(i for i, _ in rows)
    texts = {i: x or "" for i, x in rows}
    same = {}
    for k, i in enumerate(ids):
        x, y = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert out[i].n_chars == len(x) and out[i].edited_sha256 == sha(edited)
        assert same.setdefault(x, out[i].fingerprint) == out[i].fingerprint
        sets = []
        for t in (x, edited, y):
            digest, _ = fingerprint.paragraphs([t.encode()])
            sets.append(set(digest.tolist()))
        for got, other in ((out[i].near_edited, sets[1]), (out[i].near_next, sets[2])):
            both = sets[0] | other
            assert got == pytest.approx(len(sets[0] & other) / len(both) if both else 1.0)
    assert len(set(same.values())) == len(same)
    assert fingerprint.compare(frame(spark, [])).count() == 0
    one = fingerprint.compare(frame(spark, [(1, "a b c d")])).first()
    assert one.near_next == 1.0
    assert fingerprint.compare(frame(spark, corpus(11))).count() == len(corpus(11))


@pytest.mark.parametrize("start", ["It ", "De ", "a ", " ", "  ", "\n", ""])
def test_paragraphs_of_equal_texts_are_equal(start):
    """Whatever text stands before one, even an empty one."""
    text = f"{start}was the first word of a text\nand a line".encode()
    alone = fingerprint.paragraphs([text])[0].tolist()
    r = random.Random(8)
    for _ in range(60):
        digest, whose = fingerprint.paragraphs([r.randbytes(r.randint(1, 5)), b"", text, r.randbytes(3)])
        assert digest[whose == 2].tolist() == alone


def test_sketches_recover_differences():
    r = np.random.default_rng(7)
    a = r.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:490], r.integers(0, 2**63, 5, dtype=np.uint64)])
    one, two = fingerprint.Sketches(1, 60), fingerprint.Sketches(1, 60)
    one.add(a, np.zeros(500, np.int64))
    two.add(b, np.zeros(495, np.int64))
    digest, _, sign, whole = one.minus(two).peel()
    assert whole.all() and set(digest[sign > 0].tolist()) == set(a[490:].tolist()) and set(digest[sign < 0].tolist()) == set(b[490:].tolist())


def test_spans_and_packing_of_records():
    s, e = repeats.spans(20, np.array([5, 0, 7, 18]), np.array([3, 2, 4, 9]))
    assert s.tolist() == [0, 5, 18] and e.tolist() == [2, 11, 20]
    ids, keys, whose = np.array([10, 20, 30]), np.array([1, 2, 3]), np.array([0, 0, 2, 2, 2])
    a, part = np.arange(5, dtype="<u4") * 70000, np.array([1, 0, 1, 1, 0])
    blobs = dict(repeats.packed(ids, keys, whose, part, [a], ["u4"], 2))
    i, h, (x,) = repeats.unpacked([blobs[1], blobs[0]], ["u4"])
    assert list(zip(i.tolist(), h.tolist(), x.tolist())) == [(10, 1, 0), (30, 3, 140000), (30, 3, 210000), (10, 1, 70000), (30, 3, 280000)]


def test_special_tokens_are_text_in_any_other_case():
    t = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    assert t.by_words
    texts = ["A<|ENDOFTEXT|>b", "a<|endoftext|>b <|startoftext|> c", "<|End of", "x <|EndOfText|> Ärger", "plain text's here, <b>"]
    assert [x.tolist() for x in t(texts)] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_language_vectors_of_many_letters_are_bounded():
    """Different n-grams by the hundred thousand are bound a few at a time."""
    import tracemalloc

    r = random.Random(8)
    text = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300_000))
    tracemalloc.start()
    v, n = language_id.document_vectors([text, "ab"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [300_000, 2] and peak < 300_000_000
    small, _ = language_id.document_vectors([text[:500]])
    whole = sum(np.roll(language_id.letter_vector(ord(a)), 2) * np.roll(language_id.letter_vector(ord(b)), 1) * language_id.letter_vector(ord(c)) for a, b, c in zip(" " + text[:500], text[:500] + " ", text[1:500] + " "))
    assert (small[0] == whole).all()


def test_language_is_learned_from_a_bounded_number(spark):
    rows = [(k, f"alpha beta {k % 70} gamma", "en") for k in range(400)] + [(1001, "same row", "de")] * 300 + [(2000, "delta", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, v = language_id.fit(d, per_lang=50)
    assert langs == ["de", "en"]
    same = language_id.fit(d.repartition(5), per_lang=50)
    assert same[0] == langs and np.allclose(same[1], v)


def test_word_blocks_keep_hashes_and_not_words():
    import tracemalloc

    import pyarrow as pa

    from metaweave.llm import fingerprint, substring_dedup

    texts = [" ".join(f"w{k}x{n}" for n in range(5000)) for k in range(40)] + ["few words", ""]
    n = 40 * 5000
    batch = pa.RecordBatch.from_pydict({"t": texts})
    fingerprint.powers(2 * n)
    tracemalloc.start()
    try:
        made = substring_dedup.word_blocks(iter([batch]), 50)
        b, own = next(made)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert next(made, None) is None and b.num_rows == 42 and own.lengths.tolist() == [5000] * 40 + [0, 0]
    assert held < 16 * n and peak < 64 * n, (held / n, peak / n)
    start, whose = own.starts(25)
    assert len(np.unique(own.hashes(start, start + 25))) == len(start) == 40 * 4976 and whose[-1] == 39
