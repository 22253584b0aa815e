"""Near duplicates by SimHash, compared in bit planes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, key_columns, null_flag, partitions, real_id, release
from .components import Forest, components

SEED = 42
#: Fingerprints compared with a block of others at once, and of such a block.
QUERIES, LANES = 64, 4096
#: Without a similarity: bits are cut so that a bucket holds about so many fingerprints at most.
BUCKET = 4096
#: With a similarity: fingerprints of WIDE bits within WIDE_RADIUS hang together, in buckets of texts whose shingles have the same
#: least hash in ROWS random orders; there are TABLES such draws. Pairs of similarity 0.8 differ in about 0.15 of the bits, one in
#: a thousand in more than the radius; they share no bucket in (1 - 0.8 ** ROWS) ** TABLES, or 1 in 100 000, of cases.
WIDE, WIDE_RADIUS, ROWS, TABLES = 128, 32, 3, 16
#: A bucket of more fingerprints is cut into blocks, of which each two meet in a task.
SPLIT = 100_000
#: Texts of a block that is judged by sets of shingles, and shingles in it, about.
JUDGED, SHINGLES = 1024, 1_000_000


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of so many words (of lower-cased A-Z), repeats included, as one space joins them; of fewer words all, of none none."""
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if len(split) <= words:
        return [b" ".join(split)] if split else []
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(split) - words] + 1]).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(grams: list[bytes], width: int = 64) -> list[int]:
    """width / 64 unsigned numbers: a bit is 1 if it is in over half the shingles' hashes."""
    if not grams:
        return [0] * (width // 64)
    digest = b"".join([xxhash.xxh64_digest(g, SEED) if width == 64 else xxhash.xxh3_128_digest(g, SEED) for g in grams])
    ones = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(len(grams), width // 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int(x) for x in np.packbits(2 * ones > len(grams)).view(">u8")]


def draws(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """TABLES numbers for each text (of sizes[k] >= 1 hashes): each follows from the least of its hashes in ROWS random orders."""
    rng = np.random.default_rng(SEED)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), TABLES), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            key = np.full(len(sizes), t, np.uint64)
            for _ in range(ROWS):
                by, mixed = rng.integers(0, 2**63, 2, dtype=np.uint64) | np.uint64(1)
                key = (key ^ np.minimum.reduceat(hashes * by, starts)) * mixed
                key ^= key >> np.uint64(29)
            out[:, t] = key
    return out


def prefixes(sets: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Of each set of hashes (in order) so many of the least that sets that similar share one: the surest buckets, and the most."""
    return [x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1] for x in sets]


def fingerprints(docs: DataFrame, words: int, width: int, id_col: str, text_col: str, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """i, h (the key of the row) and f0, f1, ...: 64 bits each, as signed numbers. With a similarity, a shingle counts once,
    however often it occurs, and keys holds the row's buckets: those of draws(), or with exact of prefixes()."""
    i, h = key_columns(id_col, text_col)
    d = docs.select(i.alias("i"), h.alias("h"), F.col(f"`{text_col}`").alias("t"))
    names = [f"f{k}" for k in range(width // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t"):
            grams = [shingles(t or "", words) for t in b.column("t").to_pylist()]
            if similarity is not None:
                grams = [list(set(g)) for g in grams]
            f = np.array([fingerprint(g, width) for g in grams], np.uint64).view(np.int64)
            columns = [b.column("i"), b.column("h"), *[pa.array(x) for x in f.T]]
            if similarity is not None:
                # a text without words is a set of its own kind
                sets = [np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams_], np.uint64)) if grams_ else np.zeros(1, np.uint64) for grams_ in grams]
                sizes = np.array([len(x) for x in sets], np.int64)
                keys = prefixes(sets, similarity) if exact else draws(np.concatenate(sets), sizes)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["i", "h", *names, *(["keys"] if similarity is not None else [])])

    return d.mapInArrow(run, "i long, h long, " + ", ".join(f"{n} long" for n in names) + (", keys array<long>" if similarity is not None else ""))


class Planes:
    """Fingerprints as bit planes: word w of plane b holds bit b of fingerprints 64 w to 64 w + 63."""

    def __init__(self, f: np.ndarray):
        """f: (n, width / 64) unsigned."""
        self.n, self.width = len(f), 64 * f.shape[1]
        bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(self.n, self.width // 8), axis=1)
        padded = np.zeros((-(-self.n // 64) * 64, self.width), np.uint8)
        padded[: self.n] = bits
        self.bits = bits.astype(bool)
        self.planes = np.ascontiguousarray(np.packbits(padded.T, axis=1)).view(np.uint64)

    def within(self, queries: np.ndarray, radius: int, lanes: slice) -> np.ndarray:
        """Which fingerprints of lanes (in whole words) differ from each query in at most radius bits: one column each.

        The distances of 64 fingerprints lie across the bits of some words, one word for each binary digit; a
        plane's differences are added to all of them by carries. When all distances exceed the radius, it ends.
        """
        planes, asked = self.planes[:, lanes], self.bits[queries]
        digits = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros_like(digits[0]) if digits else np.zeros((len(queries), planes.shape[1]), np.uint64)
        whole = np.uint64(0xFFFFFFFFFFFFFFFF)
        for b in range(self.width):
            carry = planes[b] ^ np.where(asked[:, b], whole, np.uint64(0))[:, None]
            for d in digits:
                d ^= carry
                carry &= ~d  # a digit that went from 1 to 0 carries
            over |= carry
            if b % 16 == 15 and b > 2 * radius and (over == whole).all():
                break
        more, same = np.zeros_like(over), np.full_like(over, whole)
        for k in reversed(range(len(digits))):
            if radius >> k & 1:
                same &= digits[k]
            else:
                more |= same & digits[k]
                same &= ~digits[k]
        near = ~(over | more)
        return np.unpackbits(near.view(np.uint8).reshape(len(queries), -1), axis=1).astype(bool)


def links_within(f: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of places in f within radius, as few as link what all such pairs would.

    First some are asked which others they reach: what one reaches hangs together. Then all that don't hang together with the
    largest part are asked, so that every pair not known to hang together is compared.
    """
    n, planes = len(f), Planes(f)
    words = planes.planes.shape[1]
    forest, out = Forest(n), []

    def ask(queries: np.ndarray) -> None:
        label = forest.labels()
        for w in range(0, words, LANES // 64):
            base = 64 * w
            hits = planes.within(queries, radius, slice(w, w + LANES // 64))
            hits[:, max(0, n - base) :] = False
            for k in np.flatnonzero(hits.any(axis=1)).tolist():
                at, q = base + np.flatnonzero(hits[k]), int(queries[k])
                for x in at[np.unique(label[at], return_index=True)[1]].tolist():
                    if forest.join(x, q):
                        out.append((q, x))

    alone = np.ones(n, bool)
    if n > QUERIES:
        for _ in range(8):
            first = np.flatnonzero(alone)[:1]
            if len(first):
                ask(first)
                label = forest.labels()
                alone &= label != label[first]
    label = forest.labels()
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    for a in range(0, len(rest), QUERIES):
        ask(rest[a : a + QUERIES])
    return np.array(sorted(out), np.int64).reshape(-1, 2)


def bucket_keys(width: int, n: int, radius: int, columns: list[str]) -> Column:
    """An array of keys, such that fingerprints within the radius share one.

    Of c + radius blocks of bits, some c are alike in such a pair, so there is a key for each choice of c
    blocks. c grows with n, so that buckets don't.
    """
    c = 1
    while n >> (width * c // (c + radius)) > BUCKET and c < 5:
        c += 1
    edges = [round(k * width / (c + radius)) for k in range(c + radius + 1)]
    keys = []
    for number, some in enumerate(itertools.combinations(range(c + radius), c)):
        bits = [b for k in some for b in range(edges[k], edges[k + 1])]
        masks = [sum(1 << (b % 64) for b in bits if b // 64 == k) for k in range(width // 64)]
        masks = [m - 2**64 if m >= 2**63 else m for m in masks]
        keys.append(F.xxhash64(F.lit(number), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(columns, masks) if m]))
    return F.array(*keys)


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows again, in tables that end where a run of equal values of a sorted column does."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(column).to_numpy()
        cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if held and (cut or held[-1].column(column)[-1].as_py() != int(key[0])):
            if cut:
                held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def split_buckets(keyed: DataFrame, n: int, most: int = SPLIT) -> DataFrame:
    """keyed (key, m, ...), where a bucket of more than most rows is cut into blocks by hash: each two of its blocks are a bucket."""
    if n <= most:  # a row is in a bucket once
        return keyed
    large = Table(keyed.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)).read()
    few = large.count()
    if not few:
        return keyed
    d = keyed.join(F.broadcast(large) if few <= most else large, "key", "left")
    blocks_ = F.ceil(F.coalesce(F.col("rows"), F.lit(1)) / most)
    own = F.pmod(F.xxhash64("m"), blocks_)
    d = d.withColumn("b", own).withColumn("c", F.explode(F.when(F.col("rows").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks_ - 1))))
    return d.withColumn("key", F.when(F.col("c") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c")))).drop("rows", "b", "c")


def links(kinds: DataFrame, keys: Column, n: int, columns: list[str], radius: int | None) -> DataFrame:
    """kinds: m and fingerprint columns, n rows, one for each different fingerprint. Pairs u, v of values m that share one of the keys, as
    few as link all within the radius (with None all of a bucket)."""
    keyed = split_buckets(kinds.select(F.explode(keys).alias("key"), "m", *columns).distinct(), n)
    keyed = keyed.repartition(partitions(kinds.sparkSession), "key").sortWithinPartitions("key", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "key"):
            key, m = t.column("key").to_numpy(), t.column("m").to_numpy()
            f = np.stack([t.column(c).to_numpy() for c in columns], axis=1).view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            out = []
            for k in np.flatnonzero(np.diff(edges) > 1).tolist():
                a, b = int(edges[k]), int(edges[k + 1])
                if radius is None:
                    out.append(np.stack([np.arange(a + 1, b), np.full(b - a - 1, a)], axis=1))
                elif b - a > 2:
                    out.append(links_within(f[a:b], radius) + a)
                elif np.bitwise_count(f[a] ^ f[a + 1]).sum() <= radius:
                    out.append(np.array([[a + 1, a]]))
            if out:
                p = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(m[p[:, 0]], m[p[:, 1]])), pa.array(np.minimum(m[p[:, 0]], m[p[:, 1]]))], ["u", "v"])

    return keyed.mapInArrow(run, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """m and s: the hashes of the different shingles, in order, 8 bytes each."""
    d = docs.select("m", F.col(f"`{text_col}`").alias("t"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t"):
            own = [np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in shingles(t or "", words)], np.uint64)).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("m"), pa.array(own, pa.binary())], ["m", "s"])

    return d.mapInArrow(sets, "m long, s binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share. Members of many sets go through products of matrices, a thousand at a time, those of few through their pairs."""
    n = len(sets)
    whose = np.repeat(np.arange(n), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, whose = flat[order], whose[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    run = np.diff(np.append(start, len(flat)))
    code, size = np.repeat(np.arange(len(run)), run), np.repeat(run, run)
    few = max(2, n // 32)
    pairs, rare = np.zeros(n * n, np.float32), (size > 1) & (size <= few)
    c, w = code[rare], whose[rare]
    for d in range(1, few):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        pairs += np.bincount(w[same] * n + w[same + d], minlength=n * n).astype(np.float32)
    out = pairs.reshape(n, n)
    out = out + out.T
    c, w = code[size > few], whose[size > few]
    if len(c):
        c = np.unique(c, return_inverse=True)[1]
        for a in range(0, int(c[-1]) + 1, 1024):
            x, y = np.searchsorted(c, [a, a + 1024])
            has = np.zeros((n, 1024), np.float32)
            has[w[x:y], c[x:y] - a] = 1
            out += has @ has.T
    return out


def judged_links(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places whose sets are that similar, as few as unite what all such pairs would. Places of one label are united already."""
    sizes = np.array([len(x) for x in sets], np.float64)
    shared = shared_counts(sets)
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    near &= label[:, None] != label[None, :]
    out, left = [], near.any(axis=1)
    while left.any():
        front = np.flatnonzero(left)[:1]
        left[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(axis=0) & left)
            out += zip(new.tolist(), front[near[np.ix_(front, new)].argmax(axis=0)].tolist())
            left[new] = False
            front = new
    return out


def judged(parts: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """parts: m, r, and x and y, blocks that m's row goes to. Links u, v of values m whose sets of shingles (made: m, s) are that similar,
    for all pairs that meet in two blocks and differ in r; as few as unite all."""
    d = parts.select("m", "r", F.xxhash64("p", "x", "y").alias("key")).join(made, "m")
    d = d.repartition(partitions(d.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "key"):
            key, m, r = (t.column(c).to_numpy() for c in ("key", "m", "r"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found += [(x + a, y + a) for x, y in judged_links(sets[a:b], r[a:b], similarity)]
            if found:
                p = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m[p[:, 0]]), pa.array(m[p[:, 1]])], ["u", "v"])

    return d.mapInArrow(run, "u long, v long")


def similar_links(proposed: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """Links u, v that unite all pairs of sets (made: m, s) that similar, within each group that hangs together by the proposed pairs.

    A group is cut into blocks, and its first block judged with each of the others (a group of one block by itself). Mostly that
    unites nearly all of it. Then every text outside the largest part is judged with all others, so every pair is judged
    or united. What is sent grows with the group's size times the number of blocks outside that part. A judged pair is one of texts,
    never of copies; no group is held whole by a task.
    """
    spark = proposed.sparkSession
    group = components(proposed)
    member = group.select(F.col("u").alias("m"), F.col("v").alias("p")).union(group.select("v", "v").distinct())
    member = Table(member.join(made.select("m", (F.length("s") / 8).alias("size")), "m")).read()

    def count(rows: Column) -> Column:
        return F.greatest(F.ceil(F.count(rows) / JUDGED), F.ceil(F.sum(F.when(rows.isNotNull(), F.col("size"))) / SHINGLES), F.lit(0))

    sizes = member.groupBy("p").agg(count(F.col("m")).alias("n"))
    d = member.join(sizes, "p").withColumn("b", F.pmod(F.xxhash64("m"), "n"))
    d = d.withColumn("y", F.explode(F.when(F.col("b") == 0, F.sequence(F.least(F.lit(1), F.col("n") - 1), F.col("n") - 1)).otherwise(F.array("b"))))
    first = components(Table(judged(d.select("p", F.lit(0).alias("x"), "y", "m", F.col("m").alias("r")), made, similarity)).read())
    rest = member.join(sizes.filter("n > 1"), "p").join(first.select(F.col("u").alias("m"), F.col("v").alias("r")), "m", "left").withColumn("r", F.coalesce("r", "m"))
    rest = Table(rest).read()
    core = rest.groupBy("p", "r").agg(F.count("*").alias("c")).groupBy("p").agg(F.max_by("r", F.struct("c", "r")).alias("core"))
    outside = F.when(F.col("r") != F.col("core"), F.col("m"))
    rest = rest.drop("n").join(core, "p")
    sizes = rest.groupBy("p").agg(count(F.when(F.col("r") == F.col("core"), F.col("m"))).alias("n"), count(outside).alias("o")).filter("o > 0")
    d = rest.join(sizes, "p").withColumn("out", outside.isNotNull())
    d = d.withColumn("b", F.when(F.col("out"), F.col("n") + F.pmod(F.xxhash64("m"), "o")).otherwise(F.pmod(F.xxhash64("m"), "n")))
    d = d.withColumn("c", F.explode(F.sequence(F.when(F.col("out"), F.lit(0)).otherwise(F.col("n")), F.col("n") + F.col("o") - 1)))
    more = judged(d.select("p", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"), "m", "r"), made, similarity)
    return first.union(Table(more).read())


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float | None = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """i (the id; the largest number for null), h (hash of the text), f0 (, f1) (fingerprint), component (the smallest i linked with the row's), null (1 if that is of rows without an id only),
    group (a number of the component, which tells components apart even where ids repeat).

    With similarity None, 64-bit fingerprints link within radius, and no such link is lost. With a similarity, 128-bit fingerprints
    of the different shingles within WIDE_RADIUS hang together, in buckets of texts that share the least hashes of their shingles; of
    what hangs together all pairs of sets of shingles are judged (or known to be united), and link if they are that similar. So a pair is
    lost only if no chain of neighbours within the radius leads from one to the other: one in some hundred pairs of similarity just
    0.8 that have no other neighbours. With exact no pair is lost: texts hang together if they share a shingle among so many of the least
    ones that similar texts must; that makes groups of all texts that share a passage, and more work.

    Rows of one fingerprint are one node (with a similarity: rows of one text), counted before any
    shuffle; so copies are never paired. A bucket's fingerprints are compared in blocks, and only as many pairs
    leave it as link its members. Null and empty texts have fingerprint 0 and link like any other. Ids may repeat
    or be null; rows that repeat give a row each. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    width = 64 if similarity is None else WIDE
    columns = [f"f{k}" for k in range(width // 64)]
    rows = Table(fingerprints(docs, words, width, id_col, text_col, similarity, exact)).read()
    if similarity is None:
        by = columns
        kinds = Table(rows.groupBy(*by).agg(F.min("i").alias("i"), F.min(null_flag(F.col("h"))).alias("null")).withColumn("m", F.monotonically_increasing_id())).read()
        n = kinds.count()
        joined = Table(links(kinds, bucket_keys(width, n, radius, columns), n, columns, radius)).read()
    else:
        by = [*columns, "h"]
        kinds = Table(rows.groupBy(*by).agg(F.min("i").alias("i"), F.min(null_flag(F.col("h"))).alias("null"), F.first("keys").alias("keys")).withColumn("m", F.monotonically_increasing_id())).read()
        proposed = Table(links(kinds, F.col("keys"), kinds.count(), columns, None if exact else WIDE_RADIUS)).read()
        # one row of each text stands for it
        asked = proposed.select(F.col("u").alias("m")).union(proposed.select(F.col("v").alias("m"))).distinct()
        i, h = key_columns(id_col, text_col)
        key = Table(kinds.join(asked, "m").select(F.col("i").alias("__i"), F.col("h").alias("__h"), "m")).read()
        some = docs.select(i.alias("__i"), h.alias("__h"), F.col(f"`{text_col}`").alias("t")).join(key, ["__i", "__h"]).select("m", "t").dropDuplicates(["m"])
        joined = similar_links(proposed, Table(shingle_sets(some, words, "t")).read(), similarity)
    linked = components(joined)
    kinds = kinds.join(linked.select(F.col("u").alias("m"), F.col("v").alias("r")), "m", "left").withColumn("r", F.coalesce("r", "m"))
    least = kinds.groupBy("r").agg(F.min("i").alias("component"), F.min("null").alias("null"))
    named = Table(kinds.drop("null").join(least, "r").select(*by, "component", "null", "r")).read()
    release(spark)
    return rows.join(named, by).select("i", "h", *columns, "component", "null", F.col("r").alias("group"))


def hex_fingerprint(column: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def kept_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the one with the smallest id (of several such rows, that with the smallest hash of its text)."""
    d = near_duplicates(docs, words, similarity, id_col=id_col, text_col=text_col)
    stay = d.groupBy("group").agg(F.min(F.struct("i", "h")).alias("first")).select("first.*").distinct()
    i, h = key_columns(id_col, text_col)
    out = docs.withColumns({"__i": i, "__h": h}).join(stay.select(F.col("i").alias("__i"), F.col("h").alias("__h")), ["__i", "__h"], "left_semi")
    return out.dropDuplicates(["__i", "__h"]).select([F.col(f"`{c}`") for c in docs.columns])


def document_components(docs: DataFrame, words: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row, linked by distance alone."""
    d = near_duplicates(docs, words, None, radius, id_col, text_col)
    own = real_id(F.col("i"), null_flag(F.col("h")))
    return d.select(own.alias("doc_id"), hex_fingerprint("f0").alias("fingerprint"), real_id(F.col("component"), F.col("null")).alias("component_id"))
