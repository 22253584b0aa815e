"""Near duplicates by MinHash signatures: a multi-index Hamming join proposes pairs, whole sets of shingles confirm them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, key_columns, null_flag, partitions, real_id, release
from .components import Forest, components
from .simhash import similar_links, split_buckets, whole_runs

SEED = 42
#: A signature has CHUNKS chunks of SLOTS numbers of 16 bits. Two with at most RADIUS different numbers have, by pigeonhole, a chunk with at
#: most ERRORS different ones. Sets of similarity 0.8 differ in a fifth of the numbers: in over RADIUS of them in about 3 of a million cases.
CHUNKS, SLOTS, ERRORS = 12, 4, 1
SIZE = CHUNKS * SLOTS
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Bits of the filter that tells which documents have a proposed partner, whatever their number: 8 MB.
FILTER_BITS = 1 << 26
#: Different words whose hashes a task remembers.
WORDS = 500_000
#: Text of a block whose shingles are hashed at once.
CHARS = 1_000_000


class WordHashes(dict):
    """Hashes of words, made when asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int, known: WordHashes) -> np.ndarray:
    """The hashes of the different runs of so many words (of lower-cased A-Z), in order; with fewer words that of all of them, with none nothing."""
    split = text.lower().split() if text else []
    h = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def draws() -> np.ndarray:
    """For each number of a signature two that make a random order of hashes."""
    return np.random.default_rng(SEED).integers(0, 2**64, (SIZE, 2), dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SIZE) numbers of 16 bits: of each order what is left of the least hash. The sets aren't empty."""
    out = np.zeros((len(sets), SIZE), np.uint16)
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    for k, (own, by) in enumerate(draws()):
        out[:, k] = mixed(np.minimum.reduceat((flat ^ own) * (by | np.uint64(1)), starts)) >> np.uint64(48)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(n, keys): for each chunk and each choice of ERRORS of its places one key of the others, exact: 48 bits of numbers and which choice it is."""
    keys = []
    for chunk in range(CHUNKS):
        for wrong in itertools.combinations(range(SLOTS), ERRORS):
            key = np.full(len(sig), len(keys), np.int64)
            for place in range(SLOTS):
                if place not in wrong:
                    key = (key << 16) | sig[:, chunk * SLOTS + place]
            keys.append(key)
    return np.stack(keys, axis=1)


def near_links(sig: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of places whose signatures differ in at most radius numbers, as few as link what all such pairs would.

    First some are asked what they reach; then all outside the largest part, so every pair not known to hang together is compared.
    """
    n, forest, out = len(sig), Forest(len(sig)), []
    label = forest.labels()

    def ask(q: int) -> None:
        at = np.flatnonzero((sig != sig[q]).sum(axis=1) <= radius)
        for x in at[np.unique(label[at], return_index=True)[1]].tolist():
            if forest.join(x, q):
                out.append((max(x, q), min(x, q)))

    for _ in range(8):
        largest = np.bincount(label).argmax()
        rest = np.flatnonzero(label != largest) if len(out) else np.arange(n)
        if not len(rest):
            return np.array(out, np.int64).reshape(-1, 2)
        ask(int(rest[0]))
        label = forest.labels()
    largest = np.bincount(label).argmax()
    for q in np.flatnonzero(label != largest).tolist():
        ask(q)
        label = forest.labels() if len(out) else label
    return np.array(out, np.int64).reshape(-1, 2)


def signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """i, h (the key of the row), n (the size of its set), g0, g1 (the set's hash) and sig (bytes; null without words)."""
    i, h = key_columns(id_col, text_col)
    d = docs.select(i.alias("i"), h.alias("h"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in blocks(batches, "t", CHARS):
            sets = [shingle_set(t, words, known) for t in b.column("t").cast(pa.binary()).to_pylist()]
            some = [k for k, x in enumerate(sets) if len(x)]
            sig = signatures([sets[k] for k in some]) if some else []
            raw: list[bytes | None] = [None] * len(sets)
            for k, s in zip(some, sig):
                raw[k] = s.tobytes()
            g = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets), np.int64).reshape(-1, 2)
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), *columns], ["i", "h", "n", "g0", "g1", "sig"])

    return d.mapInArrow(run, "i long, h long, n long, g0 long, g1 long, sig binary")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIZE)


def keyed(kinds: DataFrame) -> DataFrame:
    """kinds: m and sig. A row key, m for each of a signature's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = chunk_keys(matrix(b.column("sig")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column("m").to_numpy(), keys.shape[1]))], ["key", "m"])

    return kinds.select("m", "sig").mapInArrow(run, "key long, m long")


def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key those that aren't alone with theirs; no more than a batch is held."""
    held: pa.RecordBatch | None = None
    before = None
    for b in itertools.chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        if held is not None:
            key = held.column("key").to_numpy()
            after = None if b is None else b.column("key")[0].as_py()
            same = key[1:] == key[:-1]
            left, right = np.append(before == key[0], same), np.append(same, after == key[-1])
            before = int(key[-1])
            yield held.filter(pa.array(left | right))
        held = b


def proposals(kinds: DataFrame) -> DataFrame:
    """kinds: m and sig, a row for each different set. Pairs u, v of values m, as few as link all whose signatures differ in at most RADIUS numbers."""
    n = partitions(kinds.sparkSession)
    d = split_buckets(keyed(kinds), kinds.count()).repartition(n, "key").sortWithinPartitions("key").mapInArrow(crowded, "key long, m long")
    d = Table(d).read().join(kinds.select("m", "sig"), "m").repartition(n, "key").sortWithinPartitions("key", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "key"):
            key, m, sig = t.column("key").to_numpy(), t.column("m").to_numpy(), matrix(t.column("sig"))
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
            found = [near_links(sig[a:b]) + a for a, b in zip(edges, edges[1:]) if b - a > 1]
            if found:
                p = np.unique(m[np.concatenate(found)], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["u", "v"])

    return d.mapInArrow(run, "u long, v long").distinct()


def filter_place() -> Column:
    return F.pmod(F.xxhash64("i", "h"), F.lit(FILTER_BITS))


def asked_sets(docs: DataFrame, keys: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """m and s (hashes of 8 bytes, in order) of the rows of docs whose key (i, h, m) is asked for.

    A filter of FILTER_BITS bits goes to every task, so that only what may be asked for is sent, as hashes; texts don't move.
    """
    place = keys.select(filter_place().alias("b")).groupBy((F.col("b") / F.lit(32768)).cast("int").alias("w")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits"))
    have = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in place.collect():
        have[4096 * r.w : 4096 * (r.w + 1)] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(have)
    i, h = key_columns(id_col, text_col)
    d = docs.select(i.alias("i"), h.alias("h"), F.col(f"`{text_col}`").alias("t")).withColumn("b", filter_place())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), shared.value
        for b in batches:
            at = b.column("b").to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for some in blocks([b], "t", CHARS):
                own = [shingle_set(t, words, known).tobytes() for t in some.column("t").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("i"), some.column("h"), pa.array(own, pa.binary())], ["i", "h", "s"])

    sets = d.mapInArrow(run, "i long, h long, s binary").groupBy("i", "h").agg(F.first("s").alias("s"))
    return sets.join(keys, ["i", "h"]).select("m", "s")


def minhash_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to, its own included) and kept (whether that is the row's id) of each row.

    Sets of different shingles link if they are that similar (at least 0.8: the signatures' keys are made for it). Rows of one set are one
    node, counted before they are shuffled. Signatures that differ in few numbers share a key; a key's signatures are compared, and as few pairs leave it as link them.
    Whole sets of all that hangs together so are judged in blocks, so only similar sets unite. Rows without a word have no shingles
    and link with nothing, not even each other. Ids may repeat or be null (null comes last, and kept compares null with null); rows that repeat give a row
    each. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = Table(signed(docs, words, id_col, text_col)).read()
    by = ["g0", "g1", "n"]
    kinds = rows.filter("n > 0").groupBy(*by).agg(F.min(F.struct("i", null_flag(F.col("h")).alias("null"))).alias("least"), F.min(F.struct("i", "h")).alias("row"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    kinds = Table(kinds.withColumn("m", F.monotonically_increasing_id())).read()
    proposed = Table(proposals(kinds)).read()
    asked = proposed.select(F.col("u").alias("m")).union(proposed.select(F.col("v").alias("m"))).distinct()
    keys = Table(kinds.join(asked, "m").select("row.i", "row.h", "m")).read()
    sets = Table(asked_sets(docs, keys, words, id_col, text_col)).read()
    linked = components(Table(similar_links(proposed, sets, similarity)).read())
    kinds = kinds.join(linked.select(F.col("u").alias("m"), F.col("v").alias("r")), "m", "left").withColumn("r", F.coalesce("r", "m"))
    least = kinds.groupBy("r").agg(F.min("least").alias("first"))
    # a row that is alone in every sense needs no name
    named = Table(kinds.join(least, "r").filter("rows > 1 OR first <> least").select(*by, "first")).read()
    release(spark)
    null = null_flag(F.col("h"))
    own, first = real_id(F.col("i"), null), F.when(F.col("first").isNull(), real_id(F.col("i"), null)).otherwise(real_id(F.col("first.i"), F.col("first.null")))
    d = rows.select("i", "h", *by).join(named, by, "left")
    return d.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), first.alias("component_id"), own.eqNullSafe(first).alias("kept"))
