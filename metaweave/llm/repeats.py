"""What the operators on repeated passages share: windows, cells of windows, and the exchange of packed records.

A window is a run of a fixed number of symbols (bytes or words) of one document. Every window has an anchor, a
place in it that its own symbols choose, so equal windows have equal anchors. The windows of one anchor form a
cell: consecutive starts. What is known of whole cells spares a look at their windows:

- no smaller document has the anchor's symbols at an anchor: no window of the cell occurs in one (NONE);
- a smaller document has a cell of the same symbols throughout: all windows of the cell occur in it (ALL);
- else the windows themselves are looked up (OPEN), among those of the smaller documents with that anchor, of
  which one cell for each different string is enough (SOURCE).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_columns, null_flag, partition_keys, partitions
from .fingerprint import mix, powers

NONE, ALL, OPEN, SOURCE = 0, 1, 2, 3


class Hashes:
    """Polynomial hashes modulo 2 ** 64 of runs of symbols."""

    def __init__(self, symbols: np.ndarray):
        with np.errstate(over="ignore"):
            up, self.down = powers(len(symbols) + 1)
            self.sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start], seed)

    def runs(self, length: int, seed: int = 0) -> np.ndarray:
        """Of all runs of this length."""
        n = max(0, len(self.sums) - length)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n], seed)


#: Added to a count of 15 bits: the record is settled, and goes to any part.
SETTLED = 1 << 15


def check_window(window: int) -> None:
    if not 1 <= window < SETTLED:
        raise ValueError(f"a window has from 1 to {SETTLED - 1} symbols")


def settled(g: np.ndarray, u: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document of the same block has the same symbols: such a record is decided before it moves.

    So of what a block of documents repeats one record goes where its hash says, however many have it.
    """
    out = np.zeros(len(g), bool)
    if len(g):
        order = np.lexsort((u, g))
        new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (u[order][1:] != u[order][:-1])])
        edge = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(order))))
        out[order] = doc[order] > least
    return out


def dealt(part: np.ndarray, done: np.ndarray, place: np.ndarray, parts: int) -> np.ndarray:
    """part, but for records that are done: these are spread by their place."""
    with np.errstate(over="ignore"):
        return np.where(done, parts_of(mix(place.astype(np.uint64), 13), parts), part)


def resolve(g: np.ndarray, u: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The state of each cell, from the hash of its anchor's symbols, that of its whole symbols, and its document's place in the order."""
    state = np.zeros(len(g), np.uint8)
    if not len(g):
        return state
    order = np.argsort(g, kind="stable")
    s = g[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    d = doc[order]
    several = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)
    some = order[np.repeat(several, np.diff(np.append(edge, len(s))))]
    if not len(some):
        return state
    some = some[np.lexsort((u[some], g[some]))]
    s, v, d = g[some], u[some], doc[some]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    same = new | np.concatenate([[True], v[1:] != v[:-1]])
    edge, size = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(s)))
    edge2, size2 = np.flatnonzero(same), np.diff(np.append(np.flatnonzero(same), len(s)))
    least = np.repeat(np.minimum.reduceat(d, edge), size)
    least2 = np.repeat(np.minimum.reduceat(d, edge2), size2)
    whole = least2 < d
    open_ = (least < d) & ~whole
    last = np.repeat(np.maximum.reduceat(np.where(open_, d, np.iinfo(np.int64).min), edge), size)
    source = ~open_ & (d == least2) & (d < last)
    state[some] = np.where(whole, ALL, np.where(open_, OPEN, np.where(source, SOURCE, NONE)))
    return state


def ids_differ(docs: DataFrame, id_col: str) -> bool:
    """Whether no id (null counting as one) occurs twice: then the id alone is a row's key. Reads ids only."""
    i, _ = key_columns(id_col, id_col)
    return docs.groupBy(i.alias("i")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def keyed(docs: DataFrame, id_col: str, text_col: str, differ: bool, columns: list[str] | None = None) -> DataFrame:
    """i and h, the key and order of a row (where ids differ h only tells a null id), its text t (null: empty), and a struct `row` of these columns."""
    i, h = key_columns(id_col, text_col)
    h = null_flag(h) if differ else h
    return docs.select(i.alias("i"), h.alias("h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), *([F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []))


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of all numbers, byte after byte: equal bytes lie together, and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :size].T).tobytes()


def _from_planes(b: bytes, at: int, n: int, dtype: str, size: int) -> np.ndarray:
    whole = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    whole[:, :size] = np.frombuffer(b, np.uint8, n * size, at).reshape(size, n).T
    return whole.view(dtype).reshape(n)


#: How many of the low bytes of an array go with its records, by the array's type as named here. Within a part, 56 and 48
#: bits of two hashes tell strings apart as surely as 104 bits do.
KEPT_BYTES = {"hash7": ("<u8", 7), "hash6": ("<u8", 6), "hash8": ("<u8", 8), "u4": ("<u4", 4), "u2": ("<u2", 2), "u1": ("u1", 1)}


def packed(ids: np.ndarray, hashes: np.ndarray, whose: np.ndarray, part: np.ndarray, arrays: list[np.ndarray], kinds: list[str], parts: int) -> Iterator[tuple[int, bytes]]:
    """Records as one string of bytes for each part: the keys of its documents with their counts, then the arrays (of the kinds KEPT_BYTES names), each byte after byte."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        at = order[edges[p] : edges[p + 1]]
        if not len(at):
            continue
        rows, counts = np.unique(whose[at], return_counts=True)  # in order of documents, as the records are
        out = [np.array([len(rows), len(at)], "<i8").tobytes(), *(_planes(x, x.itemsize) for x in (ids[rows].astype("<i8"), hashes[rows].astype("<i8"), counts.astype("<i4")))]
        for a, kind in zip(arrays, kinds):
            dtype, size = KEPT_BYTES[kind]
            out.append(_planes(a[at].astype(dtype, copy=False), size))
        yield p, b"".join(out)


def unpacked(blobs: list[bytes], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids and hashes of each record's document, and the arrays."""
    ids, hashes, arrays = [], [], [[] for _ in kinds]
    for b in blobs:
        rows, n = np.frombuffer(b, "<i8", 2)
        at = 16
        own, keys, counts = _from_planes(b, at, rows, "<i8", 8), _from_planes(b, at + 8 * rows, rows, "<i8", 8), _from_planes(b, at + 16 * rows, rows, "<i4", 4)
        at += 20 * rows
        ids.append(np.repeat(own, counts))
        hashes.append(np.repeat(keys, counts))
        for a, kind in zip(arrays, kinds):
            dtype, size = KEPT_BYTES[kind]
            a.append(_from_planes(b, at, n, dtype, size))
            at += n * size
    return np.concatenate(ids), np.concatenate(hashes), [np.concatenate(a) for a in arrays]


def exchange(df: DataFrame, make: Callable, use: Callable, schema: str) -> DataFrame:
    """make(batches, parts) yields (part, bytes); use(list of the bytes of a part) yields record batches of the schema. Parts grow in number, not in size, with spark.sql.shuffle.partitions."""
    parts = partitions(df.sparkSession)
    keys = partition_keys(df.sparkSession, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in make(batches, parts):
            part, blob = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([keys[p] for p in part], pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob")):
                if part != last and held:
                    yield from use(held)
                    held = []
                last = part
                held.append(blob.as_py())
        if held:
            yield from use(held)

    return df.mapInArrow(send, "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(receive, schema)


def parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def with_marks(docs: DataFrame, marks: DataFrame, columns: list[str], how: str) -> DataFrame:
    """docs (i, h, t) with a list `marks` of structs of the columns (int) that marks has for the row's key."""
    lists = marks.groupBy("i", "h").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    return docs.join(lists.hint("shuffle_merge"), ["i", "h"], how)


def mark_arrays(b: pa.RecordBatch, columns: list[str]) -> Iterator[list[np.ndarray] | None]:
    """For each row the marks' columns; None without marks."""
    lists = b.column("marks")
    offsets, flat = lists.offsets.to_numpy(), lists.values
    fields = [flat.field(c).to_numpy(zero_copy_only=False) for c in columns]
    for row, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        yield [f[a:z] for f in fields] if lists[row].is_valid and z > a else None


def spans(n: int, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the intervals cover."""
    order = np.argsort(start, kind="stable")
    s = start[order].astype(np.int64)
    e = np.maximum.accumulate(np.minimum(s + length[order], n))
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]
