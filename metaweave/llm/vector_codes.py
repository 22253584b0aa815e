"""Codes of vectors: each of some equal parts is its nearest entry of a codebook, found behind a VA-file of the entries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

#: A component x is the integer floor(SCALE * x).
SCALE = 256
#: An entry's coordinate is one of 2 ** BITS cells.
BITS = 3
#: Vectors whose distances are looked at together.
ROWS = 2048
#: Sums of so many different labels at most are broadcast; more are joined by salted keys, SALTS to a label.
LABELS, SALTS = 10_000, 16


class Cells:
    """One part's entries (entries, width) as a VA-file: a cell number for each coordinate, and each cell's two ends."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        count, self.width = entries.shape
        cells = 1 << bits
        self.cell = np.zeros((count, self.width), np.int64)
        self.low, self.high = (np.zeros((self.width, cells), np.int64) for _ in range(2))
        for j in range(self.width):
            x = np.sort(entries[:, j])
            marks = x[[k * count // cells for k in range(1, cells)]]  # about as many coordinates in each
            self.cell[:, j] = np.searchsorted(marks, entries[:, j], "right")
            self.low[j] = np.concatenate([x[:1], marks])
            self.high[j] = np.concatenate([marks, x[-1:]])

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of q the nearest entry (of several the first), its squared distance, and how many distances were taken in all.

        A row's tables hold, for each coordinate and cell, the least and greatest squared difference from any value in the cell. Their sums
        over an entry's cells bound its distance; only entries whose lower bound doesn't exceed the least upper one are looked at.
        """
        n, count = len(q), len(self.entries)
        lower, upper = np.zeros((n, count), np.int64), np.zeros((n, count), np.int64)
        for j in range(self.width):
            below, above = self.low[j] - q[:, j, None], q[:, j, None] - self.high[j]
            lower += np.square(np.maximum(np.maximum(below, above), 0))[:, self.cell[:, j]]
            upper += np.square(np.maximum(np.abs(below), np.abs(above)))[:, self.cell[:, j]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        full = np.full((n, count), np.iinfo(np.int64).max)
        full[row, entry] = np.square(q[row] - self.entries[entry]).sum(axis=1)
        best = full.argmin(axis=1)
        return best, full[np.arange(n), best], len(row)


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its components are numbers."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def most(length: int) -> int:
    """The largest integer whose distances over so many components still are 64-bit numbers."""
    return math.isqrt((1 << 60) // max(length, 1))


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    """(rows, length) integers; a shorter vector is followed by zeros."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = np.clip(np.floor(SCALE * x), -most(length), most(length)).astype(np.int64)
    out = np.zeros((len(size), length), np.int64)
    out[np.arange(length) < size[:, None]] = x
    return out


def assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their parts (rows, parts, width), entries and squared distances (rows, parts)."""
    files = [Cells(b) for b in books]
    parts, _, width = books.shape
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            some = batch.slice(a, ROWS)
            x = integers(some.column("v"), parts * width).reshape(-1, parts, width)
            entry, far = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
            for p, file in enumerate(files):
                entry[:, p], far[:, p], _ = file.nearest(x[:, p])
            yield some, x, entry, far


def moved(d: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: entries are the floors of the means of the parts nearest to them, or stay if there are none.

    A task sends one sum for each coordinate of an entry; parts * entries * (width + 1) numbers meet, whatever the rows.
    """
    parts, count, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, count, width + 1), np.int64)
        for _, x, entry, _ in assigned(batches, books):
            for p in range(parts):
                np.add.at(totals[p, :, :width], entry[:, p], x[:, p])
                totals[p, :, width] += np.bincount(entry[:, p], minlength=count)
        flat = totals.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["place", "total"])

    sums = d.select("v").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = np.zeros(parts * count * (width + 1), object)
    for r in sums.collect():
        totals[r.place] = int(r.total)
    totals = totals.reshape(parts, count, width + 1)
    out = books.copy()
    for p, e in zip(*np.nonzero(totals[:, :, width])):
        out[p, e] = [x // totals[p, e, width] for x in totals[p, e, :width]]
    return out


def first_books(d: DataFrame, id_col: str, parts: int, entries: int, length: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids, in order (null ids last; rows of one id by their vectors)."""
    rows = d.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), length)
    return np.ascontiguousarray(x.reshape(len(rows), parts, length // parts).transpose(1, 0, 2))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codebooks(d: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """The codebooks of rows id, v; None if there are none."""
    longest = d.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    length = parts * max(1, -(-longest // parts))
    books = first_books(d, "id", parts, entries, length)
    for _ in range(rounds):
        books = moved(d, books)
    return books


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code (two hex digits a part; more where there are over 256 entries), error (squared distance), label_error (its sum over the rows of a label) and
    codebooks_sha256 of each row whose vector is there and finite.

    Vectors are cut into equal consecutive parts; one whose length differs counts as followed by zeros, up to the next multiple of parts
    that holds the longest. Integers are cut at most(length), beyond which squares would leave 64 bits. Fewer rows than entries make
    as many entries as rows. Rows of one id are rows of their own, null ids come last, null labels are one label, a sum beyond 64 bits is null. No
    rows give no rows. Other columns aren't read. The driver holds the codebooks, whose size doesn't depend on the rows.
    """
    d = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label")).filter(finite(F.col("v")))
    types = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = f"id {types['id']}, label {types['label']}, code string, error long"
    books = codebooks(d, parts, entries, rounds)
    digits = max(2, len(f"{entries - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if books is None:
            return
        names = [f"{e:0{digits}x}" for e in range(entries)]
        for b, _, entry, far in assigned(batches, books):
            code = pa.array(["".join([names[e] for e in row]) for row in entry.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), code, pa.array(far.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])

    coded = Table(d.mapInArrow(run, schema)).read()
    sums = Table(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))).read()
    same = F.col("a.label").eqNullSafe(F.col("b.label"))
    if sums.count() <= LABELS:
        out = coded.alias("a").join(F.broadcast(sums).alias("b"), same, "left")
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
        each = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = salted.alias("a").join(each.alias("b"), same & (F.col("a.salt") == F.col("b.salt")), "left")
    digest = F.lit("" if books is None else books_digest(books))
    return out.select(F.col("a.id").alias("id"), F.col("a.label").alias("label"), "code", "error", "label_error", digest.alias("codebooks_sha256"))
