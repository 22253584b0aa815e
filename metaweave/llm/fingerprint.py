"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_columns, partitions, real_ids

#: Cells of a fingerprint, in HASHES equal parts. A comparison that fails takes twice as many, and so on.
CELLS, HASHES = 24, 3
#: Text compared at once.
CHARS = 1_000_000
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: A paragraph is a line; long ones are cut further after words whose last bytes (of the text's own) hash to 0 modulo this.
CUT = 8

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size - 1, m, np.uint64)]).cumprod(dtype=np.uint64) for m in (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 2**64)))]
    return _powers[0][:n], _powers[1][:n]


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of all texts, and the text of each. A paragraph's k-th copy in a text has a digest of its own."""
    lengths = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    space = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13)))
    first = np.repeat(bounds[:-1], np.diff(np.searchsorted(space, bounds)))  # where a space's text starts; bytes before that count as 0
    tail = sum(np.where(space - k >= first, b[np.maximum(space - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k) for k in (1, 2, 3))
    cut = space[(b[space] == 10) | (mix(tail) % np.uint64(CUT) == 0)]
    edges = np.unique(np.concatenate([bounds, cut + 1]))
    start, end = edges[:-1], edges[1:]
    with np.errstate(over="ignore"):
        up, down = powers(len(b) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        digest = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64), 1)
        whose = np.searchsorted(bounds, start, side="right") - 1
        order = np.lexsort((digest, whose))
        d, w = digest[order], whose[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        return mix(d + (np.arange(len(d)) - first).astype(np.uint64) * _MULTIPLIER, 2), w


class Sketches:
    """One sketch for each of n sets, each of `cells` cells: how many digests a cell has, their xor and that of their checks."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def places(self, digest: np.ndarray, whose: np.ndarray) -> list[np.ndarray]:
        part = self.cells // HASHES
        with np.errstate(over="ignore"):
            return [whose * self.cells + k * part + (mix(digest, 16 * self.cells + k) % np.uint64(part)).astype(np.int64) for k in range(HASHES)]

    def add(self, digest: np.ndarray, whose: np.ndarray, sign: int | np.ndarray = 1) -> None:
        if not len(digest):
            return
        with np.errstate(over="ignore"):
            check = mix(digest, 3) & np.uint64(0xFFFFFFFF)
        sign = np.broadcast_to(np.asarray(sign, np.int32), digest.shape)
        for at in self.places(digest, whose):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The digests that differ, their sets and signs, and which sets are recovered whole. It empties the cells."""
        found: list[tuple] = []
        while True:
            with np.errstate(over="ignore"):
                pure = np.flatnonzero((np.abs(self.count) == 1) & (self.check == (mix(self.key, 3) & np.uint64(0xFFFFFFFF))))
            if not len(pure):
                break
            whose = pure // self.cells
            digest, sign = self.key[pure], self.count[pure]
            keep = np.unique(np.stack([whose.astype(np.uint64), digest]), axis=1, return_index=True)[1] if len(pure) > 1 else np.array([0])
            digest, whose, sign = digest[keep], whose[keep], sign[keep]
            found.append((digest, whose, sign))
            self.add(digest, whose, -sign)
            if len(found) > 64 + self.cells:
                break
        whole = ~((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.n, self.cells).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int32)]
        return *parts, whole

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Each sketch as text: the number of digests, then the cells."""
        rows = np.zeros((self.n, self.cells), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        rows["count"], rows["key"], rows["check"] = (x.reshape(self.n, self.cells) for x in (self.count, self.key, self.check))
        return [base64.b64encode(int(s).to_bytes(4, "little") + r.tobytes()).decode() for s, r in zip(sizes, rows)]


def _of(digest: np.ndarray, bounds: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of so many sets one after another, and the place of each set."""
    sizes = bounds[sets + 1] - bounds[sets]
    whose = np.repeat(np.arange(len(sets)), sizes)
    at = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[sets], sizes)
    return digest[at], whose


def differences(digest: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many digests two sets don't share, for each pair: sketches are subtracted and peeled, with twice the cells where that fails."""
    out, rest, cells = np.zeros(len(one), np.int64), np.arange(len(one)), CELLS
    while len(rest):
        sketches = []
        for sets in (one[rest], two[rest]):
            s = Sketches(len(rest), cells)
            s.add(*_of(digest, bounds, sets))
            sketches.append(s)
        _, whose, _, whole = sketches[0].minus(sketches[1]).peel()
        n = np.bincount(whose, minlength=len(rest))
        out[rest[whole]] = n[whole]
        rest, cells = rest[~whole], cells * 2
    return out


def likeness(digest: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Shared digests as a part of all, from the sizes and the difference; 1 for two empty sets."""
    sizes = bounds[1:] - bounds[:-1]
    both, apart = sizes[one] + sizes[two], differences(digest, bounds, one, two)
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def fingerprints(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The fingerprints, and the digests with their bounds for comparisons."""
    digest, whose = paragraphs([t.encode("utf-8", "surrogatepass") for t in texts])
    bounds = np.searchsorted(whose, np.arange(len(texts) + 1))
    s = Sketches(len(texts), CELLS)
    s.add(digest, whose)
    return s.texts(bounds[1:] - bounds[:-1]), digest, bounds


def edit(text: str, other: str) -> str:
    """The second half (rounded down) gives way to as much of the start of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows i, h, t dealt to ranges `part` of the order of i, sorted; each range ends with `tail` rows: the first of the next range.

    The splitters are ids that occur, as many as there are ranges; so each range has a first row, which goes to
    both sides of the border. After the last row comes the first.
    """
    i, h = key_columns(id_col, text_col)
    d = docs.select(i.alias("i"), h.alias("h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    n = RANGES * partitions(docs.sparkSession)
    found = d.agg(F.percentile_approx("i", [k / n for k in range(1, n)] or [0.5], F.lit(100 * n)).alias("a"), F.min("i").alias("m")).first()
    splits = sorted({x for x in found.a or [] if x > found.m})
    at = F.size(F.filter(F.array(*[F.lit(x) for x in splits]).cast("array<long>"), lambda x: x <= F.col("i")))
    own = F.struct(F.col("at").alias("part"), F.lit(0).alias("tail"))
    before = F.when(F.col("i") == F.lit(found.m), F.lit(len(splits))).when(F.array_contains(F.array(*[F.lit(x) for x in splits]).cast("array<long>"), F.col("i")), F.col("at") - 1)
    places = F.array_compact(F.array(own, F.when(before.isNotNull(), F.struct(before.alias("part"), F.lit(1).alias("tail")))))
    d = d.withColumn("at", at).select("i", "h", "t", F.explode(places).alias("p")).select("i", "h", "t", "p.part", "p.tail")
    return d.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "tail", "i", "h")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of an edited version, and how alike it is to that and to the next document.

    The next document is that with the next id (after the last the first; equal ids in the order of a hash of their
    text; null ids come last). A lone document follows itself. Null texts count as empty; two empty texts are alike (1), an empty
    and another aren't (0). Long texts are whole. Other columns aren't read. An empty table gives no rows.
    """
    d = with_next(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            edited = [edit(texts[a], texts[b]) for a, b in pairs]
            prints, digest, bounds = fingerprints(texts + edited)
            one, two = np.array(pairs, np.int64).T
            new = len(texts) + np.arange(len(pairs))
            return pa.RecordBatch.from_arrays([
                pa.array([ids[a] for a in one], pa.int64()), pa.array([len(texts[a]) for a in one], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array([prints[a] for a in one], pa.string()), pa.array(prints[len(texts) :], pa.string()),
                pa.array(likeness(digest, bounds, one, new), pa.float64()), pa.array(likeness(digest, bounds, one, two), pa.float64()),
            ], ["i", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        texts: list[str] = []
        ids: list[int] = []
        pairs: list[tuple[int, int]] = []
        chars, last, ended = 0, None, True
        for b in batches:
            for i, t, part, tail in zip(real_ids(b).to_pylist(), b.column("t").to_pylist(), b.column("part").to_pylist(), b.column("tail").to_pylist()):
                if part != last:
                    last, ended = part, True
                elif ended:  # a further tail row of this range
                    continue
                if tail and ended:
                    continue
                if not ended:
                    pairs.append((len(texts) - 1, len(texts)))
                texts.append(t)
                ids.append(i)
                chars += len(t)
                ended = bool(tail)
                if chars > CHARS and pairs:
                    yield out()
                    texts, ids, pairs, chars = ([], [], [], 0) if ended else (texts[-1:], ids[-1:], [], len(t))
        if pairs:
            yield out()

    made = d.select("i", "h", "t", "part", "tail").mapInArrow(run, "i long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.select(F.col("i").alias("doc_id"), *made.columns[1:])
