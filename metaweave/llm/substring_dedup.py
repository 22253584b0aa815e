"""Removal of repeated word sequences by fixed-block anchors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, real_ids, release
from .fingerprint import mix
from .repeats import ALL, OPEN, SETTLED, SOURCE, Hashes, check_window, dealt, exchange, ids_differ, keyed, mark_arrays, packed, parts_of, resolve, settled, spans, unpacked, with_marks

#: Words of a window. A window holds a whole reference block, wherever blocks of half as many words begin.
WINDOW = 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that are hashed at once.
WORDS = 500_000


def split(text: str) -> list[bytes]:
    """Words: runs of anything but the six ASCII white-space characters, as bytes."""
    return text.encode("utf-8", "surrogatepass").split()


class Block:
    """The words of several texts in one array of hashes."""

    def __init__(self, words: Iterable[list[bytes]]):
        """words: of one text after another; they aren't kept, so one text's lie in memory at a time."""
        digest = xxhash.xxh3_64_digest
        lengths, symbols = [], []
        for own in words:
            lengths.append(len(own))
            symbols.append(b"".join([digest(w) for w in own]))
        self.lengths = np.array(lengths, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.hashes = Hashes(np.frombuffer(b"".join(symbols), "<u8"))

    def starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of so many words begin, and the text of each."""
        n = np.maximum(self.lengths - size + 1, 0)
        whose = np.repeat(np.arange(len(n)), n)
        return np.arange(len(whose)) + np.repeat(self.bounds[:-1] - (np.cumsum(n) - n), n), whose


def word_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Texts of at least so many words, about WORDS of them at once."""
    for b in blocks(batches, "t", 6 * WORDS):
        yield b, Block(w if len(w) >= least else [] for w in map(split, b.column("t").to_pylist()))


#: Added to a place: the record is settled. Texts of half as many words and more aren't foreseen.
DONE = 1 << 31


def probed(h: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the documents of one batch decide among themselves: which records are hits (rolling windows with a block of a smaller document, and blocks that
    a larger one probes), and which must go to the index still: for each hash the smallest document's block, the largest document's windows, and what isn't decided."""
    order = np.argsort(h, kind="stable")
    s, d, is_block = h[order], doc[order], block[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(edge, len(s)))
    least = np.repeat(np.minimum.reduceat(np.where(is_block, d, np.iinfo(np.int64).max), edge), size)
    last = np.repeat(np.maximum.reduceat(d, edge), size)
    hit = (least < d) | (is_block & (d < last))
    needed = (d == last) | (is_block & (d == least))
    hits, need = np.zeros(len(h), bool), np.zeros(len(h), bool)
    hits[order], need[order] = hit, needed
    return hits, need


def removed_windows(docs: DataFrame, window: int) -> DataFrame:
    """docs: i, h, t. Rows i, h, s, n: n windows from word s on of the row's text also start in a document with a smaller i.

    1. Every document's non-overlapping blocks of half a window are indexed; every rolling window of that length
       probes the index. A hit is a place where a block of a smaller document occurs.
    2. Hits, and the blocks hit, are extended as far as windows that hold them reach. Equal extensions are repeats at once.
    3. Where only a part of an extension recurs, its windows are compared, by 128 bits of hash.
    """
    size = (window + 1) // 2

    def probe(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[list]:
        for b, own in word_blocks(batches, window):
            start, whose = own.starts(size)
            if not len(start):
                continue
            h = own.hashes(start, start + size, 6)
            place = (start - own.bounds[whose]).astype("<u4")
            ids = b.column("i").to_numpy()
            block = place % size == 0
            hits, needed = probed(h, ids[whose], block)
            # within a part, the low 30 bits tell blocks apart well enough: what is hit is compared in full later
            tag = (h & np.uint64(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2) | block.astype(np.uint32) << np.uint32(1) | hits.astype(np.uint32)
            done = hits & ~needed
            yield list(packed(ids, b.column("h").to_numpy(), whose, dealt(parts_of(h, parts), done, place, parts), [tag, np.where(done, place | np.uint32(DONE), place)], ["u4", "u4"], parts))

    def hit(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, keys, (tag, place) = unpacked(blobs, ["u4", "u4"])
        done, place = place >= DONE, place & np.uint32(DONE - 1)
        known, h = (tag & np.uint32(1)).astype(bool), tag >> np.uint32(2)
        index = np.flatnonzero((tag & np.uint32(2)).astype(bool) & ~done)
        order = index[np.argsort(h[index], kind="stable")]
        s = h[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        found = known
        if len(edge):
            kinds, least = s[edge], np.minimum.reduceat(ids[order], edge)
            at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
            probes = (kinds[at] == h) & (least[at] < ids) & ~done
            last = np.full(len(kinds), np.iinfo(np.int64).min)
            np.maximum.at(last, at[probes], ids[probes])
            found = found | probes
            found[index] |= ids[index] < last[at[index]]
        f = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids[f]), pa.array(keys[f]), pa.array(place[f].astype(np.int64))], ["i", "h", "s"])

    hits = Table(exchange(docs, probe, hit, "i long, h long, s long"))
    release(docs.sparkSession)
    kinds = ["hash7", "hash6", "u4", "u2"]

    def extend(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[list]:
        for b, own in word_blocks(batches, window):
            places = [m[0] for m in mark_arrays(b, ["s"])]
            whose = np.repeat(np.arange(len(places)), [len(p) for p in places])
            s = np.concatenate(places)
            n = own.lengths[whose]
            first, last = np.maximum(s - (window - size), 0), np.minimum(s, n - window)
            ok = first <= last
            order = np.flatnonzero(ok)
            whose, s, first, last = whose[order], s[order], first[order], last[order]
            base = own.bounds[whose]
            g = own.hashes(base + s, base + s + size, 7)
            with np.errstate(over="ignore"):
                u = own.hashes(base + first, base + last + window, 8) ^ mix((s - first).astype(np.uint64) * np.uint64(256) + (last - first).astype(np.uint64), 9)
            ids = b.column("i").to_numpy()
            done = settled(g, u, ids[whose])
            part = dealt(parts_of(g, parts), done, first, parts)
            yield list(packed(ids, b.column("h").to_numpy(), whose, part, [g, u, first, last - first + 1 + SETTLED * done], kinds, parts))

    def judge(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, keys, (g, u, start, count) = unpacked(blobs, kinds)
        done = count >= SETTLED
        state, rest = np.full(len(g), ALL, np.uint8), np.flatnonzero(~done)
        state[rest] = resolve(g[rest], u[rest], ids[rest])
        count = count % SETTLED
        at = np.flatnonzero(state)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], keys[at], start[at].astype(np.int64), count[at].astype(np.int32), state[at].astype(np.int32))], ["i", "h", "s", "n", "state"])

    marks = Table(exchange(with_marks(docs, hits.read(), ["s"], "inner"), extend, judge, "i long, h long, s long, n int, state int"))
    hits.drop()
    release(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[list]:
        for b, own in word_blocks(batches, window):
            rows, starts = [], []
            for row, m in enumerate(mark_arrays(b, ["s", "n"])):
                s, n = (x.astype(np.int64) for x in m)
                each = np.unique(np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                rows.append(np.full(len(each), row))
                starts.append(each)
            whose, s = np.concatenate(rows), np.concatenate(starts)
            at = own.bounds[whose] + s
            g, u = own.hashes(at, at + window, 10), own.hashes(at, at + size, 11) ^ own.hashes(at + size, at + window, 12)
            ids = b.column("i").to_numpy()
            done = settled(g, u, ids[whose])
            yield list(packed(ids, b.column("h").to_numpy(), whose, dealt(parts_of(g, parts), done, s, parts), [g, u, s, done], ["hash8", "hash8", "u4", "u1"], parts))

    def compare(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, keys, (g, u, start, done) = unpacked(blobs, ["hash8", "hash8", "u4", "u1"])
        order = np.lexsort((u, g))
        edge = np.flatnonzero(np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (u[order][1:] != u[order][:-1])]))
        least = np.repeat(np.minimum.reduceat(ids[order], edge), np.diff(np.append(edge, len(order))))
        f = order[(ids[order] > least) | done[order].astype(bool)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[f]), pa.array(keys[f]), pa.array(start[f].astype(np.int64)), pa.array(np.ones(len(f), np.int32))], ["i", "h", "s", "n"])

    opened = with_marks(docs, marks.read().filter(F.col("state").isin(OPEN, SOURCE)), ["s", "n"], "inner")
    single = Table(exchange(opened, look, compare, "i long, h long, s long, n int"))
    release(docs.sparkSession)
    return single.read().unionByName(marks.read().filter(F.col("state") == ALL).select("i", "h", "s", "n"))


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without these runs of words, each with the white space up to the next word."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return "".join(text[x:y] for x, y in zip([0, *(at[z] for z in ends)], [*(at[a] for a in starts), len(text)]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, spaced: bool = False) -> DataFrame:
    """i (the id; the largest number for null), n_words, spans (start and end of the maximal removed runs, in words), kept (the other words, joined by a space) and row.

    columns: of docs, returned in the struct `row`. With spaced, kept is the text as it is but for the removed words.

    A word is removed if a window of `window` words that covers it also starts in a document with a smaller id;
    windows (of at most 32 767 words) are judged on the input and never cross documents. Null and empty texts, and those shorter than a
    window, stay. A null id comes after all others; rows of one id are one document as to what is smaller, and
    each is judged. Long texts are whole. Other columns aren't read. An empty table gives no rows.
    """
    check_window(window)
    differ = ids_differ(docs, id_col)
    d = keyed(docs, id_col, text_col, differ)
    found = removed_windows(d, window)
    if columns:
        d = keyed(docs, id_col, text_col, differ, columns)
    marked = with_marks(d, found, ["s", "n"], "left")
    row = ", row " + d.schema["row"].dataType.simpleString() if columns else ""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t"):
            count, runs, kept = [], [], []
            for text, m in zip(b.column("t").to_pylist(), mark_arrays(b, ["s", "n"])):
                words = split(text)
                count.append(len(words))
                a = z = []
                if m is not None:
                    a, z = (x.tolist() for x in spans(len(words), m[0], m[1].astype(np.int64) - 1 + window))
                    words = [w for x, y in zip([0, *z], [*a, len(words)]) for w in words[x:y]]
                runs.append([{"start": x, "end": y} for x, y in zip(a, z)])
                kept.append(cut_words(text, a, z) if spaced else b" ".join(words).decode("utf-8", "surrogatepass"))
            extra = [b.column("row")] if row else []
            yield pa.RecordBatch.from_arrays([real_ids(b), pa.array(count, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string()), *extra], ["i", "n_words", "spans", "kept", *(["row"] if row else [])])

    return marked.mapInArrow(finish, "i long, n_words long, spans array<struct<start: long, end: long>>, kept string" + row)


def removed_count(spans_col: str = "spans"):
    return F.aggregate(spans_col, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def document_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept of each document."""
    d = remove_repeats(docs, window, id_col, text_col)
    return d.select(F.col("i").alias("doc_id"), "n_words", removed_count().alias("n_removed"), "spans", "kept")
