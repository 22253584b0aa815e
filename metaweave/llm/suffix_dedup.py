"""Removal of repeated byte strings by sorted suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, real_ids, release
from .repeats import ALL, OPEN, SETTLED, SOURCE, Hashes, check_window, dealt, exchange, ids_differ, keyed, mark_arrays, packed, parts_of, resolve, settled, spans, unpacked, with_marks

#: Bytes of a window, and of the anchor in it.
WINDOW, ANCHOR = 50, 20
#: Long texts are worked on in pieces of so many bytes, which overlap by a window.
PIECE = 4_000_000
#: Bytes to which suffixes are sorted by multikey quicksort, eight at a time; tries sort what is still equal.
SHALLOW = 24
#: Suffixes sorted at once, but for an anchor that has more.
SUFFIXES = 400_000


def multikey(rows: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of byte strings of equal length by their first `depth` bytes, eight to a key: only what is equal so far is compared further.

    group: numbers that stand before all bytes. Returns the order, and for each in order the number of its class of equals.
    """
    order = np.argsort(group, kind="stable")
    s = group[order]
    label = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    tied = np.arange(len(order))
    for at in range(0, depth, 8):
        count = np.bincount(label[tied], minlength=label[-1] + 1)
        tied = tied[count[label[tied]] > 1]
        if not len(tied):
            break
        key = np.zeros((len(tied), 8), np.uint8)
        part = rows[order[tied], at : min(at + 8, depth)]
        key[:, : part.shape[1]] = part
        key = key.view(">u8")[:, 0].astype(np.uint64)
        by = np.lexsort((key, label[tied]))
        order[tied] = order[tied][by]
        key, old = key[by], label[tied]
        step = np.zeros(len(order), np.int64)
        step[tied[1:]] = (old[1:] == old[:-1]) & (key[1:] != key[:-1])
        first = np.concatenate([[True], label[1:] != label[:-1]])
        label = np.cumsum(step + first) - 1
    return order, label


def blind_tries(rows: np.ndarray, order: np.ndarray, label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts on what is equal in the first `depth` bytes, by a blind trie for each class, all tries a level at a time.

    A node keeps only the place of the first byte in which its strings differ, found against one of them, and
    branches by that byte. Strings that don't differ at all end as one leaf.
    """
    width = rows.shape[1]
    tied = np.arange(len(order))
    while True:
        count = np.bincount(label[tied], minlength=label[-1] + 1)
        tied = tied[count[label[tied]] > 1]
        if not len(tied):
            return order, label
        own = label[tied]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        node = np.cumsum(first) - 1
        head = rows[order[tied[first]]]
        mine = rows[order[tied]]
        differs = mine[:, depth:] != head[node][:, depth:]
        place = np.where(differs.any(axis=1), differs.argmax(axis=1) + depth, width)
        branch = np.minimum.reduceat(place, np.flatnonzero(first))[node]
        on = branch < width
        if not on.any():
            return order, label
        tied, node, branch, mine = tied[on], node[on], branch[on], mine[on]
        byte = mine[np.arange(len(tied)), branch]
        by = np.lexsort((byte, node))
        order[tied] = order[tied][by]
        byte, node = byte[by], node[by]
        step = np.zeros(len(order), np.int64)
        step[tied[1:]] = (node[1:] == node[:-1]) & (byte[1:] != byte[:-1])
        label = np.cumsum(step + np.concatenate([[True], label[1:] != label[:-1]])) - 1


def sort_suffixes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (as far as a window) within their groups, and the class of equals of each in order."""
    depth = min(SHALLOW, rows.shape[1])
    return blind_tries(rows, *multikey(rows, group, depth), depth)


def pieces(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(text) - window + 1), PIECE):
        yield at, text[at : at + PIECE + window - 1]


def cells(parts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each cell its piece, first start, number of starts, and the hashes of its anchor and of its whole bytes.

    The anchor is the first run of `anchor` bytes of a window whose hash is smallest.
    """
    lengths = np.array([len(p) for p in parts], np.int64)
    b = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(b) < window:
        return empty
    h = Hashes(b.astype(np.uint64) + np.uint64(1))
    low = h.runs(anchor)
    low = (low & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(low), dtype=np.uint64)
    span, have = window - anchor + 1, 1
    while have < span:  # minima over runs of `have` places, doubled
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    whose = np.repeat(np.arange(len(parts)), np.maximum(lengths - window + 1, 0))
    start = np.arange(len(whose)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(np.maximum(lengths - window + 1, 0))[:-1]]), np.maximum(lengths - window + 1, 0))
    if not len(start):
        return empty
    place = place[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (whose[1:] != whose[:-1])]))
    count = np.diff(np.append(first, len(start)))
    a, s = place[first], start[first]
    with np.errstate(over="ignore"):
        whole = h(s, s + count - 1 + window, 5) ^ ((a - s).astype(np.uint64) << np.uint64(8)) ^ count.astype(np.uint64)
    return whose[first], s - bounds[whose[first]], count, h(a, a + anchor, 4), whole


def removed_windows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs: i, h, t. Rows i, h, s, n: n windows from s on of the row's text also start in a document with a smaller i."""
    kinds = ["hash7", "hash6", "u4", "u2"]

    def make(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[list]:
        for b in blocks(batches, "t"):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("t").to_pylist()]
            ids, hashes = b.column("i").to_numpy(), b.column("h").to_numpy()
            cut = [(row, at, p) for row, t in enumerate(texts) for at, p in pieces(t, window)]
            group: list = []
            size = 0
            for k, c in enumerate(cut):
                group.append(c)
                size += len(c[2])
                if size >= PIECE or k == len(cut) - 1:
                    which, start, count, g, u = cells([c[2] for c in group], window, anchor)
                    rows, offsets = (np.array([c[x] for c in group], np.int64) for x in (0, 1))
                    own, start = rows[which], start + offsets[which]
                    done = settled(g, u, ids[own])
                    part = dealt(parts_of(g, parts), done, start, parts)
                    yield list(packed(ids, hashes, own, part, [g, u, start, count + SETTLED * done], kinds, parts))
                    group, size = [], 0

    def use(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, hashes, (g, u, start, count) = unpacked(blobs, kinds)
        done = count >= SETTLED
        state, rest = np.full(len(g), ALL, np.uint8), np.flatnonzero(~done)
        state[rest] = resolve(g[rest], u[rest], ids[rest])
        count = count % SETTLED
        at = np.flatnonzero(state)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], hashes[at], start[at].astype(np.int64), count[at].astype(np.int32), state[at].astype(np.int32))], ["i", "h", "s", "n", "state"])

    marks = Table(exchange(docs, make, use, "i long, h long, s long, n int, state int"))
    release(docs.sparkSession)
    opened = with_marks(docs, marks.read().filter(F.col("state").isin(OPEN, SOURCE)), ["s", "n"], "inner")

    def send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[list]:
        for b in blocks(batches, "t"):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("t").to_pylist()]
            ids, hashes = b.column("i").to_numpy(), b.column("h").to_numpy()
            rows, starts, counts, strings = [], [], [], []
            for row, m in enumerate(mark_arrays(b, ["s", "n"])):
                s, n = (x.astype(np.int64) for x in m)
                for a, c in zip(s.tolist(), n.tolist()):
                    strings.append(texts[row][a : a + c - 1 + window])
                rows.append(np.full(len(s), row))
                starts.append(s)
                counts.append(n)
            if not rows:
                continue
            whose, start, count = (np.concatenate(x) for x in (rows, starts, counts))
            g = anchor_hashes(strings, window, anchor)
            out = []
            part = parts_of(g, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[edges[p] : edges[p + 1]]
                if len(at):
                    (_, head), = packed(ids, hashes, whose[at], np.zeros(len(at), np.int64), [g[at], start[at], count[at]], ["hash8", "u4", "u2"], 1)
                    own = np.argsort(whose[at], kind="stable")
                    out.append((p, len(head).to_bytes(8, "little") + head + b"".join(strings[k] for k in at[own].tolist())))
            yield out

    def sort(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        heads, strings = [], []
        for b in blobs:
            n = int.from_bytes(b[:8], "little")
            heads.append(b[8 : 8 + n])
            strings.append(b[8 + n :])
        ids, hashes, (g, start, count) = unpacked(heads, ["hash8", "u4", "u2"])
        text = np.frombuffer(b"".join(strings), np.uint8)
        del strings, heads
        n = count.astype(np.int64)
        begin = np.cumsum(n - 1 + window) - (n - 1 + window)
        order = np.argsort(g, kind="stable")
        total = np.cumsum(n[order])
        new = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
        views = np.lib.stride_tricks.sliding_window_view(text, window)
        at = 0
        while at < len(order):
            before = total[at - 1] if at else 0
            k = np.searchsorted(new, np.searchsorted(total, before + SUFFIXES), side="right")
            end = int(new[k]) if k < len(new) else len(order)
            if k and k < len(new) and new[k - 1] > at:
                end = int(new[k - 1])
            own = order[at:end]
            c = n[own]
            inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            which = np.repeat(own, c)
            rows = views[begin[which] + inner]
            group = np.cumsum(np.concatenate([[0], g[own][1:] != g[own][:-1]]))
            by, label = sort_suffixes(rows, np.repeat(group, c))
            edge = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            doc = ids[which[by]]
            least = np.minimum.reduceat(doc, edge)[label]
            gone = np.sort(by[doc > least])  # places in order of cells and of starts in them
            if len(gone):
                run = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (which[gone[1:]] != which[gone[:-1]])]))
                size, gone = np.diff(np.append(run, len(gone))), gone[run]
                yield pa.RecordBatch.from_arrays([pa.array(ids[which[gone]]), pa.array(hashes[which[gone]]), pa.array(start[which[gone]].astype(np.int64) + inner[gone]), pa.array(size.astype(np.int32))], ["i", "h", "s", "n"])
            at = end

    single = Table(exchange(opened, send, sort, "i long, h long, s long, n int"))
    release(docs.sparkSession)
    return single.read().unionByName(marks.read().filter(F.col("state") == ALL).select("i", "h", "s", "n"))


def anchor_hashes(strings: list[bytes], window: int, anchor: int) -> np.ndarray:
    """The hash of each cell's anchor, found again in its first window."""
    out = np.zeros(len(strings), np.uint64)
    step = max(1, PIECE // (2 * window))
    for a in range(0, len(strings), step):
        _, _, _, g, _ = cells([s[:window] for s in strings[a : a + step]], window, anchor)
        out[a : a + step] = g
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the maximal removed runs, in bytes) and kept (the remaining bytes) of each document.

    A byte is removed if a string of `window` bytes that covers it also starts in a document with a smaller id;
    strings (of at most 32 767 bytes) are judged on the input and never cross documents. Null and empty texts, and those shorter than a
    window, stay. A null id comes after all others; rows of one id are one document as to what is smaller, and
    each is judged. Long texts are worked on in pieces that overlap. Other columns aren't read. An empty table gives no rows.
    """
    check_window(window)
    d = keyed(docs, id_col, text_col, ids_differ(docs, id_col))
    marked = with_marks(d, removed_windows(d, window, anchor), ["s", "n"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t"):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("t").to_pylist()]
            runs, kept = [], []
            for text, m in zip(texts, mark_arrays(b, ["s", "n"])):
                if m is None:
                    runs.append([])
                    kept.append(text)
                    continue
                a, z = spans(len(text), m[0], m[1].astype(np.int64) - 1 + window)
                a, z = a.tolist(), z.tolist()
                runs.append([{"start": x, "end": y} for x, y in zip(a, z)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *z], [*a, len(text)])))
            yield pa.RecordBatch.from_arrays([real_ids(b), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["i", "n_bytes", "spans", "kept"])

    out = marked.mapInArrow(finish, "i long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select(F.col("i").alias("doc_id"), "n_bytes", "spans", "kept")
