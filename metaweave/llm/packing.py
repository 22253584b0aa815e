"""Best-fit decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, blocks

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 4096, 1
#: Words whose ids a process keeps in each of two generations. Longer words aren't kept.
MAX_WORDS, KEPT_CHARS = 800_000, 40
#: Text that is tokenised at once.
CHARS = 2_000_000


class WordTokenizer:
    """ids of texts by a tokenizer that lower-cases, and neither keeps white space nor joins across it or across the end of
    a run of letters; so words can be tokenised once and kept, and their letters apart from the punctuation that follows.
    Texts that hold a special token, in whatever case, and all texts of other tokenizers are tokenised whole."""

    SPACE = re.compile(r"[\t-\r]")
    #: Fixed value: how a tokenizer of this kind finds words.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: ASCII punctuation but the apostrophe, with which the tokenizer splits letters off.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        steps = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in steps["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE)
        self.firsts = {c for t in special for c in (t[0].lower(), t[0].upper())}
        kinds = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        cuts = [(n["type"], n.get("pattern")) for n in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = kinds == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", {"Regex": self.SPLIT}), ("ByteLevel", None)] and not any(c.isspace() for t in special for c in t)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, new: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def _encode_parts(self, new: list[str]) -> list[bytes]:
        """Parts are one run of letters or of punctuation each, so in a joined text each ends with the first token that ends a word."""
        if not new:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(new):
            return self._encode(new)
        data = ids.tobytes()
        return [data[a:z] for a, z in zip([0, *cuts], cuts)]

    def _learn(self, new: set[str]) -> None:
        """Takes words up; those of letters and then punctuation by way of their two parts."""
        words, older = self.words, self.older
        known = [w for w in new if w in older]
        words.update((w, older[w]) for w in known)
        new.difference_update(known)
        parts, split, whole = set(), [], []
        for w in new:
            if w > "" and max(w) > "\xff":  # where lower-casing or composition may make marks of letters
                whole.append(w)
                continue
            if w.isalpha():
                parts.add(w)
                continue
            letters = w.rstrip(self.MARKS)
            if letters.isalpha():
                split.append((w, letters, w[len(letters) :]))
            else:
                whole.append(w)
        for _, a, z in split:
            parts.add(a)
            parts.add(z)
        missing = [w for w in parts if w not in words]  # (a difference of sets would go through all words)
        words.update(zip(missing, self._encode_parts(missing)))
        for w, a, z in split:
            words[w] = words[a] + words[z]
        words.update(zip(whole, self._encode(whole)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = {k: t for k, t in enumerate(texts) if not self.by_words or any(c in t for c in self.firsts) and self.special.search(t)}
        flat, ends = [], [0]
        for k, t in enumerate(texts):
            if k in whole:
                ends.append(len(flat))
                continue
            try:
                t.encode("latin-1")
                t = t.lower()  # all versions agree on these letters, and fewer words differ
            except UnicodeEncodeError:
                pass
            flat += self.SPACE.sub(" ", t).split(" ")
            ends.append(len(flat))
        ids = list(map(self.words.get, flat))  # one look at each word; b"" (of the empty word) counts as missing, too
        missing = list(compress(range(len(flat)), map(not_, ids)))
        new = {flat[k] for k in missing}
        if len(self.words) + len(new) > MAX_WORDS:
            self.older, self.words = self.words, {}
        long = [w for w in new if len(w) > KEPT_CHARS]
        self._learn(new)
        for k in missing:
            ids[k] = self.words[flat[k]]
        for w in long:
            self.words.pop(w, None)
        found = dict(zip(whole, self._encode(list(whole.values()))))
        return [np.frombuffer(found[k] if k in found else b"".join(ids[a:z]), "<u4") for k, (a, z) in enumerate(zip(ends, ends[1:]))]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's ids and the end id, cut every `size` ids.

    part and n tell in which task, and which there, the row was made: so equal rows differ.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        part, n = TaskContext.get().partitionId(), 0
        for b in blocks(batches, "t", CHARS):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(tokenizer([t or "" for t in b.column("t").to_pylist()])):
                x = np.append(x, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(x), size)):
                    own = x[at : at + size]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            arrays = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(np.arange(n, n + len(row)), pa.int64())]
            n += len(row)
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "n", *(["ids"] if with_ids else [])])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, n long" + ", ids array<int>" * with_ids)


class OpenBins:
    """A segment tree over remaining capacities: which capacities have open bins. Bins of equal capacity are intervals of their numbers."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = [False] * (2 * self.width)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int) -> None:
        at = capacity + self.width
        self.tree[at] = bool(self.bins[capacity])
        while at := at // 2:
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        self.bins[capacity].append((first, count))
        self._mark(capacity)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """At most so many bins of one interval: the first's number and how many."""
        first, count = self.bins[capacity].pop()
        if count > most:
            self.bins[capacity].append((first + most, count - most))
            count = most
        self._mark(capacity)
        return first, count

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length that has an open bin."""
        at = length + self.width
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit(counts: dict[int, int], size: int = SIZE) -> dict[int, np.ndarray]:
    """For each length, runs of (rank of the first piece, pieces a bin, first bin, offset in each), by best-fit decreasing.

    Pieces of one length are alike, so those that go to bins of one capacity are placed together: the work and
    the plan depend on the number of lengths, not of pieces. The result is that of placing one piece at a time.
    """
    bins, runs, fresh = OpenBins(size), {}, 0
    for length in sorted(counts, reverse=True):
        rank, left, own = 0, counts[length], []

        def place(first: int, count: int, each: int, capacity: int) -> None:
            nonlocal rank, left
            own.append((rank, each, first, size - capacity))
            rank, left = rank + count * each, left - count * each
            bins.add(capacity - each * length, first, count)

        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                each = min(size // length, left)
                place(fresh, (count := left // each), each, size)
                fresh += count
            else:
                each = min(capacity // length, left)
                first, count = bins.take(capacity, left // each)
                place(first, count, each, capacity)
        runs[length] = np.array(own, np.int64)
    return runs


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Each document's pieces of at most `size` tokens with their place: sequence_id and offset, without gaps from 0.

    Only how many pieces of each length there are goes to the driver (at most `size` rows); best-fit decreasing there
    makes a plan for the ranks of the pieces of a length, which each piece then looks up. A null or empty text is the
    end id alone. Rows are packed each, if ids repeat or are null. An empty table gives no rows.
    """
    made = Table(pieces(docs, path, id_col, text_col, size, end, with_ids)).read()
    runs = best_fit({r["length"]: r["count"] for r in made.groupBy("length").count().collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = made.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("n")) - 1)
    ranked = ranked.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for own in np.unique(n):
            at = n == own
            plan = runs[int(own)]
            run = plan[np.searchsorted(plan[:, 0], r[at], side="right") - 1]
            j = r[at] - run[:, 0]
            sequence[at], offset[at] = run[:, 2] + j // run[:, 1], run[:, 3] + j % run[:, 1] * own
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "place.sequence_id", "place.offset")
