"""Ranked lexical search: items times terms times documents, as a product of sparse matrices in blocks of documents."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, blocks, key_columns, real_id

#: Items whose texts have about so many different terms are asked at once, in one or more blocks.
ITEM_TERMS = 200_000
#: Bytes that end a term (all that are neither a letter nor a digit of ASCII nor part of another character) become blanks, A-Z small letters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: What tasks found for an item first meets in so many places.
SALTS = 64
#: Documents that are in one product at most.
DOCUMENTS = 8192


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text (UTF-8), repeats included."""
    return text.translate(LETTERS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("t").cast(pa.binary()).to_pylist()


class Items:
    """The rows of a block of items over its terms: for each item the numbers of its terms and how often each counts."""

    def __init__(self, rows: list, repeats: bool):
        self.code: dict[bytes, int] = {}
        self.keys, self.at, self.times = [], [], []
        for r in rows:
            own = Counter(terms(bytes(r.t)))
            self.keys.append(r.q)
            self.at.append(np.array([self.code.setdefault(t, len(self.code)) for t in own], np.int64))
            self.times.append([n if repeats else 1 for n in own.values()])


class Postings:
    """The terms of a block of documents that some item has, as a matrix of rows for terms: their documents and how often each has the term."""

    def __init__(self, texts: list[bytes | None], code: dict[bytes, int]):
        self.length = np.zeros(len(texts), np.int64)
        found, counts, size = [], [], []
        for k, text in enumerate(texts):
            split = terms(text)
            self.length[k] = len(split)
            own = np.fromiter(map(code.get, split, itertools.repeat(-1)), np.int64, len(split))
            own, n = np.unique(own[own >= 0], return_counts=True)
            found.append(own)
            counts.append(n)
            size.append(len(own))
        term = np.concatenate(found) if found else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.document = np.repeat(np.arange(len(texts)), size)[order]
        self.tf = (np.concatenate(counts) if counts else np.zeros(0, np.int64))[order].astype(np.int64)
        self.term = term[order]
        self.start = np.searchsorted(self.term, np.arange(len(code) + 1))

    def impacts(self, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        m = 100 - 50 + (50 * self.length * n_docs) // n_terms
        return w[self.term] * ((1_000_000_000 * self.tf) // (1000 * self.tf + 20 * m[self.document]))


class Best:
    """For each item the k best documents so far: highest score, then smallest id (null last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items)]

    def offer(self, item: int, score: np.ndarray, i: np.ndarray, null: np.ndarray) -> None:
        before = self.kept[item]
        least = before[0][-1] if len(before[0]) == self.k else 1
        at = np.flatnonzero(score >= least)
        if len(at) > 4 * self.k:  # the k-th score of the block is a bound, too
            at = at[score[at] >= np.partition(score[at], len(at) - self.k)[len(at) - self.k]]
        if not len(at):
            return
        s, i, null = (np.concatenate([a, b[at]]) for a, b in zip(before, (score, i, null)))
        order = np.lexsort((null, i, -s))[: self.k]
        self.kept[item] = (s[order], i[order], null[order])


def counted(d: DataFrame, code: dict[bytes, int]) -> dict[int, int]:
    """The number of documents with a term (at -1), of their terms (-2), and of the documents of each term; a task sends one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(code), np.int64), 0, 0
        for b in blocks(batches, "t"):
            p = Postings(texts_of(b), code)
            df += np.bincount(p.term, minlength=len(code))
            n_docs += int((p.length > 0).sum())
            n_terms += int(p.length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[n_docs, n_terms], df[at]]))], ["term", "n"])

    return {r.term: r.n for r in d.select("t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def best_of_tasks(d: DataFrame, items: Items, stats: dict[int, int], k: int) -> DataFrame:
    """q, score, i, null: of each task the k best documents of each item.

    A block of documents is one product: an item's row of the result is the merged rows of its terms, each times how often it counts.
    """
    n_docs, n_terms, code = stats.get(-1, 0), stats.get(-2, 0), items.code
    w = np.array([weight(n_docs, stats.get(t, 0)) for t in range(len(code))], np.int64)
    keys, at, times = items.keys, items.at, items.times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(keys), k)
        for some in blocks(batches, "t"):
            for a in range(0, some.num_rows, DOCUMENTS):
                b = some.slice(a, DOCUMENTS)
                p = Postings(texts_of(b), code)
                if not len(p.term):
                    continue
                i, null = b.column("i").to_numpy(), b.column("h").to_numpy() & 1
                impact = p.impacts(w, n_docs, n_terms)
                for item in range(len(keys)):
                    row = np.zeros(b.num_rows, np.int64)
                    for t, n in zip(at[item].tolist(), times[item]):
                        x, y = p.start[t], p.start[t + 1]
                        if x < y:
                            row[p.document[x:y]] += n * impact[x:y]
                    best.offer(item, row, i, null)
        for q, (score, i, null) in zip(keys, best.kept):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(score), pa.array(i), pa.array(null)], ["q", "score", "i", "null"])

    return d.mapInArrow(run, "q long, score long, i long, null long")


def search(items: DataFrame, docs: DataFrame, k: int = 50, repeats: bool = False, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", at_once: int = ITEM_TERMS) -> DataFrame:
    """item, rank (int, from 1), doc and score (long) of the k best documents of each item, those with a score above 0.

    With repeats, a term counts as often as the item has it, else once. Every row of items is an item, whatever ids repeat; every row of docs is a document.
    Equal scores go by ascending id, null last. Null and empty texts have no terms: such items have no rows, such documents
    no score. Statistics cover all documents. Items are asked in blocks of about at_once different terms (a longer item is a block of its own with
    others): a block's terms go to every task, and the documents are read twice for each block. A task holds k documents for each item, and sends them.
    """
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.encode(F.col(f"`{item_text}`"), "UTF-8").alias("t")).filter(F.length("t") > 0)
    asked = Table(asked.withColumn("q", F.monotonically_increasing_id())).read()
    size = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    number = max(1, math.ceil(size / (6 * at_once)))  # about six bytes a term
    i, h = key_columns(id_col, text_col)
    d = docs.select(i.alias("i"), h.alias("h"), F.col(f"`{text_col}`").alias("t"))
    found = None
    for block in range(number):
        part = Items(asked.filter(F.pmod(F.xxhash64("q"), F.lit(number)) == block).select("q", "t").collect(), repeats)
        some = best_of_tasks(d, part, counted(d, part.code), k)
        found = some if found is None else found.union(some)
    order = [F.col("score").desc(), "i", "null"]
    first = Window.partitionBy("q", "salt").orderBy(*order)
    last = Window.partitionBy("q").orderBy(*order)
    top = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    top = top.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return top.join(asked.select("q", "item"), "q").select("item", "rank", real_id(F.col("i"), F.col("null")).alias("doc"), "score")
