"""Removal of repeated lines by windows of consecutive lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, real_ids, release
from .repeats import ids_differ, keyed, mark_arrays, spans, with_marks

#: Lines of a window.
WINDOW = 3


def windows(docs: DataFrame, window: int) -> DataFrame:
    """docs: i, h, t. Rows i, h, k, a, b: for each window of lines that aren't all blank its first line (from 0) and 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in blocks(batches, "t"):
            rows, places, hashes = [], [], []
            for row, text in enumerate(b.column("t").to_pylist()):
                lines = text.split("\n")
                each = [digest(line.encode("utf-8", "surrogatepass")) if line.strip(" ") else b"" for line in lines]
                some = [k for k in range(len(lines) - window + 1) if any(each[k : k + window])]
                each = [e or digest(line) for e, line in zip(each, lines)]
                rows += [row] * len(some)
                places += some
                hashes += [digest(b"".join(each[k : k + window])) for k in some]
            own = pa.array(rows, pa.int64())
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("i").take(own), b.column("h").take(own), pa.array(places, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["i", "h", "k", "a", "b"])

    return docs.mapInArrow(run, "i long, h long, k int, a long, b long")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """docs: i, h, t. Rows i, h, k: from line k on a window of the row's text that also begins earlier, in this document or one with a smaller i.

    A window's first place is found by partial aggregation, so a common window is combined before it moves, and
    only windows that occur twice are joined back.
    """
    each = Table(windows(docs, window))
    again = each.read().groupBy("a", "b").agg(F.min(F.struct("i", "h", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = each.read().join(again, ["a", "b"]).filter(F.struct("i", "h", "k") > F.col("first")).select("i", "h", "k")
    out = Table(later).read()
    each.drop()
    release(docs.sparkSession)
    return out


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, spans (start and end of the maximal removed runs of lines) and kept (the other lines) of each document.

    Lines end at line feeds. A line is removed if a window of `window` lines that covers it has occurred before: in a
    document with a smaller id, or further up. Windows of blank lines only don't count, nor do texts of
    fewer lines. Null and empty texts are one empty line. A null id comes after all others; rows of one id and
    one text are one document, rows of one id in the order of a hash of their text. Other columns aren't read. An empty table gives no rows.
    """
    d = keyed(docs, id_col, text_col, ids_differ(docs, id_col))
    marked = with_marks(d, repeated_windows(d, window), ["k"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t"):
            count, runs, kept = [], [], []
            for text, m in zip(b.column("t").to_pylist(), mark_arrays(b, ["k"])):
                lines = text.split("\n")
                count.append(len(lines))
                a = z = []
                if m is not None:
                    k = m[0].astype(np.int64)
                    a, z = (x.tolist() for x in spans(len(lines), k, np.full(len(k), window)))
                    text = "\n".join(line for x, y in zip([0, *z], [*a, len(lines)]) for line in lines[x:y])
                runs.append([{"start": x, "end": y} for x, y in zip(a, z)])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([real_ids(b), pa.array(count, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["i", "n_lines", "spans", "kept"])

    out = marked.mapInArrow(finish, "i long, n_lines long, spans array<struct<start: long, end: long>>, kept string")
    return out.select(F.col("i").alias("doc_id"), "n_lines", "spans", "kept")
