"""Zip archives read by entry: central directories first, then entries in tasks by their size, by ranged reads."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize

#: Inflated bytes of the entries that a task opens at a time, about; a larger entry is alone.
CHUNK = 64 << 20
#: An entry that inflates to more is an error, whatever it says of itself.
QUOTA = 256 << 20
#: Bytes that are fetched at once, about.
BUFFER = 1 << 20


def open_file(path: str):
    """A file to seek in, of any file system that pyarrow knows; only what is read of it is fetched."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


#: What is known of an entry: enough to read it without its archive's directory. end: where the next one starts.
ENTRY = "archive string, n int, path string, chunk long, at long, end long, size long, packed long, crc long, method int, flags int, error string"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
#: Entries, or characters of text, that go to Spark at once.
ROWS, TEXT = 10_000, 8 << 20


def _directory(f: io.BufferedReader) -> tuple[int, Iterator[zipfile.ZipInfo]]:
    """Where an archive's central directory starts, and its entries, one at a time. Raises what zipfile does."""
    end = zipfile._EndRecData(f)
    if not end:
        raise zipfile.BadZipFile("File is not a zip file")
    size, offset = end[zipfile._ECD_SIZE], end[zipfile._ECD_OFFSET]
    before = end[zipfile._ECD_LOCATION] - size - offset  # bytes before the archive's own
    if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
        before -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
    start = offset + before
    if start < 0:
        raise zipfile.BadZipFile("Bad offset for central directory")

    def entries() -> Iterator[zipfile.ZipInfo]:
        f.seek(start)
        at = 0
        while at < size:
            head = f.read(zipfile.sizeCentralDir)
            if len(head) != zipfile.sizeCentralDir:
                raise zipfile.BadZipFile("Truncated central directory")
            d = struct.unpack(zipfile.structCentralDir, head)
            if d[zipfile._CD_SIGNATURE] != zipfile.stringCentralDir:
                raise zipfile.BadZipFile("Bad magic number for central directory")
            raw = f.read(d[zipfile._CD_FILENAME_LENGTH])
            x = zipfile.ZipInfo(raw.decode("utf-8" if d[zipfile._CD_FLAG_BITS] & 0x800 else "cp437"))
            x.extra = f.read(d[zipfile._CD_EXTRA_FIELD_LENGTH])
            f.read(d[zipfile._CD_COMMENT_LENGTH])
            x.extract_version, _, x.flag_bits, x.compress_type, _, _, x.CRC, x.compress_size, x.file_size = d[3:12]
            x.header_offset = d[zipfile._CD_LOCAL_HEADER_OFFSET]
            if x.extract_version > zipfile.MAX_EXTRACT_VERSION:
                raise NotImplementedError(f"zip file version {x.extract_version / 10:.1f}")
            x._decodeExtra(zipfile.crc32(raw))
            x.header_offset += before
            yield x
            at += zipfile.sizeCentralDir + sum(d[k] for k in (zipfile._CD_FILENAME_LENGTH, zipfile._CD_EXTRA_FIELD_LENGTH, zipfile._CD_COMMENT_LENGTH))

    return start, entries()


def _listed(archive: str, chunk: int) -> Iterator[pd.DataFrame]:
    """The files of an archive (ENTRY), some at a time. The directory is read twice: for where entries end, which tells those that overlap, and for the rows; of all entries only places are held."""
    try:
        with open_file(archive) as raw, io.BufferedReader(raw, BUFFER) as f:
            start, entries = _directory(f)
            at = np.fromiter((x.header_offset for x in entries), np.int64)
            order = np.argsort(-at, kind="stable")
            ends = np.empty_like(at)
            ends[order[:1]], ends[order[1:]] = start, at[order[:-1]]
            rows, total = [], 0
            for n, x in enumerate(_directory(f)[1]):
                if not x.is_dir():
                    rows.append((archive, n, x.orig_filename, total // chunk, x.header_offset, int(ends[n]), x.file_size, x.compress_size, x.CRC, x.compress_type, x.flag_bits, None))
                    total += max(x.file_size, x.compress_size) + 1
                    if len(rows) == ROWS:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows = []
            yield pd.DataFrame(rows, columns=_NAMES)
    except Exception as error:  # one archive must not end the others
        yield pd.DataFrame([(archive, -1, None, 0, *[0] * 7, f"{type(error).__name__}: {error}")], columns=_NAMES)


def _opened(f: io.BufferedReader) -> zipfile.ZipFile:
    """A file as an archive, without reading its directory."""
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    z = zipfile.ZipFile(empty)
    z.fp = f
    return z


def _info(row) -> zipfile.ZipInfo:
    x = zipfile.ZipInfo(row.path)
    x.header_offset, x._end_offset, x.file_size, x.compress_size, x.CRC, x.compress_type, x.flag_bits = row.at, row.end, row.size, row.packed, row.crc, row.method, row.flags
    return x


def inflated(z: zipfile.ZipFile, info: zipfile.ZipInfo, quota: int) -> str:
    """An entry's text; raises where it is larger than the quota, without holding more than that."""
    if info.file_size > quota:
        raise ValueError(f"{info.file_size} bytes are over the quota of {quota}")
    with z.open(info) as f:
        data = f.read(quota + 1)
    if len(data) > quota:
        raise ValueError(f"more than the quota of {quota} bytes")
    return data.decode("utf-8", "replace")


def read_archives(spark: SparkSession, path: str, quota: int = QUOTA, chunk: int = CHUNK) -> DataFrame:
    """archive, path, content and error of the files in all zip archives under a path.

    Listing reads central directories only, and leaves of each entry what it takes to read it, so a chunk reads no directory again. Entries are cut into chunks by their inflated size, and
    chunks dealt to tasks: a large archive is read by many, each of which fetches the ranges of its entries. An archive that can't be read, and an entry that is broken or over the quota,
    gives a row with an error; the others stay. Entries of one name are rows each.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")

    def list_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["path"]:
                yield from _listed(archive, chunk)

    listed = materialize(found.mapInPandas(list_, ENTRY))
    chunks = listed.select("archive", "chunk").distinct().count()
    columns = ["archive", "path", "content", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, some in b.groupby("archive", sort=False):
                if (some["n"] < 0).any():
                    yield pd.DataFrame([(archive, None, None, e) for e in some["error"]], columns=columns)
                    continue
                with open_file(archive) as raw, io.BufferedReader(raw, BUFFER) as f:
                    z, rows, held = _opened(f), [], 0
                    for row in some.itertuples(index=False):
                        info, text, error = _info(row), None, None
                        try:
                            text = inflated(z, info, quota)
                            held += len(text)
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"
                        rows.append((archive, info.filename, text, error))
                        if len(rows) == ROWS or held > TEXT:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=columns)

    dealt = listed.repartition(max(1, min(chunks, 100_000)), "archive", "chunk").sortWithinPartitions("archive", "chunk", "n")
    return dealt.mapInPandas(read, "archive string, path string, content string, error string")
