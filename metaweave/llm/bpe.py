"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Arcs of the transducer that a process keeps; beyond these it starts afresh. Encoded words it keeps, in each of two generations.
MAX_ARCS, MAX_WORDS = 400_000, 600_000
#: Longer words aren't kept.
KEPT_CHARS = 32
#: Words that are encoded, and ids that are decoded, at once.
STEP = 65_536

_FOREVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


class Transducer:
    """Encodes bytes from left to right, emitting a token as soon as no reading of what follows can change it.

    The BPE of a prefix is the BPE of a shorter prefix and one last token, so a state holds, for each place from
    which a longer token may still begin, where it stands in the trie of tokens and the tokens not yet emitted
    before that place. What all places share is emitted. Tokens are bounded in length, and so is what is held back.
    States and arcs are made as texts ask for them. (The last emitted token is part of a state only where it can matter.)
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = 0
            for byte in token:
                node = self.child[node].setdefault(byte, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.ends.append(-1)
            self.ends[node] = rank
        self._spines: dict[int, tuple] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.start = (-1, ((0, ()),))
        self.number = {self.start: 0}
        self.states = [self.start]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.size = 0

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            best, at = _FOREVER, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], _FOREVER)
                if r < best:
                    best, at = r, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def spines(self, token: int) -> tuple[list, list]:
        """The tokens at its left and at its right border through its merges, each with the rank of the merge that takes it up."""
        found = self._spines.get(token)
        if found is None:
            two = self._parts(token)
            own = (self.tokens[token], _FOREVER)
            if two is None:
                found = ([own], [own])
            else:
                left, right = self.spines(two[0])[0], self.spines(two[1])[1]
                found = ([own, *((t, min(c, token)) for t, c in left)], [own, *((t, min(c, token)) for t, c in right)])
            self._spines[token] = found
        return found

    def fits(self, one: int, two: int) -> bool:
        """Whether the BPE of both tokens' bytes is these tokens: no merge ever crosses the border between them."""
        found = self._fits.get((one, two))
        if found is None:
            get = self.ranks.get
            found = True
            for r, taken_r in self.spines(one)[1]:
                for s, taken_s in self.spines(two)[0]:
                    merge = get(r + s)
                    if merge is not None and merge < taken_r and merge <= taken_s:
                        found = False
            self._fits[one, two] = found
        return found

    def _arc(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, places = self.states[at]
        child, ends, fits = self.child, self.ends, self._fits
        new, last, lone = [], None, False
        for node, held in places:
            node = child[node].get(byte)
            if node is None:
                continue
            if last is None:
                token = ends[node]
                if token >= 0:
                    previous = held[-1] if held else before
                    if previous < 0 or (fits.get((previous, token)) if (previous, token) in fits else self.fits(previous, token)):
                        last = (*held, token)
            if child[node]:
                new.append((node, held))
                if not held:
                    lone = True
        new.append((0, last))
        emitted: tuple[int, ...] = ()
        if not lone:  # else a place before all held tokens is left
            sure = len(last)
            for _, held in new:
                k, n = 0, min(sure, len(held))
                while k < n and held[k] == last[k]:
                    k += 1
                sure = k
                if not k:
                    break
            if sure:
                emitted = last[:sure]
                new = [(node, held[sure:]) for node, held in new]
                before = emitted[-1]
                lone = True
        state = (before if lone else -2, tuple(new))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
        self.arcs[at][byte] = arc = (to, emitted)
        self.size += 1
        return arc

    def encode(self, data: bytes) -> list[int]:
        if self.size > MAX_ARCS:
            self._fresh()
        out: list[int] = []
        at, arcs = 0, self.arcs
        for byte in data:
            arc = arcs[at].get(byte)
            if arc is None:
                if self.size > 4 * MAX_ARCS:  # within one long word: carry the state over
                    state = self.states[at]
                    self._fresh()
                    arcs = self.arcs
                    if state != self.start:
                        self.number[state] = len(self.states)
                        self.states.append(state)
                        arcs.append({})
                    at = self.number[state]
                arc = self._arc(at, byte)
            at, emitted = arc
            if emitted:
                out += emitted
        out += self.states[at][1][-1][1]
        return out


class Utf8Stream:
    """Cuts a stream of bytes after its last whole character; the rest waits for the next piece."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes) -> bytes:
        data = self.rest + data
        end = len(data)
        for back in range(1, min(4, end) + 1):
            lead = data[end - back]
            if lead < 0x80:
                break
            if lead >= 0xC0:
                needs = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if needs > back:
                    end -= back
                break
        self.rest = data[end:]
        return data[:end]

    def close(self) -> bytes:
        rest, self.rest = self.rest, b""
        return rest


class Words(dict):
    """Word -> its ids as little-endian 32-bit numbers. When it is full, what isn't asked for again before it is full once more goes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        data = word.encode("utf-8", "surrogatepass")
        own = self.transducer.ranks.get(data)
        ids = array("I", self.transducer.encode(data) if own is None else [own]).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.words = Words(self.transducer)
        self.pattern = regex.compile(pattern)
        self.names = [str(i) for i in range(len(self.transducer.tokens))]

    def encode(self, text: str) -> np.ndarray:
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > 10 * STEP else iter(self.pattern.findall(text))
        parts = []
        while part := b"".join(map(self.words.__getitem__, itertools.islice(found, STEP))):
            parts.append(part)
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Pieces of the bytes, each of whole characters as far as the bytes are UTF-8."""
        stream, ids, tokens = Utf8Stream(), iter(ids), self.transducer.tokens
        while part := list(itertools.islice(ids, STEP)):
            yield stream.feed(b"".join(map(tokens.__getitem__, part)))
        yield stream.close()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each process and vocabulary."""
    return _codecs.get((path, pattern)) or _codecs.setdefault((path, pattern), Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each whole text; a null or empty text has none. Rows stay apart if ids repeat or are null."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in blocks(batches, "t"):
            ids = [c.encode(t or "").astype(np.int32) for t in b.column("t").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (the bytes) of each array of ids; null counts as empty."""
    d = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            data = [b"".join(c.decode(x or ())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode() and decode() of each text in one pass, with digests of both results.

    Null and empty texts have no tokens. Long texts are encoded and decoded in steps. An empty table gives no rows.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in blocks(batches, "t"):
            n, ids_hex, decoded_hex = [], [], []
            for text in b.column("t").to_pylist():
                ids = c.encode(text or "").tolist()
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                whole = hashlib.sha256()
                for piece in c.decode(ids):
                    whole.update(piece)
                decoded_hex.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
