"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, partitions

#: Length of a vector, letters of an n-gram, and the seed that letters' random vectors follow from.
DIM, N, SEED = 1024, 3, 20240601
#: Documents of one language that a prototype is bundled from, at most; they are taken by the hash of their id.
FIT_PER_LANG = 3000
#: Text that is compared at once: its n-grams are bound together, at most so many of them.
CHARS, BOUND = 250_000, 16_384
#: Letters whose vectors a process keeps.
LETTERS = 30_000
#: What a document without any letter is.
NONE = "und"

_OTHERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_letters: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a code point: the same in all processes."""
    v = _letters.get(code)
    if v is None:
        if len(_letters) >= LETTERS:
            _letters.clear()
        v = _letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        v.setflags(write=False)
    return v


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' vectors, and the number of its n-grams.

    An n-gram's vector is the product of its letters' vectors, each rotated by its place. Letters are lower-cased;
    what stands between words counts as one space. Each different n-gram is bound once a block.
    """
    cleaned = [_OTHERS.sub(" ", t.lower()).strip() for t in texts]
    out, n = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    some = [i for i, t in enumerate(cleaned) if _LETTER.search(t)]
    if not some:
        return out, n
    points = [np.frombuffer(f" {cleaned[i]} ".encode("utf-32-le", "surrogatepass"), "<u4") for i in some]
    lengths = np.array([len(p) for p in points])
    flat = np.concatenate(points)
    alphabet, flat = np.unique(flat, return_inverse=True)
    whose = np.repeat(np.arange(len(some)), lengths)
    size = len(flat) - N + 1
    ok = whose[:size] == whose[N - 1 :]
    codes = np.zeros(size, np.int64)
    for k in range(N):
        codes = codes * len(alphabet) + flat[k : k + size]
    codes, whose = codes[ok], whose[:size][ok]
    kinds, codes = np.unique(codes, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in alphabet])
    width = max(1, min(len(kinds), BOUND, 16_000_000 // max(1, len(some))))
    counts = np.bincount(whose, minlength=len(some))
    order = np.argsort(codes, kind="stable") if len(kinds) > width else None
    for a in range(0, len(kinds), width):
        b = min(a + width, len(kinds))
        w, c = whose, codes
        if order is not None:
            part = order[np.searchsorted(codes, a, sorter=order) : np.searchsorted(codes, b, sorter=order)]
            w, c = whose[part], codes[part]
        table = np.bincount(w * (b - a) + (c - a), minlength=len(some) * (b - a)).reshape(len(some), b - a).astype(np.float32)
        bound, left = None, kinds[a:b]
        for k in reversed(range(N)):
            v = np.roll(letters[left % len(alphabet)], N - 1 - k, axis=1)
            bound = v if bound is None else np.multiply(bound, v, out=bound)
            left = left // len(alphabet)
        out[some] += table @ bound.astype(np.float32)
    n[some] = counts
    return out, n


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = FIT_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the sums of the unit vectors of per_lang documents each at most, of those not held out.

    A label's documents are those with the smallest hashes of id and text, equal rows counting once; where there are more than
    per_lang, about a tenth more than that many are looked at by a threshold first. What the driver gathers is a vector for each language.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"), held_out(id_col).alias("held"))
    own = own.filter("t is not null and l is not null and i is not null and not held")
    own = own.withColumn("x", F.xxhash64("i", "t"))
    share = own.groupBy("l").agg((F.lit(1.1 * per_lang + 100) / F.approx_count_distinct("x", 0.02)).alias("share"))  # a row for each language
    taken = own.join(F.broadcast(share), "l").filter((F.col("x") / F.lit(2.0**64) + 0.5) < F.col("share")).groupBy("l", "x").agg(F.first("t").alias("t"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("x"))
    taken = taken.withColumn("rank", first).filter(F.col("rank") <= per_lang).repartition(partitions(docs.sparkSession), "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in blocks(batches, "t", CHARS):
            v, n = document_vectors([t or "" for t in b.column("t").to_pylist()])
            size = np.linalg.norm(v, axis=1)
            for lang, x, s in zip(b.column("l").to_pylist(), v, size):
                if s > 0:
                    total[lang] = total.get(lang, 0) + (x / s).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["l", "v"])

    parts = taken.select("t", "l").mapInArrow(sums, "l string, v array<double>")
    each = parts.select("l", F.posexplode("v").alias("k", "x")).groupBy("l", "k").agg(F.sum("x").alias("x"))
    rows = each.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("l").collect()  # DIM numbers for each language
    langs = [r.l for r in rows]
    m = np.array([[x.x for x in r.v] for r in rows], np.float64).reshape(len(langs), DIM)
    return langs, (np.round(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), 6)).astype(np.float32)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: tuple | None = None, columns: list[str] | None = None) -> DataFrame:
    """The language of each document whose prototype has the largest cosine with the document's vector, which is the score (0 to 1).

    columns: of docs, returned beside doc_id, held_out, lang_pred and score (none by default); names that clash with these can't be asked for.
    Only text is looked at. Null texts and texts without a letter are `und` with score 0, as all are if nothing
    could be learned. Ties go to the first language in order of name. Ids may repeat or be null (not held out, not learned from).
    Long texts are whole: their n-grams are counted in full. An empty table gives no rows.
    """
    langs, prototypes = model or fit(docs, id_col, text_col, lang_col)
    columns = columns or []
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("__t"), *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(columns)])
    extra = [f"__{k}" for k in range(len(columns))]
    fields = {f.name: f for f in d.schema.fields}
    schema = "lang_pred string, score double, doc_id " + fields["doc_id"].dataType.simpleString() + ", held_out boolean" + "".join(f", {c} {fields[c].dataType.simpleString()}" for c in extra)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "__t", CHARS):
            v, n = document_vectors([t or "" for t in b.column("__t").to_pylist()])
            names, scores = [NONE] * len(n), np.zeros(len(n))
            if langs:
                cosine = (v @ prototypes.T).astype(np.float64) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                best = np.argmax(cosine, axis=1)
                known = n > 0
                scores = np.where(known, np.clip(cosine[np.arange(len(n)), best], 0.0, 1.0), 0.0)
                names = [langs[k] if ok else NONE for k, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), b.column("doc_id"), b.column("held_out"), *[b.column(c) for c in extra]], ["lang_pred", "score", "doc_id", "held_out", *extra])

    out = (d if extra else d).mapInArrow(predict, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(e).alias(c) for e, c in zip(extra, columns)])
