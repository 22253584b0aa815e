"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprint, language_id, lexical, line_dedup, minhash, packing, simhash, substring_dedup, suffix_dedup, url_filter, vector_codes

#: Fixed values of the query op9: its rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", substring_dedup.removed_count().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_components(table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.document_spans(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)
    return d.select("page_id", "host", "path", "rule", "verdict", "score")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return d.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"), words=2)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return d.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_exact_dedup, op5_best_fit_packing, op6_byte_bpe, op7_substring_dedup, op8_language_id, op9_url_filter, op10_fingerprint, op11_vector_codes, op12_minhash_near_dedup, op13_lexical_search)}

#: Parts of the SQL of op11: a squared distance, and a round that moves the codebooks' entries.
DISTANCE = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
ROUND = f"""a{{a}} AS (SELECT vec_id, p, v.x, min([{DISTANCE}, b.e]) AS m FROM v JOIN b{{a}} AS b USING (p) GROUP BY ALL),
        s{{a}} AS (SELECT p, m[2] AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS y FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS j FROM a{{a}}) GROUP BY ALL),
        b{{b}} AS (SELECT p, e, coalesce(n.x, b.x) AS x FROM b{{a}} AS b LEFT JOIN (SELECT p, e, list(y ORDER BY j) AS x FROM s{{a}} GROUP BY ALL) AS n USING (p, e))"""

ORACLE_SQL = {
    "op1_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        w AS (SELECT doc_id, k, a[k:k + 2] AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS k FROM l)),
        f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM w WHERE trim(s[1], ' ') || trim(s[2], ' ') || trim(s[3], ' ') <> ''),
        c AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS p FROM f WHERE r > 1),
        g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.doc_id = c.doc_id AND b.p = c.p - 1)) AS runs FROM c GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS line FROM l),
        k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(a) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
        FROM l LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        p AS (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS k FROM d),
        b AS (SELECT doc_id, k, substr(x, 2 * k + 1, 2) AS byte, substr(x, 2 * k + 1, 100) AS s FROM p),
        m AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS f FROM b WHERE length(s) = 100),
        c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM m WHERE f < doc_id),
        g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE k <> before + 1 OR before IS NULL) AS runs FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c) GROUP BY doc_id),
        r AS (SELECT doc_id, string_agg(byte, '' ORDER BY k) AS kept FROM b ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op7_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k, len(w) AS n FROM d),
        x AS (SELECT doc_id, k, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM p),
        m AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS f FROM x WHERE k <= n - 49),
        c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM m WHERE f < doc_id),
        r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS left FROM p ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(r.left, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op11_vector_codes": f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        v AS (SELECT vec_id, label, p, list_slice(x, p * w + 1, (p + 1) * w) AS x FROM (SELECT *, len(x) // 16 AS w, unnest(range(0, 16)) AS p FROM k)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v SEMI JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),
        {", ".join(ROUND.format(a=a, b=a + 1) for a in range(2))},
        z AS (SELECT vec_id, label, p, min([{DISTANCE}, b.e]) AS m FROM v JOIN b2 AS b USING (p) GROUP BY ALL),
        c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM z GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM c""",
    "op12_minhash_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_lexical_search": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
        c AS (SELECT count(DISTINCT doc_id) AS big_n, count(*) AS big_l FROM t),
        m AS (SELECT doc_id, 100 - 50 + (50 * count(*) * any_value(big_n)) // any_value(big_l) AS m FROM t, c GROUP BY doc_id),
        f AS (SELECT doc_id, t, count(*) AS tf FROM t SEMI JOIN q USING (t) GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY rank <= 50""",
}
