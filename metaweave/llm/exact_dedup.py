"""Exact deduplication by content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts with more copies than a HOT_SHARE-th of all rows, and than HOT_ROWS, are dealt to several tasks; so at most HOT_SHARE texts are.
HOT_SHARE, HOT_ROWS = 4096, 256
#: Splitters are sampled from so many leading characters and a hash: the driver never gathers whole texts.
HEAD = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """Groups rows of equal text; the row with the largest id stays.

    Sampled splitters range-partition the bytes (repartitionByRange on the leading bytes and a hash), an external
    sort puts equal texts side by side, and the window compares each row's whole text with its neighbour's.
    A text that many rows share is counted before the shuffle and its rows are dealt out by a salt.

    normalise: Column -> Column, None for no change. Returns the columns of docs in a struct `row` (text included), and
    keep_id, group_size, kept, text_sha256. Null texts count as empty; null ids count as smaller than all others;
    rows that repeat with one id and text are one group, of which one row stays. Empty tables give none.
    Column names of docs can't clash, as they stay inside `row`.
    """
    change = normalise or (lambda c: c)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col or normalise]
    d = docs.select(F.col(f"`{id_col}`").alias("i"), change(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"), F.col(f"`{text_col}`").isNull().alias("z"), F.struct(*others).alias("r"))
    d = d.withColumn("h", F.xxhash64("t"))
    limit = max(HOT_ROWS, docs.count() // HOT_SHARE)
    hot = d.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > limit)  # at most HOT_SHARE rows
    hot_sums = F.broadcast(
        d.join(F.broadcast(hot.select("h")), "h", "left_semi").groupBy(F.sha2("t", 256).alias("s")).agg(F.max("i").alias("hot_keep"), F.count("*").alias("hot_size"))
    )
    salt = F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.xxhash64("i"), F.floor(F.col("c") / limit) + 1))
    d = d.join(F.broadcast(hot), "h", "left").withColumn("k", salt.cast("long")).drop("c").withColumn("p", F.substring("t", 1, HEAD))
    by = Window.partitionBy("p", "h", "k", "t").orderBy(F.col("i").desc_nulls_last())
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.repartitionByRange("p", "h", "k").select("*", F.first("i").over(whole).alias("keep"), F.count("*").over(whole).alias("size"), F.row_number().over(by).alias("n"))
    d = d.withColumn("s", F.sha2("t", 256)).join(hot_sums, "s", "left")
    keep = F.when(F.col("hot_size").isNull(), F.col("keep")).otherwise(F.col("hot_keep"))
    text = F.when(~F.col("z"), F.col("t")).alias(text_col) if not normalise else F.col(f"r.`{text_col}`")
    row = F.struct(*[text if c == text_col else F.col(f"r.`{c}`").alias(c) for c in docs.columns]).alias("row")
    return d.select(row, keep.alias("keep_id"), F.coalesce("hot_size", "size").alias("group_size"), ((F.col("n") == 1) & F.col("i").eqNullSafe(keep)).alias("kept"), F.col("s").alias("text_sha256"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    d = exact_dedup(docs, **options).filter("kept")
    return d.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def case_folded(c: Column) -> Column:
    """A normaliser: lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
