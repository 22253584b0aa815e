"""URL filter: host and path rules, else a ratio of two character language models, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

#: 32 symbols: a-z, one for all digits, / . - , one for ? & = #, one for the rest.
SYMBOLS = 32
#: Characters before the one that is predicted, at most: the models hold SYMBOLS ** (ORDER + 1) numbers, whatever the input.
ORDER = 3
#: A FOLD-th of the labelled URLs, by hash, sets the threshold; the rest are counted. Scores are told apart to a BIN-th.
FOLD, BIN, SPAN = 5, 100, 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does. rules: (action, `host/path`)."""
    name = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def gram_codes(url: Column) -> Column:
    """An array with a number for each character and the ORDER ones before it."""
    s = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[^:]*://", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[0-9]", "{"), r"[^a-z{/.\-?&=#]", "_"), r"[?&=#]", "`")
    s = F.translate(s, "/.-", "|}~")
    codes = F.transform(F.regexp_extract_all(F.concat(F.lit("|" * ORDER), s), F.lit("(?s)."), F.lit(0)), lambda x: F.pmod(F.ascii(x) - 97, F.lit(SYMBOLS)))
    width = SYMBOLS**ORDER

    def grams(own: Column) -> Column:
        index = F.sequence(F.lit(1), F.size(own) - ORDER)
        gram = F.transform(index, lambda i: sum((F.element_at(own, i + k) * (width // SYMBOLS**k) for k in range(ORDER + 1)), F.lit(0)).cast("int"))
        return F.when(F.size(own) > ORDER, gram).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(codes), grams), F.lit(0))  # so a URL's codes are made once, not for each character


def markov_model(grams: DataFrame) -> DataFrame:
    """grams: (code, good). For each code `r`: log P(character | context) of good less that of bad.

    Each context blends its own counts with the next shorter one's (Witten-Bell), down to a uniform one; both
    models take all rows. The counts are at most SYMBOLS ** (ORDER + 1) rows.
    """
    spark = grams.sparkSession
    counts = grams.groupBy("code").agg(*[F.sum(F.when(F.col("good") == g, 1).otherwise(0)).alias(n) for g, n in ((True, "g"), (False, "b"))])
    counts = Table(counts).read()
    d = spark.range(SYMBOLS ** (ORDER + 1)).select(F.col("id").cast("int").alias("code"), F.lit(1.0 / SYMBOLS).alias("pg"), F.lit(1.0 / SYMBOLS).alias("pb"))
    for order in range(ORDER + 1):
        size = SYMBOLS ** (order + 1)
        own = counts.groupBy((F.col("code") % size).alias("own")).agg(F.sum("g").alias("ng"), F.sum("b").alias("nb"))
        context = own.groupBy(F.floor(F.col("own") / SYMBOLS).cast("int").alias("ctx")).agg(*[f for n in "gb" for f in (F.sum("n" + n).alias("s" + n), F.sum((F.col("n" + n) > 0).cast("int")).alias("t" + n))])
        d = d.withColumns({"own": F.col("code") % size, "ctx": F.floor((F.col("code") % size) / SYMBOLS).cast("int")})
        d = d.join(own, "own", "left").join(context, "ctx", "left").na.fill(0, ["ng", "nb", "sg", "sb", "tg", "tb"])
        blend = {"p" + n: F.when(F.col("s" + n) > 0, (F.col("n" + n) + F.col("t" + n) * F.col("p" + n)) / (F.col("s" + n) + F.col("t" + n))).otherwise(F.col("p" + n)) for n in "gb"}
        d = d.withColumns(blend).select("code", "pg", "pb")
    return d.select("code", (F.log("pg") - F.log("pb")).alias("r"))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls: __u and other columns. The other columns and `score`, the mean of the log ratios of the URL's characters.

    The model is broadcast: it has SYMBOLS ** (ORDER + 1) rows, whatever the input. A row's sum stays in its task
    until the combined sums move.
    """
    others = [c for c in urls.columns if c != "__u"]
    d = urls.withColumn("__row", F.monotonically_increasing_id()).select(*others, "__row", F.explode_outer(gram_codes(F.col("__u"))).alias("code"))
    d = d.join(F.broadcast(model), "code", "left").groupBy("__row", *others).agg(F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 9).alias("score"))
    return d.drop("__row")


def threshold(labelled: DataFrame) -> DataFrame:
    """labelled: (score, good). One row with `cut`: the score that tells the two apart with the fewest errors, each class counting alike, in the middle of a gap; 0 without both."""
    at = F.greatest(F.lit(-SPAN * BIN), F.least(F.lit(SPAN * BIN), F.floor(F.col("score") * BIN))).cast("int")
    bins = labelled.groupBy(at.alias("bin")).agg(F.sum(F.col("good").cast("int")).alias("g"), F.sum((~F.col("good")).cast("int")).alias("b"))
    # at most 2 * SPAN * BIN + 1 bins, whatever the input
    a = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "g", "b"))).alias("a"), F.sum("g").alias("sg"), F.sum("b").alias("sb"))
    middle = lambda x, i: (x["bin"] + F.coalesce(F.get(F.col("a"), i - 1)["bin"] + 1, x["bin"])) / F.lit(2.0 * BIN)  # noqa: E731  of the gap below a bin
    below = F.transform(F.col("a"), lambda x, i: F.struct(
        (F.aggregate(F.col("a"), F.lit(0.0), lambda s, y: s + F.when(y["bin"] < x["bin"], y["g"]).otherwise(0)) / F.col("sg")
         + F.aggregate(F.col("a"), F.lit(0.0), lambda s, y: s + F.when(y["bin"] >= x["bin"], y["b"]).otherwise(0)) / F.col("sb")).alias("e"),
        F.abs(middle(x, i)).alias("far"), middle(x, i).alias("cut")))
    best = F.when((F.col("sg") > 0) & (F.col("sb") > 0), F.array_min(below)["cut"]).otherwise(F.lit(0.0))
    return a.select(F.coalesce(best, F.lit(0.0)).alias("cut"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict on each URL: that of the longest rule that fits, else that of two character models.

    URLs that rules allow or block train a smoothed variable-order Markov model each; a URL that no rule fits is
    blocked if its length-normalised log-likelihood difference is below a threshold set on labelled URLs that were
    not counted. Returns page_id, host, path, rule, verdict, score (null where a rule decides) for each row. A null URL, or one without
    `://`, has an empty host and path; an empty string scores 0. Without labelled URLs of both kinds the models are alike or the threshold is 0.
    Repeated rows get a verdict each, and train each; other columns aren't read; an empty table gives no rows.
    """
    d = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("__u"))
    host, path = url_parts(F.col("__u"))
    d = d.select("page_id", "__u", host.alias("host"), path.alias("path"))
    name, action = match_rule(F.col("host"), F.col("path"), rules)
    d = d.select("*", name.alias("rule"), action.alias("action"))
    known = d.filter(F.col("action").isNotNull()).select("__u", (F.col("action") == "allow").alias("good"), (F.pmod(F.xxhash64("__u"), F.lit(FOLD)) == 0).alias("held"))
    grams = known.filter("not held").select(F.explode(gram_codes(F.col("__u"))).alias("code"), "good")
    model = Table(markov_model(grams)).read()
    cut = Table(threshold(scored(known.filter("held").select("__u", "good"), model))).read()
    rest = scored(d.filter("action is null").select("__u", "page_id", "host", "path"), model)
    rest = rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block").alias("verdict"), "score")
    return d.filter("action is not null").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(rest)
