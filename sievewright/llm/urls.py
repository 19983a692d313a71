"""URL filtering: rules by host and path, and a ratio of two character language models for the rest.

Everything is DataFrame functions. The models are interpolated (Witten-Bell) over contexts of zero to ORDER - 1
characters, counted over all URLs that rules decide; a URL's score is the mean over its characters of the log
ratio of the accepted to the rejected model, and the threshold is the one with the best balanced accuracy on the
fifth of the decided URLs that the counts leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, Scratch, small

ORDER = 5
FOLDS = 5
STEP = 0.005  # resolution of the threshold; scores are clipped to +-BOUND for it, so at most 2 * BOUND / STEP rows
BOUND = 10.0
PARTS = 10**12  # log ratios are added up as whole numbers of so many parts of one: sums don't rest on their order
START, END = "\x01", "\x02"

RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/ ? #``, and path up to ``? #``; both empty without one."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does."""
    rule = verdict = None
    for text, allowed in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, begin = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{begin}")
        rule = F.when(fits, F.lit(text)).otherwise(rule if rule is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, F.lit("allow" if allowed else "block")).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return rule, verdict


def grams(url: Column) -> Column:
    """The windows of ORDER characters that end at each character of a URL and at its end."""
    padded = F.concat(F.lit(START * (ORDER - 1)), url, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def model(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, uses, ratio) of every gram of ``urls(url, label, n)``; label is true, false or null (not learned from).
    uses counts its windows in all of them, ratio is in PARTS."""
    each = urls.select(F.explode(grams(F.col("url"))).alias("gram"), "label", "n")
    one = lambda y: F.sum(F.when(F.col("label") == F.lit(y), F.col("n")).otherwise(0))
    top = scratch.table(each.groupBy("gram").agg(F.count("*").alias("uses"), one(True).alias("a"), one(False).alias("r")), "grams")
    known = None
    for k in range(1, ORDER + 1):
        g = F.substring("gram", ORDER - k + 1, k)
        level = (top if k == ORDER else top.groupBy(g.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))).withColumn("ctx", F.substring("gram", 1, k - 1))
        here = W.partitionBy("ctx")  # at most as many rows as there are characters
        for c in "ar":
            level = level.withColumn(f"n{c}", F.sum(c).over(here)).withColumn(f"t{c}", F.sum((F.col(c) > 0).cast("long")).over(here))
        if known is None:
            level = level.withColumn("pa", F.lit(1.0 / 256)).withColumn("pr", F.lit(1.0 / 256))
        else:
            level = level.withColumn("low", F.substring("gram", 2, k - 1)).join(small(known), "low")
        for c in "ar":
            blend = (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))
            level = level.withColumn(f"p{c}", F.when(F.col(f"n{c}") > 0, blend).otherwise(F.col(f"p{c}")))
        if k < ORDER:
            known = scratch.table(level.select(F.col("gram").alias("low"), "pa", "pr"), f"level{k}")
    return scratch.table(level.select("gram", "uses", F.round((F.log("pa") - F.log("pr")) * PARTS).cast("long").alias("ratio")), "model")


def summed(urls: DataFrame, ratios: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, score): the mean log ratio of the grams of each of ``urls(url)``.

    The grams used most, a bounded number, are broadcast, and with them every hot key. What they leave is counted for
    each URL and gram before it meets the rest of the model by a shuffle.
    """
    few = ratios.count() <= BROADCAST_ROWS
    most = ratios if few else scratch.table(ratios.orderBy(F.desc("uses"), "gram").limit(BROADCAST_ROWS), "most")
    each = urls.select("url", F.explode(grams(F.col("url"))).alias("gram")).join(F.broadcast(most.select("gram", "ratio")), "gram", "left")
    if few:
        sums = each.groupBy("url").agg(F.sum("ratio").alias("s"), F.count("*").alias("k"))
    else:
        known = each.where("ratio is not null").groupBy("url").agg(F.sum("ratio").alias("s"), F.count("*").alias("k"))
        rest = each.where("ratio is null").groupBy("url", "gram").agg(F.count("*").alias("k"))
        rest = rest.join(ratios.select("gram", "ratio"), "gram").select("url", (F.col("ratio") * F.col("k")).alias("s"), "k")
        sums = known.unionByName(rest).groupBy("url").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    return sums.select("url", (F.col("s") / F.col("k") / PARTS).alias("score"))


def judged(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    The models read host and path, never what follows ``?`` or ``#``. The score is null where a rule decides. A URL that is null or has no ``://`` is the empty string to the models.
    With no accepted or no rejected URL to learn from, the models allow. Equal rows get equal answers; an empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").alias("url"))
    urls = scratch.table(rows.groupBy("url").agg(F.max("by_rule").alias("by_rule"), F.count("*").alias("n")).withColumn("apart", F.expr(f"crc32(url) % {FOLDS} = 0")), "urls")
    label = F.when(~F.col("apart"), F.col("by_rule") == "allow")
    ratios = model(urls.select("url", label.alias("label"), "n"), scratch)
    asked = urls.where("by_rule is null or apart")
    found = summed(asked.select("url"), ratios, scratch).select(F.col("url").alias("_url"), "score")
    scores = scratch.table(asked.join(found, F.col("url") == F.col("_url")).select("url", "by_rule", "n", "score"), "scores")
    bins = scores.where("by_rule is not null").groupBy(F.floor(F.least(F.greatest("score", F.lit(-BOUND)), F.lit(BOUND)) / STEP).alias("bin"))
    bins = bins.agg(F.sum(F.when(F.col("by_rule") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0)).alias("r"))
    down, whole = W.orderBy(F.desc("bin")), W.partitionBy()
    cut = bins.select("bin", F.sum("a").over(down).alias("a_in"), F.sum("r").over(down).alias("r_in"), F.sum("a").over(whole).alias("a_all"), F.sum("r").over(whole).alias("r_all"))
    best = cut.where("a_all > 0 and r_all > 0").select("bin", (F.col("a_in") / F.col("a_all") - F.col("r_in") / F.col("r_all")).alias("gain")).orderBy(F.desc("gain"), "bin").limit(1).collect()
    threshold = float(best[0].bin) * STEP if best else float("-inf")
    found = scores.where("by_rule is null").select(F.col("url").alias("_url"), "score")
    out = rows.join(small(scratch.table(found, "found")), F.col("url") == F.col("_url"), "left")
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
