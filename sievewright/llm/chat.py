"""Multi-party perspective rotation, in DataFrame functions alone.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named users;
the mask holds the spans of the text that the assistant wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, small

#: A row renders so many turns and about so many characters at most; only a larger dialogue goes on in further rows.
PART_TURNS, PART_CHARS = 4096, 1 << 20
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
ORDER = ("last", "turn", "who", "said")


def _plain(text: Column) -> Column:
    """Text in which no mark can begin."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(who: Column, speaker: Column | None, system: str) -> Column:
    """The opening of a turn; with no speaker, as all others see it."""
    named = F.concat(F.lit(f"{BEGIN}user name="), _plain(F.regexp_replace(who, r"[\r\n]", " ")), F.lit("\n"))
    out = F.when(who == system, F.lit(f"{BEGIN}system\n"))
    if speaker is not None:
        out = F.when(who == speaker, F.lit(f"{BEGIN}assistant\n")).when(who == system, F.lit(f"{BEGIN}system\n"))
    return out.otherwise(named)


def _body(said: Column) -> Column:
    return F.concat(_plain(said), F.lit(END))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, part, start, speaker, n_turns, rendered, mask) for every dialogue and participant.

    mask is an array of (start, length) in code points of rendered: the assistant's words and its end mark. Turns
    by ``system`` stay system turns; it is no participant, so a dialogue of system turns alone renders nothing.
    Turns go by number (nulls last), ties by speaker and text; a repeated row is one turn. A null speaker is
    "unknown", a null text empty; marks inside a text and line ends inside a name are broken up. Null dialogue ids
    are one dialogue. Other columns, whatever their names, are ignored; an empty table gives an empty result.

    A dialogue is one row for each participant (part 0, start 0) unless it is very large: then it goes on in parts of
    rising number, cut between turns, and start is the place of a part in the whole. Parts put one after the other are
    the whole rendering, whose size a string and a task could not hold.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).isNull().alias("last"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("who"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    chars = F.length(F.col("said")) + F.length(F.col("who")) + 40
    large = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(chars).alias("chars")).where((F.col("n") > PART_TURNS) | (F.col("chars") > PART_CHARS))
    large = scratch.table(large.select(F.col("conv_id").alias("of"), "n"), "large")
    known = F.col("conv_id").eqNullSafe(F.col("of"))
    huge = large.agg(F.sum("n")).first()[0]
    usual = rows.join(small(large), known, "left_anti") if huge else rows
    whole = usual.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(*ORDER))).alias("turns"))  # PART_TURNS and PART_CHARS at most
    people = F.array_distinct(F.filter(F.transform("turns", lambda t: t["who"]), lambda w: w != system))
    whole = whole.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"), F.explode(people).alias("speaker"), F.transform("turns", lambda t: F.struct(t["who"].alias("who"), t["said"].alias("said"))).alias("turns"))
    if huge:
        whole = whole.unionByName(_parts(rows.join(small(large), known, "left_semi"), int(huge), system, scratch))
    return _rendered(whole, system)


def _parts(rows: DataFrame, n: int, system: str, scratch: Scratch) -> DataFrame:
    """(conv_id, part, start, speaker, turns) of large dialogues: sorted in ranges, with sums carried from range to range.

    No task holds a dialogue. The result rests on the order of turns alone, not on where ranges begin.
    """
    ranges = max(1, -(-n // (4 * PART_TURNS)))
    order = ["conv_id", "last", "turn", "who", F.substring("said", 1, 256)]
    placed = rows.distinct().repartitionByRange(ranges, *order).sortWithinPartitions("conv_id", *ORDER)
    placed = scratch.table(placed.withColumn("range", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()), "ordered")
    size = F.length(_head(F.col("who"), None, system)) + F.length(_body(F.col("said")))
    placed = placed.withColumn("size", size.cast("long"))
    sums = placed.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are ranges
    base = scratch.table(sums.select(F.col("conv_id").alias("of"), F.col("range").alias("at"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("n", "chars"))), "base")
    here = W.partitionBy("conv_id", "range").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("n_here", F.coalesce(F.count("*").over(here), F.lit(0))).withColumn("chars_here", F.coalesce(F.sum("size").over(here), F.lit(0)))
    met = local.join(base, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    part = F.floor((F.col("n_here") + F.col("base_n")) / PART_TURNS) + F.floor((F.col("chars_here") + F.col("base_chars")) / PART_CHARS)
    cut = scratch.table(met.select("conv_id", part.cast("long").alias("part"), "k", "who", "said", "size"), "parts")

    people = scratch.table(cut.where(F.col("who") != system).select(F.col("conv_id").alias("c"), F.col("who").alias("speaker")).distinct(), "people")
    parts = cut.groupBy("conv_id", "part").agg(F.sum("size").alias("seen"))
    own = cut.groupBy(F.col("conv_id").alias("oc"), F.col("part").alias("op"), F.col("who").alias("ow")).agg(F.count("*").alias("own"))
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    each = each.join(own, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("part") == F.col("op")) & (F.col("speaker") == F.col("ow")), "left")
    saved = F.length(_head(F.col("speaker"), None, system)) - len(f"{BEGIN}assistant\n")
    each = each.withColumn("size", F.col("seen") - F.coalesce("own", F.lit(0)) * saved)
    earlier = W.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    starts = each.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "speaker", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long").alias("start"))
    held = cut.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("k", "who", "said"))).alias("turns"))  # PART_TURNS and about PART_CHARS at most
    out = held.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return out.select("conv_id", "part", "start", "speaker", F.transform("turns", lambda t: F.struct(t["who"].alias("who"), t["said"].alias("said"))).alias("turns"))


def _rendered(parts: DataFrame, system: str) -> DataFrame:
    me = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(_head(t["who"], me, system).alias("head"), _body(t["said"]).alias("body"), (t["who"] == me).alias("own")))
    each = parts.withColumn("pieces", pieces)
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(a, p):
        begin = a["at"] + F.length(p["head"])
        span = F.struct(begin.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((begin + F.length(p["body"])).alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return each.select("conv_id", "part", "start", "speaker", F.size("turns").alias("n_turns"), text.alias("rendered"), F.aggregate("pieces", zero, step)["spans"].alias("mask"))
