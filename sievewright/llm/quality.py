"""Quality rules with adaptive thresholds.

Counts of each text are made by vectorised kernels; thresholds come from quantile sketches per (lang, source), merged
upwards to the language and to the corpus for groups with few texts; a join brings each text its limits.

A sketch is a histogram of fixed cells, 64 to each doubling of a value, so merging is adding up: neither the order of
rows nor a task that runs twice can change a limit. A quantile is off by one part in 64 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, Scratch, free, small, without
from .textkernel import SPACE, Words, _powers, mix64, window_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: measure -> (numerator and denominator of the counts, least slack beyond the fence)
MEASURES = {
    "word_length": ("word_chars", "n_words", 1.5),
    "symbol_share": ("n_symbols", "n_words", 0.1),
    "line_repeat_share": ("n_dup_lines", "n_lines", 0.4),
}
SPREADS = 8  # half-spreads (median to the quartile on the other side) between the median and the fence
LEAST_TEXTS = 100  # a group with fewer texts takes the limits of its language, a language with fewer those of the corpus
UNIT = 1 << 16  # values are whole numbers of so many parts of one
CELLS = 64  # sketch cells to each doubling of a value


def _per_row(chunk: Words, row_of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal to the one before it in that order) of keys within rows."""
    both = mix64(keys + mix64(row_of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = both[order][1:] == both[order][:-1]
    return order, same


def _counts(chunk: Words, window: int) -> np.ndarray:
    rows, raw, n = chunk.rows, chunk.raw, len(chunk.rows) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(raw):
        return out
    per_row = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[rows])
    out[:, 0] = np.diff(chunk.first)
    out[:, 1] = per_row(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    out[:, 2] = per_row(SYMBOL[raw])
    # lines that hold a word
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate((rows[:-1][rows[:-1] < rows[1:]], (breaks + 1)[breaks + 1 < len(raw)])))
    ends = np.concatenate((starts[1:], [len(raw)]))
    closed = raw[ends - 1] == 10  # a line ends before its break, or with its row
    last = ends - closed
    held = np.searchsorted(chunk.start, last) > np.searchsorted(chunk.start, starts)
    starts, last = starts[held], last[held]
    if len(starts):
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        line_row = np.searchsorted(rows, starts, "right") - 1
        order, same = _per_row(chunk, line_row, mix64((sums[last] - sums[starts]) * down[starts]))
        out[:, 3] = np.bincount(line_row, minlength=n)
        out[:, 4] = np.bincount(line_row[order[same]], minlength=n)
    # words in windows found more than once in the row
    total = len(chunk.start)
    if total >= window:
        hashes = window_hashes(chunk.hashes(lower=False), window)
        row_of = np.repeat(np.arange(n), out[:, 0])
        whole = np.flatnonzero(row_of[: len(hashes)] == row_of[window - 1 :])
        order, same = _per_row(chunk, row_of[whole], hashes[whole])
        twice = same.copy()
        twice[:-1] |= same[1:]
        found = whole[order[twice]]
        edge = np.bincount(found, minlength=total + 1) - np.bincount(found + window, minlength=total + 1 + window)[: total + 1]
        out[:, 5] = np.bincount(row_of, weights=np.cumsum(edge)[:total] > 0, minlength=n)
    return out


def with_counts(docs: DataFrame, text: str = "text", window: int = 8, name: str = "_q") -> DataFrame:
    """``docs`` with a struct column ``name`` of COUNTS. A null text has zeros."""
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            parts = [_counts(chunk, window) for chunk in words(batch.column(at))]
            made = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            q = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(COUNTS))], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, q], [*names, name])

    schema = docs.select("*", F.lit(None).cast("struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">").alias(name)).schema
    return docs.mapInArrow(run, schema)


def base_failed(q: Column) -> Column:
    """Fixed rules: fewer than 20 words, or over 30 % of words in repeated windows."""
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def _value(q: Column, measure: str) -> Column:
    """The measure in whole UNITs, rounded down."""
    over, under, _ = MEASURES[measure]
    return F.call_function("div", q[over] * UNIT, F.greatest(q[under], F.lit(1).cast("long")))


def _cell(value: Column) -> Column:
    """The least value of the cell of ``value``: all but its first seven bits are cleared."""
    bits = F.greatest(F.length(F.bin(value)) - (CELLS.bit_length()), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def limits(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, limits: struct of lo_<measure> and hi_<measure>, in UNITs) of every group of ``counted(lang, source, q)``.

    Only texts that pass the fixed rules count. A limit lies SPREADS half-spreads and a least slack beyond the median;
    the half-spread is taken on the other side of the median, so up to half of a group may be bad without moving its
    limits far.
    """
    q = F.col("q")
    each = F.array(*(F.struct(F.lit(m).alias("measure"), _cell(_value(q, m)).alias("cell")) for m in MEASURES))
    rows = counted.where(~base_failed(q)).select("lang", "source", F.inline(each))
    sketches = scratch.table(rows.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n")), "sketches")

    def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
        """(by, n, q25, q50, q75): the value whose rank is the quantile's share of n, rounded up."""
        here = W.partitionBy(*by)  # the cells of a sketch: some thousands at most
        up = sketch.withColumn("upto", F.sum("n").over(here.orderBy("cell"))).withColumn("all", F.sum("n").over(here))
        at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("cell")))
        return up.groupBy(*by).agg(F.max("all").alias("n"), F.struct(at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75")).alias("cut"))

    own = quartiles(sketches, ["lang", "source", "measure"])
    by_lang = quartiles(sketches.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")), ["lang", "measure"])
    whole = quartiles(sketches.groupBy("measure", "cell").agg(F.sum("n").alias("n")), ["measure"])
    by_lang = by_lang.select(F.col("lang").alias("of"), F.col("measure").alias("m"), F.col("n").alias("n_lang"), F.col("cut").alias("cut_lang"))
    whole = whole.select(F.col("measure").alias("m"), F.col("cut").alias("cut_all"))  # a row for each measure
    met = own.join(by_lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("m"))).drop("m").join(F.broadcast(whole), F.col("measure") == F.col("m"))
    cut = F.when(F.col("n") >= LEAST_TEXTS, F.col("cut")).when(F.col("n_lang") >= LEAST_TEXTS, F.col("cut_lang")).otherwise(F.col("cut_all"))
    met = met.withColumn("c", cut)
    out = []
    for m, (_, _, slack) in MEASURES.items():
        c, least = F.col("c"), int(slack * UNIT)
        lo, hi = c["q50"] - SPREADS * (c["q75"] - c["q50"]) - least, c["q50"] + SPREADS * (c["q50"] - c["q25"]) + least
        out += [F.max(F.when(F.col("measure") == m, x)).alias(f"{side}_{m}") for side, x in (("lo", lo), ("hi", hi))]
    made = met.groupBy("lang", "source").agg(*out)
    return scratch.table(made.select("lang", "source", F.struct(*(f"{side}_{m}" for m in MEASURES for side in ("lo", "hi"))).alias("limits")), "limits")


def _within(q: Column, found: Column) -> Column:
    out = F.lit(True)
    for m in MEASURES:
        out &= _value(q, m).between(found[f"lo_{m}"], found[f"hi_{m}"])
    return F.coalesce(out, F.lit(True))


def counted(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, lang, source, mark, q) of every row, written: its counts, and a hash of its text and group. No text is kept."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.xxhash64(text, lang, source).alias("mark"), F.col(text).alias("text"))
    return scratch.table(with_counts(slim, "text", name="q").drop("text"), "counts")


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, lang, source, mark, q: COUNTS, failed: by the fixed rules, kept: false if failed or beyond a limit) of every row.

    Null languages and sources are groups of their own. A text with few words, none or null fails the fixed rules.
    Rows are judged one by one: repeated ids and rows do no harm. Other columns, whatever their names, are ignored.
    An empty table, or one of which no text passes the fixed rules, has no limits and gives no other verdicts. Texts
    are read once and never shuffle; only counts meet the limits. Reruns, retries and other partitionings agree.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = counted(docs, scratch, id_col, text, lang, source)
    found = limits(rows, scratch).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    both = rows.join(small(found), F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = base_failed(F.col("q"))
    return both.select("id", "lang", "source", "mark", "q", failed.alias("failed"), (~failed & _within(F.col("q"), F.col("limits"))).alias("kept"))


def passed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, in all their columns, whatever the names of these.

    With a counted, broadcast table of limits texts are read and counted a second time and never shuffle. With more
    groups than may be broadcast, the ids of rejected rows go out by an anti join, which shuffles by a hash of the row.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    slim = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    found = limits(with_counts(slim, "text", name="q").drop("text"), scratch)
    if found.count() > BROADCAST_ROWS:
        out = judged(docs, id_col, text, lang, source).where("not kept").select("id", "mark").distinct()
        return without(docs, scratch.table(out, "rejected"), id_col, F.xxhash64(text, lang, source))
    q, of_lang, of_source, cut = free(docs.columns, "q", "of_lang", "of_source", "limits")
    found = F.broadcast(found.withColumnsRenamed({"lang": of_lang, "source": of_source, "limits": cut}))
    both = with_counts(docs, text, name=q).join(found, F.col(lang).eqNullSafe(F.col(of_lang)) & F.col(source).eqNullSafe(F.col(of_source)), "left")
    return both.where(~base_failed(F.col(q)) & _within(F.col(q), F.col(cut))).select(*docs.columns)
