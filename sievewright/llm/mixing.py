"""Mixing sources to target weights by packed blocks.

The words of a source, its documents in a pseudorandom but fixed order, are cut into blocks of ``BLOCK`` words. A
source's target decides how many slots it has: whole passes over its blocks and a part of one more, the last slot
trimmed to the word. Each output shard draws its counts of slots per source from a multinomial; slots are numbered
per source over the shards and mapped to blocks by a keyed permutation per source and pass (a Feistel network).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, WORD, Scratch, free, small
from .textkernel import mix64, words

BLOCK = 256
SHARD_SLOTS = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SOURCES = 1_000_000  # the table of sources is the one thing that the driver holds; more of them are refused
SPAN = 4096  # numbers that one task of a running sum goes through, and then so many sums
PER_BUCKET = 1024  # documents whose places in their source one task counts through


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST_REPEATS) -> np.ndarray:
    """Targets that share ``share`` of all sizes by weight, none above ``most`` times its size: the fixed point of
    resharing what is above, found by filling in the order in which sources reach their ceiling."""
    ceiling, total = most * sizes.astype(float), share * float(sizes.sum())
    out, open_ = np.zeros(len(sizes)), np.argsort(ceiling / weights, kind="stable")
    for k, i in enumerate(open_):
        level = total / weights[open_[k:]].sum()
        if level <= ceiling[i] / weights[i]:
            out[open_[k:]] = level * weights[open_[k:]]
            break
        out[i] = ceiling[i]
        total -= ceiling[i]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Image of ``index`` under the permutation of range(n) with this key (its inverse, if ``back``)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    size, key = n.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            # one half changes by the other, in turns
            if r % 2:
                a = a ^ (mix64(b + mix64(k + np.uint64(r))) & m)
            else:
                b = b ^ (mix64(a + mix64(k + np.uint64(r))) & m)
        x[todo] = (a << h) | b
        todo = x >= size  # walk on until inside
    return x.astype(np.int64)


def _keys(seed: int, sid: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return mix64(mix64(sid.astype(np.uint64) + np.uint64(seed)) + turn.astype(np.uint64))


def plan(sources: pd.DataFrame, block: int = BLOCK, seed: int = 0, share: float = SHARE, most: int = MOST_REPEATS, weights: tuple = WEIGHTS) -> pd.DataFrame:
    """Per source, in code point order with null last: target, blocks, slots and the words of the last slot."""
    s = sources.reset_index(drop=True)
    s["sid"] = np.arange(len(s), dtype=np.int64)
    size = s["size"].to_numpy(np.int64)
    s["target"] = targets(size, np.resize(np.array(weights, float), len(s)), share, most)
    take = np.minimum(np.floor(s["target"].to_numpy() + 0.5).astype(np.int64), most * size)
    s["blocks"] = -(-size // block)
    s["tail"] = size - (s["blocks"] - 1).clip(lower=0) * block
    full = np.where(size > 0, take // np.maximum(size, 1), 0)
    rest = take - full * size
    n, tail = s["blocks"].to_numpy(), s["tail"].to_numpy()
    short = permuted(np.maximum(n - 1, 0), np.maximum(n, 1), _keys(seed, s["sid"].to_numpy(), full), back=True)
    plain = -(-rest // block)
    early = (short < plain) & (tail < block)  # the short block comes among the slots of the last pass
    part = np.where(early, -(-(rest + block - tail) // block), plain)
    before = (part - 1) * block - np.where(early & (short < part - 1), block - tail, 0)
    s["full"], s["slots"] = full, full * n + part
    s["last_words"] = np.where(part > 0, rest - before, 0)
    return s


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, tie): words of each text and a hash that orders equal ids."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))


def summed_before(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the same ``by`` and a smaller ``order`` (a whole number, once for each
    ``by``). Sums of spans are added up first, then those within a span, so no task sorts a whole group."""
    span = rows.withColumn("span", F.floor(F.col(order) / SPAN))
    spans = span.groupBy(by, "span").agg(F.sum(value).alias("in_span"))
    spans = spans.withColumn("earlier", F.sum("in_span").over(W.partitionBy(by).orderBy("span")) - F.col("in_span"))
    here = W.partitionBy(by, "span").orderBy(order)
    local = span.withColumn(name, F.sum(value).over(here) - F.col(value))
    return local.join(spans.select(by, "span", "earlier"), [by, "span"]).withColumn(name, F.col(name) + F.col("earlier")).drop("span", "earlier")


class Mix:
    """The mix of ``docs``: its sources, slots and what it takes of each document.

    Null texts have no words; a null source is a source of its own, the last. Equal ids are separate documents,
    and rows equal in id and text take places next to each other. The same input gives the same mix. An empty
    table, or one without words, gives an empty mix. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 20, share: float = SHARE, most: int = MOST_REPEATS, weights: tuple = WEIGHTS):
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        scratch = self.scratch = Scratch(self.spark, "mix")
        self.rows = scratch.table(sized(docs, id_col, text, source), "sizes")
        n = self.rows.count()
        listed = self.rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(SOURCES + 1).collect()
        if len(listed) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        frame = pd.DataFrame({"source": pd.Series([r["source"] for r in listed], dtype=object), "size": np.array([r["size"] for r in listed], np.int64)})
        self.plan = plan(frame, block, seed, share, most, weights)
        columns = ["sid", "source", "size", "target", "blocks", "tail", "full", "slots", "last_words"]
        kinds = "sid long, source string, source_size long, target double, blocks long, tail long, full long, slots long, last_words long"
        self.sources = self.spark.createDataFrame([tuple(None if x is None else getattr(x, "item", lambda x=x: x)() for x in r) for r in self.plan[columns].itertuples(index=False, name=None)], kinds)
        if len(listed) <= BROADCAST_ROWS:
            self.sources = F.broadcast(self.sources)
        buckets = max(1, n // PER_BUCKET)
        placed = self.rows.join(self.sources.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
        placed = placed.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, tie, {seed}), {buckets})"))
        # equal rows are one row and a number of copies until they have their places
        placed = placed.groupBy("sid", "bucket", "doc_id", "tie", "size").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
        base = summed_before(placed.groupBy("sid", "bucket").agg(F.sum("words").alias("words")), "sid", "bucket", "words", "base")
        base = scratch.table(base.select("sid", "bucket", "base"), "base")
        here = W.partitionBy("sid", "bucket").orderBy("doc_id", "tie", "size")
        running = placed.withColumn("start", F.sum("words").over(here.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
        running = running.join(base, ["sid", "bucket"]).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
        self.places = scratch.table(running.select("sid", "doc_id", "tie", "size", (F.col("start") + F.col("base") + F.col("copy") * F.col("size")).alias("start")), "places")

    def slots(self) -> DataFrame:
        """(shard, sid, slot, block, upto): slot by slot, the block and how many of its words are taken."""
        p = self.plan[self.plan["slots"] > 0]
        total = int(p["slots"].sum())
        shards = -(-total // SHARD_SLOTS)
        sid, count = p["sid"].to_numpy(), p["slots"].to_numpy()
        chance, seed, block = count / max(1, total), self.seed, self.block

        def draw(batches):
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    of = np.random.default_rng([seed, shard]).multinomial(min(SHARD_SLOTS, total - shard * SHARD_SLOTS), chance)
                    hit = np.flatnonzero(of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), shard)), pa.array(sid[hit]), pa.array(of[hit])], ["shard", "sid", "n"])

        drawn = self.spark.range(shards).mapInArrow(draw, "shard long, sid long, n long") if total else self.spark.createDataFrame([], "shard long, sid long, n long")
        spans = summed_before(drawn, "sid", "shard", "n", "lo_").withColumn("hi", F.col("lo_") + F.col("n")).join(self.sources.select("sid", "slots"), "sid")
        spans = spans.select("shard", "sid", F.least(F.col("hi") - F.col("n"), "slots").alias("lo"), F.least("hi", "slots").alias("hi"), "slots")
        # what the draws left of a source goes to shards after the drawn ones
        left = self.sources.select("sid", "slots").join(spans.groupBy("sid").agg(F.max("hi").alias("lo")), "sid", "left").withColumn("lo", F.coalesce("lo", F.lit(0))).where("lo < slots")
        left = left.withColumn("k", F.explode(F.expr(f"sequence(0L, (slots - lo - 1) div {SHARD_SLOTS})")))
        left = left.select((F.lit(shards) + F.col("k")).alias("shard"), "sid", (F.col("lo") + F.col("k") * SHARD_SLOTS).alias("lo"), F.least("slots", F.col("lo") + (F.col("k") + 1) * SHARD_SLOTS).alias("hi"), "slots")
        each = spans.where("lo < hi").unionByName(left).select("shard", "sid", F.explode(F.expr("sequence(lo, hi - 1)")).alias("slot"))
        each = each.join(self.sources.select("sid", "blocks", "tail", "full", "slots", "last_words"), "sid").select("shard", "sid", "slot", "blocks", "tail", "full", "slots", "last_words")

        def place(batches):
            for batch in batches:
                shard, sid, slot, blocks, tail, full, slots, last = (batch.column(k).to_numpy() for k in range(8))
                turn = slot // blocks
                at = permuted(slot % blocks, blocks, _keys(seed, sid, turn))
                words_ = np.where(at == blocks - 1, tail, block)
                words_ = np.where((turn == full) & (slot == slots - 1), last, words_)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, sid, slot, turn, at, words_)], ["shard", "sid", "slot", "turn", "block", "upto"])

        return each.mapInArrow(place, "shard long, sid long, slot long, turn long, block long, upto long")

    def taken(self) -> DataFrame:
        """(sid, doc_id, tie, size, start, turn, parts: array of word ranges taken) of each pass that takes part of a document."""
        b = self.block
        cut = self.places.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        cut = cut.withColumn("from", F.greatest(F.col("start"), F.col("block") * b)).withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.col("from"))
        met = cut.join(self.slots().select("sid", "block", "turn", "upto"), ["sid", "block"])
        met = met.withColumn("got", F.least(F.col("words"), F.col("upto") - (F.col("from") - F.col("block") * b))).where("got > 0")
        return met.withColumn("at", F.col("from") - F.col("start"))

    def totals(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document."""
        sums = self.taken().groupBy("sid", "start").agg(F.sum("got").alias("taken"))
        # an empty document may start where another does: it takes nothing
        full = self.places.where("size > 0").join(sums, ["sid", "start"], "left")
        none = self.places.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*full.columns)
        both = full.unionByName(none).join(self.sources.select("sid", "source", "source_size", "target"), "sid")
        return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", **settings) -> DataFrame:
    """``docs`` as mixed: a row for each unbroken run of words that a pass takes of a document, in ``docs``' columns.

    A document that a pass takes whole keeps its text as it is; parts keep the text from their first to their last
    word. Documents that the mix does not take, and those without words, are left out. ``length``, if it is a
    column, is the number of code points of the row's text.
    """
    m = Mix(docs, id_col, text, source, **settings)
    i, tie, parts_ = free(docs.columns, "id", "tie", "parts")
    runs = m.taken().groupBy("sid", "start", "doc_id", "tie", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "got"))).alias("parts"))  # blocks of one document
    runs = runs.groupBy("doc_id", "tie", "start").agg(F.collect_list("parts").alias("parts"))  # passes: a few
    runs = m.scratch.table(runs.select(F.col("doc_id").alias(i), F.col("tie").alias(tie), F.col("parts").alias(parts_)), "runs")
    twice = m.scratch.table(runs.groupBy(i, tie).count().where("count > 1").select(i, tie), "twice")
    same = lambda t: docs[id_col].eqNullSafe(t[i]) & (F.xxhash64(docs[text]) == t[tie])
    once = docs
    if not twice.isEmpty():
        # of equal rows one meets the runs of all: each of them is a row of its own
        again = docs.join(small(twice), same(twice), "left_semi").dropDuplicates([id_col, text])
        once = docs.join(small(twice), same(twice), "left_anti").unionByName(again)
    joined = once.join(small(runs, 5000), once[id_col].eqNullSafe(runs[i]) & (F.xxhash64(once[text]) == runs[tie]))  # rows hold lists
    names = docs.columns
    at, n_at = names.index(text), names.index(length) if length in names else -1

    def run(batches):
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, 128):
                yield from cut(whole_batch.slice(a, 128))

    def cut(batch):
        rows, out, held = [], [], 0
        lists = batch.column(len(names)).to_pylist()
        for chunk in words(batch.column(at)):
            for i in range(len(chunk.first) - 1):
                a, b = chunk.first[i], chunk.first[i + 1]
                whole = bytes(chunk.raw[chunk.rows[i] : chunk.rows[i + 1]])
                for parts in lists[chunk.row + i]:
                    runs_ = []
                    for p in parts:
                        if runs_ and runs_[-1][1] == p["at"]:
                            runs_[-1][1] += p["got"]
                        else:
                            runs_.append([p["at"], p["at"] + p["got"]])
                    for x, y in runs_:
                        rows.append(chunk.row + i)
                        out.append(whole if y - x == b - a else bytes(chunk.raw[chunk.start[a + x] : chunk.end[a + y - 1]]))
                        held += len(out[-1])
                    if held > 1 << 20:
                        yield made(batch, rows, out)
                        rows, out, held = [], [], 0
        if rows:
            yield made(batch, rows, out)

    def made(batch, rows, out):
        which = pa.array(rows, pa.int64())
        text_ = pa.array([x.decode() for x in out], pa.string())
        columns = [text_ if k == at else batch.column(k).take(which) for k in range(len(names))]
        if n_at >= 0:
            columns[n_at] = pa.compute.utf8_length(text_).cast(batch.column(n_at).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*(once[c] for c in names), parts_).mapInArrow(run, docs.schema)
