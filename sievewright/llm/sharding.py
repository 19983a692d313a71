"""Sharding by extendible hashing, in DataFrame functions alone.

A shard is a prefix of the hash bits; the directory is the set of prefixes. Only a bucket that is too large is
split on another bit. The tree of bucket sizes is made from sums per cell (a prefix a few bits deeper than needed
on average), so it never grows with the number of rows, and rows meet it by one join on their cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

BITS = 60
LIMIT = 1 << 20
LEVELS = 4  # levels of the tree that one step sums up
SLACK, DEEPER = 3, 6  # bits beyond the average depth in the first round, and bits more in each further one


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _sizes(cells: DataFrame, first: int, last: int, scratch: Scratch) -> DataFrame:
    """(root, depth, prefix, bytes, rows) of the buckets of depths ``first`` to ``last``, from ``cells(root, prefix, bytes, rows)``
    of the last. Each step sums up a few levels and hands only its uppermost on, so all steps make a small multiple of the cells."""
    out, at = None, last
    while True:
        up = max(first, at - LEVELS + 1)
        each = cells.withColumn("depth", F.explode(F.sequence(F.lit(up), F.lit(at)))).withColumn("prefix", F.expr(f"shiftright(prefix, {at} - depth)"))
        step = scratch.table(each.groupBy("root", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "sizes")
        out = step if out is None else out.unionByName(step)
        if up == first:
            return out
        cells, at = step.where(F.col("depth") == up).select("root", F.shiftright("prefix", 1).alias("prefix"), "bytes", "rows"), up - 1


def _leaves(rows: DataFrame, limit: int, first: int, last: int, scratch: Scratch) -> DataFrame:
    """(root, cell, depth, prefix, shard_bytes, shard_rows) of the cells of ``last`` bits that lie in a bucket which fits,
    of depth ``first`` to ``last``. ``rows(root, h, n_bytes)``.

    A bucket of the directory is one that fits while the one that it was split from does not."""
    cells = scratch.table(rows.groupBy("root", F.shiftright("h", BITS - last).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), "cells")
    sizes = _sizes(cells, first, last, scratch)
    over = scratch.table(sizes.where(F.col("bytes") > limit).select("root", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")), "split")
    fit = sizes.where(F.col("bytes") <= limit).withColumn("parent", F.shiftright("prefix", 1))
    leaves = fit.where(F.col("depth") == first).unionByName(fit.where(F.col("depth") > first).join(small(over), ["root", "depth", "parent"], "left_semi"))
    spread = F.expr(f"sequence(shiftleft(prefix, {last} - depth), shiftleft(prefix + 1, {last} - depth) - 1)")
    return scratch.table(leaves.select("root", F.explode(spread).alias("cell"), "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")), "leaves")


def _split(rows: DataFrame, limit: int, start: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Rows with their shard, and the rows whose bucket of all BITS bits still is too large. ``rows(root, h, n_bytes, ...)``."""
    out, first, last = [], 0, min(BITS, start)
    while True:
        leaves = _leaves(rows, limit, first, last, scratch)
        cut = rows.withColumn("cell", F.shiftright("h", BITS - last)).join(small(leaves), ["root", "cell"], "left")
        name = F.concat("root", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')")))
        out.append(cut.where("depth is not null").select(*rows.columns, name.alias("shard"), (F.length("root") + F.col("depth")).cast("int").alias("depth"), "shard_bytes", "shard_rows"))
        over = scratch.table(cut.where("depth is null").select(*rows.columns), "over")
        if last == BITS or over.isEmpty():
            return out, over
        rows, first, last = over, last + 1, min(BITS, last + DEEPER)


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, mark, n_bytes, depth, shard, shard_bytes, shard_rows) of every row.

    n_bytes is the size of the text (null: 0), shard the bits of its prefix. Equal keys hash alike; where such a
    bucket is too large it is split further by a hash of the text (mark), and rows equal in both are dealt to
    pages "<bits>/<n>" by their number. One row larger than the limit is a shard of its own. A null key hashes as
    the empty string; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.lit("").alias("root"), hash60(F.col(key)).alias("h"))
    rows = scratch.table(rows, "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, over = _split(rows, limit, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK, scratch)
    columns = ["key", "mark", "n_bytes", "depth", "shard", "shard_bytes", "shard_rows"]
    out = [d.select(columns) for d in done]
    if not over.isEmpty():
        again = over.select("key", "mark", "n_bytes", F.lpad(F.bin("h"), BITS, "0").alias("root"), hash60(F.col("mark")).alias("h"))
        more, same = _split(scratch.table(again, "equal-keys"), limit, DEEPER, scratch)
        out += [d.select(columns) for d in more]
        if not same.isEmpty():
            # rows equal in key and text: counted, then dealt out by number, a page's worth at a time
            counted = same.groupBy("key", "mark", "n_bytes", "root", "h").agg(F.count("*").alias("copies"))
            pages = counted.withColumn("each", F.greatest(F.lit(1).cast("long"), F.expr(f"{limit} div n_bytes")))
            pages = pages.withColumn("page", F.explode(F.expr("sequence(0L, (copies - 1) div each)"))).repartition("root", "h", "page")
            pages = pages.withColumn("shard_rows", F.least("each", F.col("copies") - F.col("page") * F.col("each")))
            pages = pages.withColumn("copy", F.explode(F.expr("sequence(1L, shard_rows)")))
            name = F.concat("root", F.lpad(F.bin("h"), BITS, "0"), F.lit("/"), "page")
            out.append(pages.select("key", "mark", "n_bytes", F.lit(2 * BITS).cast("int").alias("depth"), name.alias("shard"), (F.col("n_bytes") * F.col("shard_rows")).alias("shard_bytes"), "shard_rows"))
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d)
    return result.withColumnRenamed("key", key) if key != "key" else result


def directory(shards: DataFrame) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows): each bucket of the directory once."""
    return shards.select("shard", "depth", "shard_bytes", "shard_rows").distinct()
