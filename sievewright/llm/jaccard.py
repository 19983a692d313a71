"""N-gram Jaccard join by grouped prefixes.

Every document is the set of its distinct word shingles (64-bit hashes). Two documents link when their Jaccard
similarity is at least ``num / den``; the result is the connected components of the links, exactly.

Plan (the corpus is read three times and never shuffled; what is shuffled are prefixes and candidates' sets):

1. Token order. A fixed-size count sketch of all shingles (4 Mi counters) gives every shingle a frequency class.
   Classes ascending, then hash, is a total order of shingles; collisions in the sketch change only the cost.
2. Prefixes. Documents with equal sets are one class (its id is a 64-bit hash of the set). Classes with the same
   prefix and size are one group; groups, not documents, are indexed by their prefix shingles, and a task emits the
   prefix of a group once. One exchange by shingle drops those that a single group holds.
3. Group pairs pass the size filter, the positional filter and the short prefix of the smaller side.
   First pass ("star"): in each shingle's bucket, each size slab has one pivot (the group that meets the shingle
   earliest) and every group is paired with the pivots of the slabs in its reach; members of a group are paired with
   its first member. Verified links are contracted.
   Second pass ("rest"): all group pairs that pass the filters, except inside one component, expanded to members.
   Sizes and positions bound the join itself, not only what it gives; of a bucket's largest component no two rows
   meet; a heavy bucket is dealt out. Members of one group that are still apart share their prefix, so they must
   share one of the next shingles too, and are joined on those.
   Only pairs that cannot change a component are left out, so none that matters is lost, and a group of copies
   of any size costs a linear number of pairs.
4. Group pairs are screened by their whole prefixes: what these share, and where the last shared shingle stands, bounds
   the intersection. What is left is verified on full sets. Sets that many pairs ask for go out to the pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, small, without
from .components import connected_components
from .textkernel import mix64, shingle_sets, words

CELLS = 1 << 22  # counters of the sketch; their classes are broadcast as 4 MiB, whatever the input
BLOCK = 1 << 12
STEPS = 4  # size buckets of the second pass to the ratio that two linked sizes may have
BUSY, HEAVY = 1 << 12, 1 << 18  # pairs of a bucket from which its largest component is told apart, and from which it is dealt out
HOT_PAIRS, HOT_BYTES = 64, 32 << 20  # a set in more pairs is sent to them: by broadcast, if all such sets have so many bytes at most
SEEN = 200_000  # groups (or classes) that a task remembers, not to emit them again; more only cost repeated rows
FILTER_BITS = 1 << 26  # bits of the candidate filter at most (8 MiB); false hits only cost time


def _sets(column, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for chunk in words(column):
        yield from shingle_sets(chunk, size)


def frequency_classes(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """uint8 class of each sketch cell: 0 for cells near the mean load, then half-octaves of the count."""

    def count(batches):
        total = np.zeros(CELLS, np.uint32)
        held: list[np.ndarray] = []

        def add():
            if held:
                total[:] += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                held.clear()

        for batch in batches:
            for chunk in words(batch.column(0)):
                held += [s for _, s in shingle_sets(chunk, size)]
                if sum(map(len, held)) > CELLS // 4:
                    add()
        add()
        if total.any():
            for k in range(CELLS // BLOCK):
                part = total[k * BLOCK : (k + 1) * BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            raw = zlib.compress(np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([raw], pa.binary())})

    schema = "block int, counts binary"
    # at most CELLS * 4 bytes reach the driver
    parts = docs.select(text).mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema).collect()
    counts = lambda row: np.frombuffer(zlib.decompress(row.counts), np.uint32).astype(np.int64)
    mean = sum(int(counts(row).sum()) for row in parts) / CELLS
    classes = np.zeros(CELLS, np.uint8)
    for row in parts:
        # cells within the spread of their load count as rare: their shingles come first, in hash order
        over = counts(row) - mean
        classes[row.block * BLOCK : (row.block + 1) * BLOCK] = np.where(over < 8 + 3 * mean**0.5, 0, np.floor(2 * np.log2(np.maximum(over, 1))))
    return classes


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _sign(found: np.ndarray) -> int:
    """The id of a set: 64 bits, signed."""
    return int(mix64(mix64(found).sum(keepdims=True) + np.uint64(len(found)))[0].astype(np.int64))


def _ordered(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles in the order of their frequency classes, then their hashes."""
    return found[np.argsort(rank[(found & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")]


def signatures(docs: DataFrame, id_col: str, text: str, size: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """(doc_id, mark, n, class, grp, prefix) of every row; mark is a hash of the text; class, grp and prefix are null where a
    row has no words, and prefix also where the task has emitted that of the group before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    kind = docs.schema[id_col].dataType

    def run(batches):
        rank, seen = shared.value, set()
        for batch in batches:
            n, sign, group, flat, ends = [], [], [], [], [0]
            for _, found in _sets(batch.column(1), size):
                m = len(found)
                n.append(m)
                sign.append(_sign(found) if m else None)
                group.append(None)
                if m:
                    prefix = _ordered(found, rank)[: _prefix(m, num, den)]
                    group[-1] = int(mix64(mix64(prefix + np.arange(1, len(prefix) + 1, dtype=np.uint64)).sum(keepdims=True) + np.uint64(m))[0].astype(np.int64))
                    if group[-1] not in seen:
                        flat.append(prefix)
                        if len(seen) < SEEN:
                            seen.add(group[-1])
                    else:
                        prefix = prefix[:0]
                    ends.append(ends[-1] + len(prefix))
                else:
                    ends.append(ends[-1])
            tokens = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sign, pa.int64()), pa.array(group, pa.int64()), lists], ["doc_id", "mark", "n", "class", "grp", "prefix"])

    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return marked.mapInArrow(run, f"doc_id {kind.simpleString()}, mark long, n long, class long, grp long, prefix array<long>")


class _Bits:
    """A bounded bit filter of ``wanted``'s keys, hashes of ``columns``, for tasks to look up; false hits only cost time."""

    def __init__(self, wanted: DataFrame, columns: list[str], most: int):
        cells = min(FILTER_BITS, 1 << max(20, (32 * most).bit_length()))
        self.h = F.expr(f"xxhash64({', '.join(columns)}) & {cells - 1}")
        parts = wanted.groupBy(F.bitmap_bucket_number(self.h).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(self.h)).alias("bits")).collect()
        bits = {row.k: bytes(row.bits) for row in parts}  # so many cells, FILTER_BITS at most
        table = np.zeros((max(bits, default=0) + 2, 4096), np.uint8)
        for k, raw in bits.items():
            table[k] = np.frombuffer(raw, np.uint8)
        self.shared = wanted.sparkSession.sparkContext.broadcast(table)

    def places(self) -> list[Column]:
        return [F.bitmap_bucket_number(self.h).alias("_bucket"), F.bitmap_bit_position(self.h).alias("_bit")]


def _hits(bitmap: np.ndarray, bucket: pa.Array, bit: pa.Array) -> np.ndarray:
    # Spark numbers bits from 1: bucket 1 + (value - 1) // 32768, position (value - 1) % 32768; value 0 is bucket 0
    bucket, bit = bucket.to_numpy(), bit.to_numpy()
    known = (bucket >= 0) & (bucket < len(bitmap))
    hit = np.zeros(len(bucket), bool)
    hit[known] = (bitmap[bucket[known], bit[known] >> 3] >> (bit[known] & 7)) & 1
    return hit


def _candidate_sets(docs: DataFrame, id_col: str, text: str, size: int, wanted: DataFrame, most: int, pick=None) -> DataFrame:
    """(class, shingles) of the classes of the rows in ``wanted(doc_id, mark)``, about ``most`` of them; a bit filter keeps
    other texts from being cut. ``pick`` chooses of a set's shingles."""
    bits = _Bits(wanted, ["doc_id", "mark"], most)
    shared = bits.shared

    def run(batches):
        bitmap, seen = shared.value, set()
        for batch in batches:
            hit = _hits(bitmap, batch.column(0), batch.column(1))
            if not hit.any():
                continue
            sign, flat, ends = [], [], [0]
            for _, found in _sets(batch.column(2).filter(pa.array(hit)), size):
                name = _sign(found) if len(found) else None
                if name is not None and name not in seen:
                    if len(seen) < SEEN:
                        seen.add(name)
                    sign.append(name)
                    flat.append(found if pick is None else pick(found))
                    ends.append(ends[-1] + len(flat[-1]))
                if ends[-1] > 1 << 20:
                    yield out(sign, flat, ends)
                    sign, flat, ends = [], [], [0]
            if sign:
                yield out(sign, flat, ends)

    def out(sign, flat, ends):
        return pa.RecordBatch.from_arrays([pa.array(sign, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))], ["class", "shingles"])

    cut = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).select(*bits.places(), "text")
    # the id of a class is a hash of its set, so any row of it will do
    return cut.mapInArrow(run, "class long, shingles array<long>").groupBy("class").agg(F.any_value("shingles").alias("shingles"))


def both_ends(pairs: DataFrame, sets: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs(a, b)``, a written table, with the columns of ``sets(key, …)`` of both ends, a_… and b_….

    ``ends(key, count)`` counts the pairs of each key and ``sets`` has its size, n. The set of a key in many pairs is
    not met by a shuffle on that key.
    """
    side = lambda k: sets.select(F.col("key").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in sets.columns if c != "key"))
    left, right = side("a"), side("b")
    hot = scratch.table(ends.where(F.col("count") > HOT_PAIRS), "hot")
    if hot.isEmpty():
        return pairs.join(left, "a").join(right, "b")
    # the end that more pairs ask for second
    times = lambda k: small(hot.select(F.col("key").alias(k), F.col("count").alias(f"n{k}")))
    known = pairs.join(times("a"), "a", "left").join(times("b"), "b", "left").na.fill(0, ["na", "nb"])
    turned = known.select(F.expr("if(na > nb, b, a)").alias("a"), F.expr("if(na > nb, a, b)").alias("b"), F.greatest("na", "nb").alias("times"))
    turned = scratch.table(turned, "turned")
    few = turned.where("times = 0").join(left, "a").join(right, "b")
    many = turned.where("times > 0").join(left, "a")
    of_hot = scratch.table(right.join(small(hot.select(F.col("key").alias("b"), F.ceil(F.col("count") / HOT_PAIRS).alias("salts"))), "b"), "hot-sets")
    if 8 * of_hot.agg(F.sum("b_n")).first()[0] <= HOT_BYTES:
        return few.unionByName(many.join(F.broadcast(of_hot.drop("salts")), "b"))
    salted = of_hot.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
    many = many.withColumn("salt", F.expr(f"pmod(xxhash64(a), cast(ceil(times / {HOT_PAIRS}D) as bigint))"))
    return few.unionByName(many.join(salted, ["b", "salt"]).drop("salt"))


def _ends(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").count(), "ends")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, num: int, den: int, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``pairs(a, b)`` of classes, a written table, those that link."""
    ends = _ends(pairs, scratch)
    wanted = firsts.join(small(ends), F.col("class") == F.col("key"), "left_semi").select("doc_id", "mark")
    sets = _candidate_sets(docs, id_col, text, size, wanted, ends.count()).select(F.col("class").alias("key"), "shingles", F.size("shingles").alias("n"))
    both = both_ends(pairs, sets, ends, scratch)
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.where(den * common >= num * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def screened(pairs: DataFrame, signed: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Of ``pairs(a, b)`` of groups, a written table, those whose prefixes allow a link.

    Let the prefixes share c shingles, the last of them i-th of one and j-th of the other. Up to the end of one of the
    prefixes, whichever ends first in the order, nothing else is shared; beyond it at most all of the shorter rest.
    """
    ends = _ends(pairs, scratch)
    bits = _Bits(ends, ["key"], ends.count())
    shared = bits.shared

    def run(batches):
        for batch in batches:
            hit = pa.array(_hits(shared.value, batch.column(0), batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(hit) for k in (2, 3, 4)], ["key", "size", "prefix"])

    rows = signed.where("size(prefix) > 0").select(F.col("grp").alias("key"), F.col("n").alias("size"), "prefix")
    sets = rows.select(*bits.places(), "key", "size", "prefix").mapInArrow(run, "key long, size long, prefix array<long>")
    sets = sets.groupBy("key").agg(F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix")).withColumn("n", F.size("prefix"))
    both = both_ends(pairs, sets, ends, scratch).withColumn("common", F.array_intersect("a_prefix", "b_prefix")).where("size(common) > 0")
    both = both.withColumn("i", F.expr("array_position(a_prefix, element_at(common, -1))")).withColumn("j", F.expr("array_position(b_prefix, element_at(common, -1))"))
    beyond = "greatest(least(a_size - a_n, b_size - j), least(a_size - i, b_size - b_n))"
    return both.where(f"{num + den} * (size(common) + {beyond}) >= {num} * (a_size + b_size)").select("a", "b")


def reach(num: int, den: int) -> str:
    """SQL of the largest size that a partner may have which shares the shingle at ``pos`` of a set of ``n``."""
    return f"cast((({num + den}L * (n - pos)) div {num}) - n as bigint)"


def paired(x: DataFrame, y: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """The rows of ``x(keys, one, …)`` and ``y(keys, one, …)``, as structs x and y, that meet on the keys.

    one names the component of a row, null if it has several. In a key of many pairs no two rows of its most frequent
    component meet, and the rows of x are dealt out over copies of those of y.
    """
    by_one = y.groupBy(*keys, "one").agg(F.count("*").alias("c"))
    counts = by_one.groupBy(*keys).agg(F.sum("c").alias("ny"), F.max_by("one", F.when(F.col("one").isNotNull(), F.col("c"))).alias("main"))
    heavy = x.groupBy(*keys).agg(F.count("*").alias("nx")).join(counts, keys).where(f"nx * ny > {BUSY}")
    heavy = scratch.table(heavy.select(*keys, "main", F.expr(f"greatest(1L, least(nx, nx * ny div {HEAVY}))").alias("salts")), "heavy")
    heavy = small(heavy)
    is_main = F.coalesce(F.col("one") == F.col("main"), F.lit(False))
    own = lambda d: [c for c in d.columns if c not in keys]
    xs, ys = (F.struct(*own(d)) for d in (x, y))
    left = x.join(heavy, keys, "left").select(*keys, F.when(is_main, 0).otherwise(1).alias("side"), F.pmod(F.xxhash64(*own(x)), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"), xs.alias("x"))
    sides = F.when(is_main | F.col("salts").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    right = y.join(heavy, keys, "left").withColumn("side", F.explode(sides)).withColumn("salt", F.explode(F.expr("sequence(0L, coalesce(salts, 1L) - 1)")))
    right = right.select(*keys, "side", "salt", ys.alias("y"))
    return left.join(right, [*keys, "side", "salt"])


def _passes(a: str, b: str, num: int, den: int) -> str:
    """Size and position filters of a smaller row ``a`` and a larger row ``b`` that share a prefix shingle."""
    return f"{a}.short and ({a}.n < {b}.n or {a}.n = {b}.n and {a}.grp < {b}.grp) and {den} * {a}.n >= {num} * {b}.n and {num + den} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {num} * ({a}.n + {b}.n)"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, component_class, mark) for every row of ``docs``.

    component_id is the smallest id reachable over links with similarity >= num / den, the row's own included.
    Nulls, empty and white-space texts have no shingles and link with nothing. Rows with a repeated id are
    separate documents; a null id never is a component id unless it stands alone. Other columns are ignored.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rank = frequency_classes(docs, text, size)
    signed = scratch.table(signatures(docs, id_col, text, size, num, den, rank), "signed")
    members = signed.where("class is not null")
    firsts = members.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("f"), F.count("*").alias("copies"), F.min("grp").alias("grp"), F.min("n").alias("n"))
    firsts = scratch.table(firsts.select("class", "f.doc_id", "f.mark", "copies", "grp", "n"), "classes")
    heads = scratch.table(firsts.groupBy("grp").agg(F.min("class").alias("head"), F.count("*").alias("size")), "groups")
    # shingles that two groups hold, one of them in its short prefix
    short = f"pos < n - ceil({2 * num} * n / {num + den}D) + 1"
    rows = members.select("grp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).repartition("token")
    shared = rows.groupBy("token").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.max(F.expr(short)).alias("s")).where("s and g1 <> g2").select("token")
    index = scratch.table(rows.join(shared, "token", "left_semi").distinct().withColumn("short", F.expr(short)), "index")

    # star: every row with the pivots of the slabs in its reach; members with the head of their group
    slab = lambda n, steps=1: f"cast(floor(ln({n}) * {steps} / {math.log(den / num) * (1 + 1e-9)}D) as int)" if num < den else f"cast({n} as int)"
    least, most = f"cast(ceil({num} * n / {den}D) as bigint)", f"least(greatest(n, {reach(num, den)}), {den}L * n div {num})"
    pivots = scratch.table(index.withColumn("slab", F.expr(slab("n"))).groupBy("token", "slab").agg(F.min(F.struct("pos", "n", "grp", "short")).alias("p")).select("token", "slab", "p.grp", "p.n", "p.pos", "p.short"), "pivots")
    near = index.withColumn("slab", F.explode(F.expr(f"sequence({slab(least)}, {slab(most)})")))
    met = near.alias("x").join(pivots.alias("y"), ["token", "slab"])
    met = met.where(F.expr(f"x.grp <> y.grp and (({_passes('x', 'y', num, den)}) or ({_passes('y', 'x', num, den)}))"))
    likely = lambda met: screened(scratch.table(met.select(F.expr("least(x.grp, y.grp) a"), F.expr("greatest(x.grp, y.grp) b")).distinct(), "met"), signed, num, den, scratch).toDF("g1", "g2")
    stars = scratch.table(likely(met), "stars")
    one = lambda g, c: heads.select(F.col("grp").alias(g), F.col("head").alias(c))
    across = stars.join(one("g1", "a"), "g1").join(one("g2", "b"), "g2").select("a", "b")
    crowd = heads.where("size > 1")
    inside = firsts.join(crowd, "grp").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    pairs = scratch.table(across.union(inside), "pairs")
    check = lambda pairs: scratch.table(verified(pairs, docs, id_col, text, size, num, den, firsts, scratch).distinct(), "links")
    links = check(pairs)
    comps = connected_components(links, scratch)

    # rest: pairs that pass the filters and are not yet known to be connected
    known = scratch.table(firsts.join(comps.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", "mark", "grp", "n", F.coalesce("comp", "class").alias("comp")), "known")
    span = known.groupBy("grp").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    spanned = index.join(scratch.table(span, "span"), "grp")
    open_tokens = scratch.table(spanned.groupBy("token").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2").select("token"), "open")
    left_over = scratch.table(spanned.join(open_tokens, "token", "left_semi").withColumn("one", F.expr("if(c1 = c2, c1, null)")), "left")
    size_of = lambda n: slab(n, STEPS)
    x = left_over.where("short").withColumn("bx", F.expr(size_of("n"))).withColumn("by", F.explode(F.expr(f"sequence(bx, {size_of(most)})")))
    y = left_over.withColumn("by", F.expr(size_of("n"))).where(f"{least} <= least(n, {reach(num, den)})").withColumn("bx", F.explode(F.expr(f"sequence({size_of(least)}, {size_of(f'least(n, {reach(num, den)})')})")))
    met = paired(x, y, ["token", "bx", "by"], scratch).where(F.expr(f"{_passes('x', 'y', num, den)} and not coalesce(x.one = y.one, false)"))
    rest = scratch.table(likely(met), "apart-pairs")
    side = lambda g, c, k: known.select(F.col("grp").alias(g), F.col("class").alias(c), F.col("comp").alias(k))
    across = rest.join(side("g1", "a", "ka"), "g1").join(side("g2", "b", "kb"), "g2").where("ka <> kb").select("a", "b")
    apart = scratch.table(known.join(span.where("c1 <> c2").select("grp"), "grp", "left_semi"), "apart")
    if not apart.isEmpty():
        across = across.union(side_by_side(apart, docs, id_col, text, size, num, den, rank, scratch))
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = scratch.table(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "rest")
    if not more.isEmpty():
        extra = check(more)
        if not extra.isEmpty():
            comps = connected_components(links.union(extra), scratch)

    # classes with company, and the smallest id of each component
    joined = firsts.join(comps.withColumnRenamed("node", "class"), "class", "left").where("comp is not null or copies > 1").select("class", "doc_id", F.coalesce("comp", "class").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    final = scratch.table(joined.join(least, "comp").select("class", "comp", "component_id"), "final")
    out = signed.drop("prefix", "grp").join(small(final), "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("class").alias("class_id"), F.coalesce("comp", "class").alias("component_class"), "mark")


def side_by_side(apart: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, num: int, den: int, rank: np.ndarray, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``apart(class, doc_id, mark, grp, comp)``, members of one group in different components, that may link.

    Both have the same size and the same prefix, so what they must share beyond it meets in the shingles that come next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def following(found: np.ndarray) -> np.ndarray:
        m = len(found)
        p, need = _prefix(m, num, den), -(-2 * num * m // (num + den))
        return _ordered(found, shared.value)[p : p + m - need + 1]

    next_ = _candidate_sets(docs, id_col, text, size, apart.select("doc_id", "mark"), apart.count(), following)
    rows = apart.join(next_, "class").select("grp", F.col("comp").alias("one"), "class", F.posexplode("shingles").alias("pos", "token"))
    rows = scratch.table(rows, "following")
    met = paired(rows, rows, ["grp", "token"], scratch).where("x.one <> y.one and x.class < y.class")
    return met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (of equal ids, the smallest text hash).

    Rows without words stay. A null id comes after all others. Of rows equal in id and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "near")
    found = jaccard_components(docs, id_col, text, size, num, den).where("component_class is not null").select("component_class", "doc_id", "mark")
    found = scratch.table(found, "components")
    crowded = found.groupBy("component_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    crowded = scratch.table(crowded.select("component_class", F.col("first.doc_id").alias("stays"), F.col("first.mark").alias("stays_mark")), "crowded")
    rows = found.join(small(crowded), "component_class").withColumn("is_first", F.expr("doc_id <=> stays and mark = stays_mark"))
    named = rows.select(F.col("doc_id").alias("id"), "mark", "is_first")
    away = scratch.table(named.where("not is_first").select("id", "mark").distinct(), "away")
    twice = scratch.table(named.where("is_first").groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "twice")
    kept = without(docs, away, id_col, F.xxhash64(text))
    if twice.isEmpty():
        return kept
    i, mark = free(docs.columns, "id", "mark")
    again = twice.select(F.col("id").alias(i), F.col("mark").alias(mark))
    again = kept.join(small(again), kept[id_col].eqNullSafe(again[i]) & (F.xxhash64(kept[text]) == again[mark]), "left_semi").dropDuplicates([id_col, text])
    return without(kept, twice, id_col, F.xxhash64(text)).unionByName(again)
