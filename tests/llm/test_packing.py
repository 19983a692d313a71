import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from util import awkward_rows, documents

from sievewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_codes_equal_the_tokenizer_on_odd_texts():
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x250)] + list(" \n\t ’“…—😀我אбͷ٣ᄀ￿́") + ["<|endoftext|>", "'s", "  ", "\n\n "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [r[1] or "" for r in awkward_rows(9, 60)]
    encode = packing.coder(PATH)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    assert encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_whole_and_sequences_gapless(spark):
    rows = awkward_rows(10, 90)
    rows += rows[:5] + [(None, "no id", "en", "s", 1)]
    out = packing.pack(documents(spark, rows).select("*", F.lit(1).alias("length"), F.lit(2).alias("grp")), PATH, per_task=60).collect()
    want = []
    for r in rows:
        ids = [*plain_ids(r[1]), 2]
        first = len(ids) % 1024 or 1024
        cuts = [ids[:first]] + [ids[a : a + 1024] for a in range(first, len(ids), 1024)]
        at = 0
        for k, c in enumerate(cuts):
            want.append((r[0], k, at, len(c), zlib.crc32(np.array(c, "<u4").tobytes())))
            at += len(c)
    order = lambda x: (x[0] is None, *[v or 0 for v in x])
    assert sorted([tuple(r)[:5] for r in out], key=order) == sorted(want, key=order)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= 1.2 * sum(r.length for r in out) / 1024 + 4


def test_best_fit_by_hand_and_bounded_space():
    where, offset = packing.best_fit(np.array([6, 5, 4, 5, 10, 1]), 10, 4)
    assert where.tolist() == [0, 1, 0, 1, 2, 3] and offset.tolist() == [0, 0, 6, 5, 0, 0]
    # one open bin: the fuller one is closed when a second is needed
    assert packing.best_fit(np.array([6, 5, 4]), 10, 1)[0].tolist() == [0, 1, 1]


def plain_best_fit(sizes, capacity, open_bins):
    """Every open bin looked at in turn: the fullest that fits; of equally full ones the one filled last."""
    opened, where, made, closed, tick = {}, [], 0, 0, 0
    for size in sizes:
        fits = [(free, -at, b) for b, (free, at) in opened.items() if free >= size]
        if fits:
            b = min(fits)[2]
            free = opened.pop(b)[0]
        else:
            if len(opened) >= open_bins:
                closed += 1
                del opened[min((free, -at, b) for b, (free, at) in opened.items())[2]]
            b, free, made = made, capacity, made + 1
        where.append((b, capacity - free))
        tick += 1
        if free > size:
            opened[b] = (free - size, tick)
    return where, closed


def test_best_fit_equals_a_plain_one_where_bins_close():
    rng = random.Random(8)
    for open_bins in (1, 3, 16, 64):
        sizes = [rng.choice([rng.randint(1, 100), rng.randint(1, 1024), 1024]) for _ in range(1500)]
        want, closed = plain_best_fit(sizes, 1024, open_bins)
        where, offset = packing.best_fit(np.array(sizes), 1024, open_bins)
        assert list(zip(where.tolist(), offset.tolist(), strict=True)) == want
        assert closed > 10


def test_production_bound_closes_bins_and_whole_query_equals_the_plain_packer(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("one two three four five six".split()[rng.randrange(6)] for _ in range(rng.choice([rng.randint(0, 700), rng.randint(500, 1020), 1500]))), "en", "s", 1) for i in range(1200)] + [(None, "no id", "en", "s", 1), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1)]
    out = packing.pack(documents(spark, rows), PATH).collect()
    out.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32))
    want, closed = plain_best_fit([r.length for r in out], 1024, packing.OPEN_BINS)
    assert closed > 0
    assert [(r.sequence_id, r.offset) for r in out] == want
    bound = -(-sum(r.length for r in out) // 1024)
    assert len({r.sequence_id for r in out}) <= 1.1 * bound


def test_a_row_repeated_many_times_is_many_streams(spark):
    docs = spark.range(3000).selectExpr("5L as doc_id", "'one two three' as text")
    out = packing.pack(docs, PATH, per_task=500).collect()
    assert len(out) == 3000 and len({r.sequence_id >> 32 for r in out}) == 6
    places = {(r.sequence_id, r.offset) for r in out}
    assert len(places) == 3000


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0
