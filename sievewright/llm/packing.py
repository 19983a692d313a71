"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

LENGTH = 1024
OPEN_BINS = 256  # so many binds (unbounded, some thousand would be open) and costs no sequences, as the closed ones are all but full
PER_TASK = 50_000  # pieces of one stream; bins left open at its end are the only loss of splitting
END = 2

#: Texts of these characters only take the fast coder: all library versions agree on their letter, digit and space classes.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‘’“”–—]*"


@lru_cache(maxsize=2)
def coder(path: str):
    """texts -> list of id lists, as by the tokenizer file at ``path`` without special tokens.

    Where the same vocabulary lies beside it as ranks, texts of common characters are coded by those (equal ids,
    a third of the time); all others, and all texts where it doesn't, by the tokenizer itself.
    """
    import os
    import re

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = []

    def whole() -> Tokenizer:  # only loaded where a text needs it
        if not loaded:
            loaded.append(Tokenizer.from_file(path))
            loaded[0].encode_special_tokens = True  # their strings in a text are ordinary text
        return loaded[0]

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    quick = None
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = re.compile(PLAIN)

    def encode(texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if quick is not None and plain.fullmatch(t):
                out[i] = quick.encode_ordinary(t)
            else:
                rest.append(i)
        for i in rest:
            out[i] = whole().encode(texts[i], add_special_tokens=False).ids
        return out

    return encode


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and ``end``, cut only if longer than ``length``.

    All pieces but the first have ``length`` ids; the first has what is left over.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches):
        encode = coder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                which, piece, start, size, crc = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    raw = np.array([*ids, end], "<u4")
                    ends = range(len(raw) % length or length, len(raw) + 1, length)
                    for k, to in enumerate(ends):
                        at = max(0, to - length)
                        cut = raw[at:to]
                        which.append(i)
                        piece.append(k)
                        start.append(at)
                        size.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = LENGTH, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given.

    At most ``open_bins`` bins are open. They are keyed by free space in a bitset, whose lowest bit at or above an
    item's size is the best fit; if there is none and all bins are in use, the fullest open bin is closed.
    """
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = used = bins = 0
    for i, size in enumerate(sizes.tolist()):
        fits = bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                bits ^= 1 << free
            used -= 1
        else:
            if used >= open_bins:
                full = (bits & -bits).bit_length() - 1
                stacks[full].pop()
                if not stacks[full]:
                    bits ^= 1 << full
                used -= 1
            b, free = bins, capacity
            bins += 1
        where[i], offset[i] = b, capacity - free
        free -= size
        if free:
            stacks[free].append(b)
            bits |= 1 << free
            used += 1
    return where, offset


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS, per_task: int = PER_TASK, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Pieces are written, counted and dealt by a hash into streams of about ``per_task``. A stream is packed online: its
    pieces come in order of id (null last) and piece, are placed once, and never see a later one. A null or empty text
    is the end token alone. Equal rows are packed as separate documents, whatever their number. An empty table gives
    an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(pieces(docs, path, id_col, text, length, end), "pieces")
    streams = max(1, round(cut.count() / per_task))
    # the number of a row in the written table parts rows that are equal in all else
    dealt = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("grp", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32, row), {streams}) as int)")).drop("row")
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = table.column_names.index
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        where, offset = best_fit(table.column(at("length")).to_numpy(), length, open_bins)
        table = table.drop_columns(["grp"])
        return table.append_column("sequence_id", pa.array((np.int64(key[0].as_py()) << np.int64(32)) + where)).append_column("offset", pa.array(offset))

    return dealt.groupBy("grp").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
