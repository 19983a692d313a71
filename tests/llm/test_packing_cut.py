"""Of a document over 1024 tokens only the first piece may be shorter."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from test_packing import plain_ids
from util import documents

from sievewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("length", [1024, 10])
def test_only_the_first_piece_is_shorter(spark, length):
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(words[i % 10] for i in range(n)) for n in (0, 3, 9, 10, 19, 23, 1023, 1024, 1500, 2047, 2100)]
    got = packing.pieces(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), PATH, length=length).collect()
    want = set()
    for i, t in enumerate(texts):
        ids, cuts = [*plain_ids(t), 2], []
        while ids[length:]:
            cuts.insert(0, ids[-length:])
            ids = ids[:-length]
        cuts.insert(0, ids)
        at = 0
        for k, c in enumerate(cuts):
            want.add((i, k, at, len(c), zlib.crc32(np.array(c, "<u4").tobytes())))
            at += len(c)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
