import zlib
from itertools import groupby

import numpy as np
import pytest

from quirebase.llm import packing
from quirebase.llm.queries import tokenizer


@pytest.mark.parametrize("which", ["odd", "real"])
def test_pieces_are_the_tokens(which, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    want = Tokenizer.from_file(tokenizer())
    texts = sorted([*want.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    rows = [r.asDict() for r in packing.packed(docs, tokenizer(), 256).collect()]
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    stream, got = [], []
    for r in rows:
        ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['length']}").tolist()
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= 256
        if r["start"] == 0:
            got.append([])
        assert len(got[-1]) == r["start"]
        got[-1] += ids
        stream += ids
    assert sorted(got) == texts
    for seq, part in groupby(rows, key=lambda r: r["sequence_id"]):
        at = 0
        for r in part:
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or seq == rows[-1]["sequence_id"]
    assert [r["sequence_id"] for r in rows] == sorted(r["sequence_id"] for r in rows)


def test_crc(odd):
    pieces = packing.packed(odd, tokenizer(), 64)
    a = {(r.sequence_id, r.offset): zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in pieces.collect()}
    assert a == {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.id_crc(pieces).collect()}


def test_empty(none):
    assert packing.id_crc(packing.packed(none, tokenizer())).count() == 0
