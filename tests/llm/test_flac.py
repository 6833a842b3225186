import hashlib
import random
import zlib

import numpy as np
import pytest

from quirebase.llm import flac


@pytest.mark.parametrize("which", ["odd", "real"])
def test_round_trip(which, request):
    docs = request.getfixturevalue(which)
    rows = flac.digests(flac.stored(docs)).collect()
    want = []
    for r in docs.collect():
        p = flac.payload(r.text)
        assert len(p) and len(p) % 576 == 0
        want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)


def payloads():
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(flac.BLOCK * 3))
    steep = bytes((i * i // 7) % 256 for i in range(flac.BLOCK))
    spikes = bytes(0 if i % 50 else 255 for i in range(flac.BLOCK * 2))
    return [b"\0" * flac.BLOCK, noise, steep, spikes, flac.payload("word " * 3000), flac.payload(""), bytes(range(256)) * 9 * 130]


def test_both_decoders_read_every_kind_of_frame():
    for p, m in zip(payloads(), flac.encode(payloads()), strict=True):
        want = (np.frombuffer(p, np.uint8) ^ 128).view(np.int8)
        assert (flac.decode([m])[0] == want).all() and (flac.decode_plain(m)[:, 0] == want).all()


def test_damage_is_found():
    media = flac.encode([flac.payload("some text of a page " * 100)])[0]
    first = flac.metadata(media)["frames"]
    for at in range(first, len(media), 37):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([media[:-5]])


def test_plain_decoder_reads_stereo_wasted_and_escaped():
    """A frame written bit by bit: mid/side, 16 bits, one wasted bit in one channel, an escaped partition."""
    left, right = [100, 102, 98, 96] * 4, [90, 92, 92, 90] * 4
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    out = ""
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    head = bytes([0xFF, 0xF8, 0x60, 0xA8, 0, 15])
    crc = 0
    for b in head:
        crc = int(flac.CRC8[crc ^ b])
    head += bytes([crc])
    out += put(8 << 1, 8) + put(0, 2) + put(0, 4) + put(15, 4) + put(12, 5) + "".join(put(v, 12) for v in mid)
    out += put(1 << 1 | 1, 8) + "1" + "".join(put(v >> 1, 16) for v in side)
    out += "0" * (-len(out) % 8)
    frame = head + int(out, 2).to_bytes(len(out) // 8, "big")
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | 16).to_bytes(8, "big") + bytes(16)
    got = flac.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame])[0]
    assert got[:, 0].tolist() == left and got[:, 1].tolist() == right


def test_blocks_and_seeking(spark, real, none):
    media = flac.stored(real.limit(30)).collect()
    rows = flac.blocks(spark.createDataFrame([(r.doc_id, bytes(r.media)) for r in media] + [(-1, None)], "doc_id long, media binary")).collect()
    for r in media:
        own = sorted((b for b in rows if b.doc_id == r.doc_id), key=lambda b: b.block)
        assert [b.sample_offset for b in own] == np.cumsum([0, *(b.samples for b in own)])[:-1].tolist()
        pcm = b"".join(b.pcm for b in own)
        m = bytes(r.media)
        assert pcm == flac.decode([m])[0].tobytes()
        for sample in (0, len(pcm) // 2, len(pcm) - 1):
            at, byte = flac.seek(m, sample)
            info = flac.metadata(m)
            head = m[: info["frames"]]
            clear = head[:21] + b"\0" * 21 + head[42:]  # total samples and MD5 unknown: a stream from the middle
            clear = head[: 4 + 4 + 13] + bytes([head[21] & 0xF0]) + bytes(4) + bytes(16) + head[42:]
            assert flac.decode_plain(clear + m[byte:])[sample - at, 0] == np.frombuffer(pcm, np.int8)[sample]
    assert flac.digests(flac.stored(none)).count() == 0 and flac.blocks(flac.stored(none)).count() == 0


def test_query_seeks(spark, sf):
    """The registered query: stored, read back, and the middle sample's frame decoded by itself."""
    from quirebase.llm.queries import op1_flac

    rows = {r.doc_id: r for r in op1_flac(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for d, r in rows.items():
        p = flac.payload(docs[d])
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.seek_crc32 == zlib.crc32(p[r.seek_sample : r.seek_sample + flac.BLOCK])
        assert r.seek_sample <= len(p) // 2 < r.seek_sample + flac.SEEK_EVERY * flac.BLOCK and r.n_blocks == -(-len(p) // (flac.SEEK_EVERY * flac.BLOCK))
