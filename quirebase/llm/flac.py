"""FLAC media columns: an encoder, a checked decoder, and the operators over columns of FLAC streams.

Both directions work on blocks of frames at once. The decoder reads one residual of every frame of a block per step,
so its inner loop is a few numpy operations over a thousand frames, whatever documents these come from. Streams that
are not mono of one block size go to a plain decoder of the whole format (stereo modes, wasted bits, escaped
partitions, any sample size), which also serves as the reference in tests. Both verify the header's CRC-8, the
frame's CRC-16 and the stream's MD5, and raise ValueError where one fails.

Defined cases: a null text is stored as an empty one; equal texts give equal bytes; repeated rows are stored each;
a null media value gives no blocks and null PCM; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

BLOCK = 576
RATE = 8000
#: Frames handled at once, and frames between two points of the seek table.
FRAMES, SEEK_EVERY = 1024, 8
LPC, PRECISION, SHIFT = 4, 10, 8
PARTS = 2  # partition order: 2^PARTS Rice parameters a frame


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out & top, out << 1 ^ poly, out << 1) & mask
    return out


CRC8 = _crc_table(0x07, 8)
CRC16 = _crc_table(0x8005, 16)
#: _FAR[d][b]: what byte b adds to a CRC-16 when d bytes follow it.
_FAR: list[np.ndarray] = [CRC16[None].astype(np.uint16)]


def crc16(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[begin:end] for many, non-empty ranges: it is linear, so each byte adds its own table entry."""
    size = end - begin
    while len(_FAR[0]) < size.max(initial=1):
        last = _FAR[0][-1].astype(np.int64)
        rows = []
        for _ in range(512):
            last = (last << 8 & 0xFFFF) ^ CRC16[last >> 8]
            rows.append(last.astype(np.uint16))
        _FAR[0] = np.concatenate([_FAR[0], rows])
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    far = np.repeat(size, size) - 1 - at
    return np.bitwise_xor.reduceat(_FAR[0].ravel()[far * 256 + buf[at + np.repeat(begin, size)]], first)


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> 6 * (size - 1), *tail])


def _header(number: int) -> bytes:
    head = b"\xff\xf8\x20\x02" + _number(number)
    crc = 0
    for b in head:
        crc = int(CRC8[crc ^ b])
    return head + bytes([crc])


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (frames, LPC) by Levinson-Durbin on the exact autocorrelation."""
    r = np.stack([(x[:, j:] * x[:, : x.shape[1] - j]).sum(axis=1) for j in range(LPC + 1)]).astype(np.float64)
    a = np.zeros((LPC, x.shape[0]))
    err = np.maximum(r[0], 1.0)
    for i in range(LPC):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros_like(err))) / err
        old = a[:i].copy()
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1.0)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(a.T * (1 << SHIFT)), -top, top - 1).astype(np.int64), err


def _residuals(x: np.ndarray, coef: np.ndarray) -> list[np.ndarray]:
    """Of the fixed predictors of order 0, 1, 2 and of the linear one; warm-up samples are left as they are."""
    out = [x, x.copy(), x.copy(), x.copy()]
    out[1][:, 1:] -= x[:, :-1]
    out[2][:, 2:] -= 2 * x[:, 1:-1] - x[:, :-2]
    n = x.shape[1]
    out[3][:, LPC:] -= sum(coef[:, j : j + 1] * x[:, LPC - 1 - j : n - 1 - j] for j in range(LPC)) >> SHIFT
    return out


#: Of the four predictors: samples stored as they are, and the subframe's type byte.
ORDERS = np.array([0, 1, 2, LPC])
TYPES = np.array([8 << 1, 9 << 1, 10 << 1, (32 + LPC - 1) << 1])


def _rice(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals after `order` warm-up samples -> their values as Rice codes them, each partition's parameter, and its bits."""
    u = np.where(r < 0, -2 * r - 1, 2 * r)
    u[:, :order] = 0
    part = u.reshape(len(u), 1 << PARTS, -1)
    count = np.full((1, 1 << PARTS), BLOCK >> PARTS)
    count[0, 0] -= order
    middle = np.log2(np.maximum(part.sum(axis=2) / count, 1)).astype(np.int64)
    tried = [np.clip(middle + d, 0, 14) for d in (-1, 0, 1)]
    bits = np.stack([(part >> k[:, :, None]).sum(axis=2) + count * (k + 1) for k in tried])
    best = bits.argmin(axis=0)
    return u, np.choose(best, tried), np.choose(best, bits)


def _encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (frames, BLOCK) samples -> all frames' bytes, and each frame's size; of the predictors the one that takes the fewest bits."""
    f = len(x)
    heads = [_header(n) for n in number.tolist()]
    head = np.array([len(h) for h in heads])
    coef, _ = _predictors(x)
    coded_as = [_rice(r, int(o)) for r, o in zip(_residuals(x, coef), ORDERS, strict=True)]
    weights = np.array([0, 0, 0, 9 + LPC * PRECISION])
    cost = np.stack([bits.sum(axis=1) for _, _, bits in coded_as]) + (8 * ORDERS + weights)[:, None]
    kind = cost.argmin(axis=0)
    order = ORDERS[kind]
    u = np.choose(kind[:, None], [c[0] for c in coded_as])
    k = np.choose(kind[:, None], [c[1] for c in coded_as])
    coded = np.arange(BLOCK) >= order[:, None]
    width = BLOCK >> PARTS
    pre = 8 + 8 * order + weights[kind] + 6
    total = 8 + 6 + 4 * (1 << PARTS) + cost.min(axis=0)
    kk = np.repeat(k, width, axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (total >= 8 + 8 * BLOCK)
    total = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, total))
    size = head + (total + 7) // 8 + 2
    start = np.cumsum(size) - size
    out = np.zeros(size.sum() * 8, np.uint8)
    at = (start + head) * 8

    def put(where: np.ndarray, value: np.ndarray, n: int) -> None:
        for b in range(n):
            out[where + (n - 1 - b)] = value >> b & 1

    put(at, np.where(constant, 0, np.where(verbatim, 2, TYPES[kind])), 8)
    put(at[constant] + 8, x[constant, 0], 8)
    if verbatim.any():
        put(at[verbatim, None] + 8 + 8 * np.arange(BLOCK), x[verbatim], 8)
    coding = np.flatnonzero(~constant & ~verbatim)
    if len(coding):
        for j in range(LPC):
            warm = coding[order[coding] > j]
            put(at[warm] + 8 + 8 * j, x[warm, j], 8)
        lin = coding[kind[coding] == 3]
        base = at[lin] + 8 + 8 * LPC
        put(base, np.full(len(lin), PRECISION - 1), 4)
        put(base + 4, np.full(len(lin), SHIFT), 5)
        for j in range(LPC):
            put(base + 9 + j * PRECISION, coef[lin, j], PRECISION)
        base = at[coding] + pre[coding]
        put(base - 6, np.full(len(coding), PARTS), 6)
        low, ks = u[coding], kk[coding]
        live = coded[coding]
        length = np.where(live, (low >> ks) + 1 + ks, 0)
        begin = np.arange(BLOCK) % width == 0
        ends = np.cumsum(length + np.where(begin, 4, 0), axis=1) + base[:, None]
        put((ends - length)[:, begin] - 4, ks[:, begin], 4)
        value = (1 << ks) | (low & ((1 << ks) - 1))
        for b in range(int(ks.max()) + 1):
            sel = live & (ks >= b)
            out[ends[sel] - 1 - b] = value[sel] >> b & 1
    flat = np.packbits(out)
    where = np.repeat(start, head) + np.arange(head.sum()) - np.repeat(np.cumsum(head) - head, head)
    flat[where] = np.frombuffer(b"".join(heads), np.uint8)
    crc = crc16(flat, start, start + size - 2)
    flat[start + size - 2], flat[start + size - 1] = crc >> 8, crc & 255
    return flat, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """8-bit mono FLAC streams whose samples are the bytes (less 128); each length a positive multiple of BLOCK."""
    count = np.array([len(p) // BLOCK for p in payloads])
    if any(len(p) != c * BLOCK or not c for p, c in zip(payloads, count.tolist(), strict=True)):
        raise ValueError(f"payloads are positive multiples of {BLOCK} bytes")
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    number = np.arange(len(joined)) - np.repeat(np.cumsum(count) - count, count)
    flats, sizes = [], []
    for i in range(0, len(joined), FRAMES):
        flat, size = _encode_frames(joined[i : i + FRAMES].astype(np.int64) - 128, number[i : i + FRAMES])
        flats.append(flat.tobytes())
        sizes.append(size)
    flat, size = b"".join(flats), np.concatenate(sizes or [np.zeros(0, np.int64)])
    ends = np.cumsum(size)
    out, at, frame = [], 0, 0
    for p, c in zip(payloads, count.tolist(), strict=True):
        own = size[frame : frame + c]
        end = int(ends[frame + c - 1])
        rel = np.cumsum(own) - own
        pcm = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | c * BLOCK).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        # The first frame needs no seek point, and a stream without others no table.
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(rel[i]), BLOCK) for i in range(SEEK_EVERY, c, SEEK_EVERY))
        table = b"\x83" + len(seek).to_bytes(3, "big") + seek if seek else b""
        out.append(b"fLaC" + (b"\0" if seek else b"\x80") + len(info).to_bytes(3, "big") + info + table + flat[at:end])
        at, frame = end, frame + c
    return out


def metadata(media: bytes) -> dict:
    """The stream's parameters, its seek points [(sample, byte, samples)] and where its frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {"seek": []}
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("the stream ends in its metadata")
        if kind == 0:
            rest = int.from_bytes(body[10:18], "big")
            out |= {"block": struct.unpack(">HH", body[:4]), "rate": rest >> 44, "channels": (rest >> 41 & 7) + 1, "bits": (rest >> 36 & 31) + 1, "samples": rest & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + size
    return out | {"frames": at}


# --- the plain decoder: any stream ---------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the stream ends in a frame")
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


#: The format's codes for block sizes, sample sizes and the fixed predictors' weights.
BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{i: 256 << (i - 8) for i in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: _Bits, n: int, depth: int) -> list[int]:
    head = bits.take(8)
    wasted = bits.unary() + 1 if head & 1 else 0
    depth, kind = depth - wasted, head >> 1
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        weights, shift = FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.take(2), bits.take(4)
        size, escape = (4, 15) if method == 0 else (5, 31)
        for p in range(1 << parts):
            k = bits.take(size)
            raw = bits.take(5) if k == escape else None
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if raw is not None:
                    r = bits.signed(raw)
                else:
                    u = bits.unary() << k | bits.take(k)
                    r = u >> 1 ^ -(u & 1)
                out.append(r + (sum(w * v for w, v in zip(weights, out[::-1][:order], strict=True)) >> shift))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    return [v << wasted for v in out]


def decode_plain(media: bytes) -> np.ndarray:
    """(samples, channels) of any FLAC stream, one frame after the other."""
    try:
        return _decode_plain(media, metadata(media))
    except (OverflowError, KeyError, IndexError, struct.error) as e:  # where damage leads before a checksum is reached
        raise ValueError("the stream is damaged") from e


def _decode_plain(media: bytes, info: dict) -> np.ndarray:
    out = []
    at = info["frames"]
    while at < len(media):
        bits = _Bits(media, at)
        if bits.take(15) != 0x7FFC:
            raise ValueError("no frame where one should begin")
        bits.take(1)
        block, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        for _ in range(max(0, 8 - (~lead & 255).bit_length() - 1)):
            bits.take(8)
        n = bits.take(8) + 1 if block == 6 else bits.take(16) + 1 if block == 7 else BLOCKS[block]
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        crc = 0
        for b in media[at : bits.at >> 3]:
            crc = int(CRC8[crc ^ b])
        if crc != bits.take(8):
            raise ValueError("a frame header's CRC-8 is wrong")
        width = info["bits"] if depth == 0 else SAMPLE_BITS[depth]
        count = channels + 1 if channels < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(channels, -1)
        sub = [np.array(_subframe(bits, n, width + (c == side)), np.int64) for c in range(count)]
        if channels == 8:
            sub[1] = sub[0] - sub[1]
        elif channels == 9:
            sub[0] = sub[0] + sub[1]
        elif channels == 10:
            mid = sub[0] << 1 | sub[1] & 1
            sub = [(mid + sub[1]) >> 1, (mid - sub[1]) >> 1]
        end = (bits.at + 7) >> 3
        if int.from_bytes(media[end : end + 2], "big") != int(crc16(np.frombuffer(media, np.uint8), np.array([at]), np.array([end]))[0]):
            raise ValueError("a frame's CRC-16 is wrong")
        out.append(np.stack(sub, axis=1))
        at = end + 2
    return _checked(np.concatenate(out) if out else np.zeros((0, info["channels"]), np.int64), info)


def _checked(pcm: np.ndarray, info: dict) -> np.ndarray:
    if info["samples"] and len(pcm) != info["samples"]:
        raise ValueError("the stream lacks samples")
    if any(info["md5"]) and hashlib.md5(pcm_bytes(pcm, info["bits"])).digest() != info["md5"]:
        raise ValueError("the samples' MD5 is wrong")
    return pcm


def pcm_bytes(pcm: np.ndarray, bits: int) -> bytes:
    """Signed little-endian samples, channels interleaved."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(pcm.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


# --- the block decoder: mono, 8 bits, one block size ----------------------------------------------------------------

_LEAD = np.array([16 - i.bit_length() for i in range(65536)], np.uint8)


def _starts(buf: np.ndarray, begin: int, end: int) -> np.ndarray | None:
    """Where the frames of buf[begin:end] begin: valid headers numbered 0, 1, 2 ...; None if these don't add up."""
    own = buf[begin:end]
    at = np.flatnonzero((own[:-1] == 0xFF) & (own[1:] == 0xF8))
    data = own.tobytes()
    found = []
    for a in at.tolist():
        if data.startswith(_header(len(found)), a):
            found.append(a)
    return np.array(found) + begin if found and found[0] == 0 else None


class _Frames:
    """Reads bits of many frames at once; `at` holds each frame's bit position."""

    def __init__(self, buf: np.ndarray):
        pad = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
        #: The 64 bits from each byte on.
        self.words = np.zeros(len(buf) + 1, np.uint64)
        for i in range(8):
            self.words |= pad[i : i + len(self.words)] << np.uint64(56 - 8 * i)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.window(at).view(np.int64) >> np.int64(64 - n)).astype(np.int64)

    def residuals(self, at: np.ndarray, order: int, parts: int, out: np.ndarray) -> None:
        """out (BLOCK, frames): Rice residuals from sample `order` on."""
        width = BLOCK >> parts
        k = k63 = None
        for i in range(order, BLOCK):
            if i % width == 0 or i == order:
                k = self.take(at, 4)
                if (k == 15).any():
                    raise NotImplementedError
                at = at + 4
                k63, uk = (63 - k).astype(np.uint64), k.astype(np.uint64)
            x = self.words.take(at >> 3) << (at & 7).view(np.uint64)
            lead = _LEAD.take((x >> np.uint64(48)).view(np.int64)).astype(np.int64)
            far = lead == 16
            if far.any():  # 16 or more zeros: only these frames read on
                q = np.zeros_like(lead)
                while far.any():
                    q[far] += 16
                    at = np.where(far, at + 16, at)
                    if (at >> 3 >= len(self.words)).any():
                        raise ValueError("the stream ends in a frame")
                    x = self.words.take(at >> 3) << (at & 7).view(np.uint64)
                    lead = _LEAD.take((x >> np.uint64(48)).view(np.int64)).astype(np.int64)
                    far &= lead == 16
                quotient = q + lead
            else:
                quotient = lead
            lead = lead + 1
            low = x << lead.view(np.uint64) >> np.uint64(1) >> k63
            u = (quotient.view(np.uint64) << uk | low).view(np.int64)
            out[i] = u >> 1 ^ -(u & 1)
            at = at + lead + k

    def decode(self, begin: np.ndarray) -> np.ndarray:
        """begin: byte at which each frame's subframe begins -> (frames, BLOCK) samples."""
        at = begin * 8
        kind = self.take(at, 8)
        if (kind & 1).any():
            raise NotImplementedError
        kind >>= 1
        out = np.zeros((len(at), BLOCK), np.int64)
        for t in np.unique(kind).tolist():
            own = np.flatnonzero(kind == t)
            a = at[own] + 8
            if t == 0:
                out[own] = self.signed(a, 8)[:, None]
            elif t == 1:
                out[own] = self.signed(a[:, None] + 8 * np.arange(BLOCK), 8)
            elif 8 <= t <= 12 or t >= 32:
                order = t - 8 if t < 32 else t - 31
                x = np.zeros((BLOCK, len(own)), np.int64)
                for j in range(order):
                    x[j] = self.signed(a + 8 * j, 8)
                a = a + 8 * order
                if t >= 32:
                    precision = self.take(a, 4) + 1
                    shift = self.signed(a + 4, 5)
                    if len(set(precision.tolist())) > 1 or (shift < 0).any():
                        raise NotImplementedError
                    p = int(precision[0])
                    weights = [self.signed(a + 9 + p * j, p) for j in range(order)]
                    a = a + 9 + p * order
                method = self.take(a, 6)
                if len(set(method.tolist())) > 1 or method[0] >> 4 or BLOCK % (1 << (method[0] & 15)) or BLOCK >> (method[0] & 15) < order:
                    raise NotImplementedError
                self.residuals(a + 6, order, int(method[0] & 15), x)
                if t >= 32:
                    for i in range(order, BLOCK):
                        guess = weights[0] * x[i - 1]
                        for j in range(1, order):
                            guess += weights[j] * x[i - 1 - j]
                        x[i] += guess >> shift
                else:
                    for level in range(order - 1, -1, -1):
                        # the difference of this level at its first sample, from the warm-up samples
                        x[level] = sum((-1) ** (level - j) * _choose(level, j) * x[j] for j in range(level + 1))
                        np.cumsum(x[level:], axis=0, out=x[level:])
                out[own] = x.T
            else:
                raise ValueError(f"reserved subframe type {t}")
        return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def decode(media: list[bytes]) -> list[np.ndarray]:
    """The samples of many streams: (samples,) for mono ones, (samples, channels) for others; all checks made."""
    infos = [metadata(m) for m in media]
    buf = np.frombuffer(b"".join(media), np.uint8)
    ends = np.cumsum([len(m) for m in media])
    begin, owner, slow = [], [], []
    for i, (m, info) in enumerate(zip(media, infos, strict=True)):
        base = int(ends[i]) - len(m)
        fits = info["channels"] == 1 and info["bits"] == 8 and info["block"] == (BLOCK, BLOCK) and info["samples"] % BLOCK == 0 and info["samples"]
        found = _starts(buf, base + info["frames"], int(ends[i])) if fits else None
        if found is None or len(found) * BLOCK != info["samples"]:
            slow.append(i)
        else:
            begin.append(found)
            owner.append(np.full(len(found), i))
    out: list[np.ndarray | None] = [None] * len(media)
    if begin:
        first, own = np.concatenate(begin), np.concatenate(owner)
        last = np.append(first[1:], 0)
        final = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        last[final] = ends[own[final]]
        pcm = np.zeros((len(first), BLOCK), np.int8)
        bad = set()
        for i in range(0, len(first), FRAMES):
            a, b = first[i : i + FRAMES], last[i : i + FRAMES]
            crc = crc16(buf, a, b - 2)
            wrong = (crc >> 8 != buf[b - 2]) | (crc & 255 != buf[b - 1])
            if wrong.any():
                bad |= set(own[i : i + FRAMES][wrong].tolist())
                continue
            lead = buf[a + 4]
            size = np.where(lead < 128, 1, 8 - np.array([(~v & 255).bit_length() for v in lead.tolist()]))
            lo, hi = int(a.min()), int(b.max())
            try:
                pcm[i : i + FRAMES] = _Frames(buf[lo:hi]).decode(a - lo + 4 + size + 1)
            except NotImplementedError:
                bad |= set(own[i : i + FRAMES].tolist())
        for i, at in zip(own[final].tolist(), final.tolist(), strict=True):
            n = infos[i]["samples"] // BLOCK
            if i in bad:
                slow.append(i)
            else:
                out[i] = pcm[at + 1 - n : at + 1].ravel()
                if hashlib.md5(out[i].tobytes()).digest() != infos[i]["md5"]:
                    raise ValueError("the samples' MD5 is wrong")
    for i in slow:
        got = decode_plain(media[i])
        out[i] = got[:, 0] if got.shape[1] == 1 else got
    return out


def seek(media: bytes, sample: int) -> tuple[int, int]:
    """(sample, byte): the last seek point at or before a sample, its byte counted from the stream's beginning."""
    info = metadata(media)
    points = [(0, 0, 0), *(p for p in info["seek"] if p[0] <= sample)]
    return points[-1][0], info["frames"] + points[-1][1]


def sought(media: list[bytes], samples: list[int]) -> list[tuple[int, np.ndarray]]:
    """(first sample, samples) of the frame that the last seek point at or before a sample leads to, for each of many streams of
    this encoder; nothing else of a stream is decoded."""
    points = [seek(m, s) for m, s in zip(media, samples, strict=True)]
    cuts = [m[byte : byte + 2 * BLOCK] for m, (_, byte) in zip(media, points, strict=True)]
    ends = np.cumsum([len(c) for c in cuts])
    begin = ends - np.array([len(c) for c in cuts], np.int64)
    buf = np.frombuffer(b"".join(cuts), np.uint8)
    lead = buf[begin + 4]
    size = np.where(lead < 128, 1, 8 - np.array([(~v & 255).bit_length() for v in lead.tolist()], np.int64))
    try:
        pcm = _Frames(buf).decode(begin + 4 + size + 1)
    except NotImplementedError:
        return [(at, decode([m])[0][at : at + BLOCK]) for m, (at, _) in zip(media, points, strict=True)]
    return [(at, x.astype(np.int8)) for (at, _), x in zip(points, pcm, strict=True)]


# --- operators ------------------------------------------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def _bounded(values: list, size) -> Iterator[list]:
    """Runs of values with at most about 2 MB each."""
    part, total = [], 0
    for v in values:
        part.append(v)
        total += size(v)
        if total > 2_000_000:
            yield part
            part, total = [], 0
    if part:
        yield part


def stored(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, media): each text's padded bytes as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _bounded(batch.column(1).to_pylist(), lambda t: len(t or "")):
                n = [len((t or "").encode("utf-8", "surrogatepass")) for t in part]
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(encode([payload(t) for t in part]), pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(part)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def blocks(media: DataFrame, per_block: int = SEEK_EVERY) -> DataFrame:
    """(doc_id, media) -> PCM blocks (doc_id, block, sample_offset, samples, pcm): seekable by sample_offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m is not None:
                    bits = metadata(m)["bits"]
                    pcm = decode([m])[0]
                    for b, i in enumerate(range(0, len(pcm), per_block * BLOCK)):
                        part = pcm[i : i + per_block * BLOCK]
                        rows.append((doc, b, i, len(part), pcm_bytes(part.reshape(len(part), -1), bits)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "block", "sample_offset", "samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, samples long, pcm binary")


def feature(pcm: np.ndarray) -> str:
    """Whole-number statistics of the samples: sum, energy, peak, sign changes, sum of steps."""
    x = pcm.astype(np.int64)
    step = np.abs(np.diff(x, axis=0)).sum()
    return f"sum={x.sum()};energy={(x * x).sum()};peak={np.abs(x).max(initial=0)};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};steps={step}"


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the contract's columns, all from the stored bytes read back; and n_blocks, the PCM blocks that
    `blocks` cuts, seek_sample and seek_crc32: the frame that the seek table gives for the middle sample, decoded by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in _bounded(batch.column(2).to_pylist(), len):
                whole = decode(part)
                frames = sought(part, [len(pcm) // 2 for pcm in whole])
                for m, pcm, (at, frame) in zip(part, whole, frames, strict=True):
                    if not np.array_equal(pcm[at : at + BLOCK], frame):
                        raise ValueError("the seek table leads astray")
                    data = (pcm.view(np.uint8) ^ 128).tobytes()
                    seeks = -(-len(pcm) // (SEEK_EVERY * BLOCK)), at, zlib.crc32((frame.view(np.uint8) ^ 128).tobytes())
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(pcm), *seeks))
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), *cols], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, seek_sample long, seek_crc32 long"
    names = [c.split()[0] for c in schema.split(", ")]
    return media.mapInArrow(run, schema)
