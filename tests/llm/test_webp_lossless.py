import hashlib
import zlib

import numpy as np
import pytest

from marlstone.llm import webp_lossless as W


def noise(h, w, seed=0, alpha=True):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (h, w, 4))
    x[: h // 2] = np.cumsum(rng.integers(-3, 4, (h // 2, w, 4)), axis=1) + 128
    if not alpha:
        x[..., 3] = 255
    return W._joined(x)


@pytest.mark.parametrize("h,w", [(1, 1), (1, 9), (7, 1), (13, 21), (40, 33)])
@pytest.mark.parametrize("subtract", [False, True])
def test_channels_cache_and_green(h, w, subtract):
    x = noise(h, w)
    x[h // 2 :] = x[0, 0]
    for bits in (0, 1, 5, 11):
        assert (W.decode(W.encode(x, subtract_green=subtract, cache_bits=bits)) == x).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = noise(17, 23, mode)
    modes = np.full((5, 6), mode)
    modes[2, 3] = (mode + 5) % 14
    assert (W.decode(W.encode(x, predictor=(2, modes))) == x).all()


def test_all_transforms_and_groups_together():
    rng = np.random.default_rng(3)
    x = noise(37, 50, 9)
    data = W.encode(x, predictor=(3, rng.integers(0, 14, (5, 7))), cross=(2, rng.integers(0, 256, (10, 13, 4)) | np.array([0, 0, 0, 255])), subtract_green=True, cache_bits=4, groups=(4, rng.integers(0, 3, (3, 4))))
    assert (W.decode(data) == x).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    x = noise(16, 16, 4).ravel()[rng.integers(0, colours, (19, 27))]
    assert (W.decode(W.encode(x, palette=True)) == x).all()


def test_back_references_overlap_and_reach_far():
    x = np.zeros((64, 64), np.uint32) | np.uint32(W.BLACK)
    flat = x.ravel()
    flat[:100] |= (np.arange(100, dtype=np.uint32) * 7 % 256) << np.uint32(8)
    flat[100:1100] = np.resize(flat[90:100], 1000)
    flat[2000:2100] = flat[:100]
    flat[4000:4096] = flat[3:99]
    copies = [(100, 1000, 10), (2000, 100, 2000), (4000, 96, 3997)]
    assert (W.decode(W.encode(x, copies=copies)) == x).all()
    y = x | np.uint32(0x00120000)
    y[3, 3] ^= np.uint32(0x00FF00FF)  # the other channels take bits: the plain path
    y.ravel()[2000:2100], y.ravel()[4000:4096] = y.ravel()[:100], y.ravel()[3:99]
    y.ravel()[100:1100] = np.resize(y.ravel()[90:100], 1000)
    assert (W.decode(W.encode(y, copies=copies, cache_bits=3)) == y).all()


def test_near_distances_name_neighbours():
    assert len(set(W.PLANE)) == 120 and all(0 <= y <= 7 and -8 <= x <= 8 and (y > 0 or x > 0) for x, y in W.PLANE)
    assert [W._distance(k, 50) for k in (1, 2, 3, 4, 120, 121)] == [50, 1, 51, 49, 358, 1]
    assert W._distance(4, 1) == 1
    for v in (1, 2, 4, 5, 6, 7, 12, 100, 4096, 1 << 20):
        prefix, extra, n = W._prefix(v)
        bits = W.Bits(extra.to_bytes(8, "little"))
        assert W._extra(bits, prefix) == v and bits.at == n


@pytest.mark.parametrize("raw", [b"", b"a", b"ab" * 40000, bytes(range(256)) * 9, b"a line that comes again and again\n" * 500, "naïve ünïcode ".encode() * 77, np.random.default_rng(5).integers(0, 256, 1_200_000, dtype=np.uint8).tobytes()])
def test_payloads(raw):
    p = W.padded(raw)
    x = W.decode(W.payload_image(p))
    assert (x >> np.uint32(8) & np.uint32(255)).astype(np.uint8).ravel()[: len(p)].tobytes() == p


def test_malformed_files_raise():
    good = W.payload_image(W.padded(b"some text of a document " * 20))
    for bad in (b"", b"RIFF", good[:40], b"XXXX" + good[4:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(ValueError):
            W.decode(bad)


def test_query(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "null id"), (1, "hello world"), (5, "é" * 1000), (6, "long words " * 20000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, media string")
    got = {(r.doc_id, r.payload_sha256): r for r in W.features(W.store(docs)).collect()}
    for doc_id, text in rows:
        raw = (text or "").encode()
        p = W.padded(raw)
        r = got[doc_id, hashlib.sha256(p).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(p), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(W.payload_image(p)).hexdigest()
    assert W.features(W.store(docs)).count() == len(rows)
    assert W.features(W.store(docs.limit(0))).count() == 0


def test_the_smaller_of_predictor_and_plain_codes_stays():
    rng = np.random.default_rng(3)
    row = rng.integers(0, 256, 64, dtype=np.uint8)
    steps = b"".join(((row.astype(int) + k) % 256).astype(np.uint8).tobytes() for k in range(200))
    plain = W.encode(np.frombuffer(steps, np.uint8).reshape(-1, 64).astype(np.uint32) << np.uint32(8) | np.uint32(W.BLACK))
    image = W.payload_image(steps)
    assert len(image) < len(plain) / 3
    assert ((W.decode(image) >> np.uint32(8)).astype(np.uint8)).tobytes() == steps


def test_long_payloads_are_several_files():
    payload = W.padded("".join(f"line {k} of a long text\n" for k in range(900)).encode())
    media = W.payload_images(payload, most=1 << 12)
    assert media.count(b"RIFF") == -(-len(payload) >> 12)
    got = b"".join((x >> np.uint32(8)).astype(np.uint8).tobytes() for x in W.images_of(media))
    assert got == payload
