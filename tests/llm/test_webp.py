import hashlib
import zlib

import numpy as np
import pytest
from webp_writer import write

from umbra.llm import op6_webp as op
from umbra.llm import webp


def noise(n, levels=256, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, levels, (n, 4)).astype(np.uint8) * (256 // levels if levels < 256 else 1)).astype(np.uint8).view("<u4").ravel()


def same(pixels, width, *transforms, **options):
    w, h, out = webp.read(write(pixels, width, transforms, **options))
    assert (w, h) == (width, len(pixels) // width)
    assert out.tolist() == np.asarray(pixels).tolist()


def test_short_distances_follow_the_format():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    same(noise(9 * 7, 16, mode), 9, ("predictor", [mode] * 6))


def test_transforms_one_by_one_and_together():
    p = noise(10 * 6)
    same(p, 10)
    same(p, 10, ("green",))
    same(p, 10, ("cross", noise(6, seed=5)))
    same(p, 10, ("predictor", [11, 12, 13, 5, 1, 2]), ("cross", noise(6, seed=6)), ("green",))
    for colours in (1, 2, 4, 16, 200):
        q = noise(colours, seed=colours)[np.random.default_rng(2).integers(0, colours, 10 * 6)]
        same(q, 10, ("palette",))


def test_cache_copies_and_groups():
    p = noise(12 * 8, 2)
    same(p, 12, cache_bits=5)
    same(p, 12, index=[0, 1, 2, 1, 0, 2], size=2)
    same(p, 12, cache_bits=3, index=[0, 1, 0, 1, 1, 0], size=2)
    r = np.concatenate([p[:24], p[:24], np.repeat(p[23:24], 24)])
    copies = {24: (24, webp.NEAR.index((0, 2)) + 1), 48: (24, webp.NEAR.index((1, 0)) + 1)}
    same(r, 12, copies=copies)
    same(r, 12, copies=copies, cache_bits=4)


def test_damaged_media_do_not_stop_the_others(spark):
    good = write(noise(64), 8)
    rng = np.random.default_rng(1)
    bad = [b"", b"no image", good[:30], good + write(noise(64), 16), b"RIFF" + good[4:8] + b"WEBPVP8 " + good[16:]]
    torn = [bytes(x if rng.random() > 0.02 else int(rng.integers(256)) for x in good) for _ in range(30)]
    rows = [(k, bytearray(x)) for k, x in enumerate([good, good + good, *bad, *torn])] + [(-1, None)]
    out = {r.k: r for r in op.decode(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert out[0].error is None and (out[0].width, out[0].height) == (8, 8) and (out[1].width, out[1].height) == (8, 16)
    assert bytes(out[1].pixels) == bytes(out[0].pixels) * 2 and out[-1].pixels is None and out[-1].error is None
    assert all(out[2 + k].error and out[2 + k].pixels is None for k in range(len(bad)))
    assert len(out) == len(rows)


def test_long_payloads_are_decoded_whole(spark):
    text = "".join(chr(97 + k % 23) + str(k) for k in range(70_000))
    stored = op.store(spark.createDataFrame([(1, text * 5)], "k int, text string")).drop("text")
    shown = op.decode(stored).first()
    pixels = np.frombuffer(bytes(shown.pixels), "<u4")
    assert shown.error is None and (pixels >> 8).astype(np.uint8).tobytes() == op.padded(text * 5)[0] and len(pixels) == shown.width * shown.height > 64 * op.MAX_ROWS


def test_damage_is_an_error():
    good = write(noise(64), 8)
    for bad in (b"", good[:30], b"RIFF" + good[4:8] + b"WEBPVP8 " + good[16:]):
        with pytest.raises(ValueError):
            webp.read(bad)


@pytest.mark.parametrize("text", ["", None, "a", "a" * 64, "ab" * 4000, "x" * 300_000, "xyz" * 700_000, "Übung é\n" * 50, "the quick brown fox jumps over the lazy dog. " * 3])
def test_payload_round_trip(text):
    payload, n = op.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and n == len((text or "").encode())
    assert op.from_media(op.to_media(payload)) == payload


def test_grey_images_are_grey():
    media = webp.write_grey(np.arange(128, dtype=np.uint8), 64)
    _, _, pixels = webp.read(media)
    assert pixels[100] == 0xFF646464


def test_query_and_columns(spark, tmp_path):
    rows = [(1, "Text", "x"), (2, None, "y"), (3, "Text", None)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    payload = b"Text" + bytes(60)
    assert out[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[1].tail_crc32 == zlib.crc32(payload)
    assert out[1].media_sha256 == out[3].media_sha256 and out[2].n_bytes == 0 and out[2].payload_bytes == 64
    stored = op.store(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    shown = op.decode(stored.select("doc_id", "media")).collect()
    assert {(r.width, r.height, len(r.pixels)) for r in shown} == {(64, 1, 256)}
    assert op.read_back(stored.limit(0)).count() == 0
