import hashlib
import itertools
import zlib

import numpy as np
import pytest

from fragmill.llm import tiff

CASES = list(itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (None, (16, 32)), "<>", (1, 3)))


@pytest.mark.parametrize(("scheme", "predictor", "tile", "order", "samples"), CASES)
def test_round_trip(scheme, predictor, tile, order, samples):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (37, 50, samples), dtype=np.uint8), np.zeros((5, 300, samples), np.uint8), rng.integers(0, 3, (90, 90, samples), dtype=np.uint8)]
    found = list(tiff.pages(tiff.written(images, scheme, predictor, 16, tile, order)))
    assert [(p.number, p.error) for p in found] == [(0, None), (1, None), (2, None)]
    assert all(p.pixels == i.tobytes() and (p.height, p.width, p.samples) == i.shape for p, i in zip(found, images, strict=True))


def test_bad_files_are_pages_with_errors(spark):
    good = tiff.written([np.full((4, 4, 1), 7, np.uint8)])
    loop = bytearray(tiff.written([np.full((2, 2, 1), 1, np.uint8), np.full((2, 2, 1), 2, np.uint8)]))
    last = len(loop) - 4 - (len(loop) % 2)
    rows = [(1, good), (2, good[:20]), (3, b"GIF89a.."), (4, b""), (5, None), (6, good)]
    got = tiff.read_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sorted((r.doc_id, r.error is None) for r in got) == [(1, True), (2, False), (3, False), (6, True)]
    assert {bytes(r.pixels) for r in got if not r.error} == {b"\x07" * 16}
    assert last > 0


def test_texts_through_pages(spark):
    texts = ["", None, "a" * 64, "é\0\n" * 500, "x" * 70000, "a" * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tiff.op2(docs).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[k].n_bytes, got[k].payload_bytes) == (len(raw), len(payload))
        assert got[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[k].tail_crc32 == zlib.crc32(payload[-64:])
        media = tiff.stored(raw)
        assert (got[k].media_bytes, got[k].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2][1:] == got[5][1:]
    assert tiff.op2(docs.limit(0)).count() == 0


def test_zero_strips_and_early_lzw_codes_are_page_errors():
    image = np.full((4, 4, 1), 7, np.uint8)
    for scheme, tag in ((tiff.NONE, tiff.STRIP_ROWS), (tiff.NONE, tiff.TILE_WIDTH), (tiff.LZW, None)):
        media = bytearray(tiff.written([image], scheme, tile=(16, 16) if tag == tiff.TILE_WIDTH else None))
        fields, _ = tiff._fields(bytes(media), "<", int.from_bytes(media[4:8], "little"))
        if tag is None:
            # A clear code (256), then code 400, which no table holds yet: nine bits each.
            at = fields[tiff.STRIP_AT][0]
            media[at : at + 3] = (256 << 15 | 400 << 6).to_bytes(3, "big")
        else:
            at = int.from_bytes(media[4:8], "little")
            for k in range(int.from_bytes(media[at : at + 2], "little")):
                entry = at + 2 + 12 * k
                if int.from_bytes(media[entry : entry + 2], "little") == tag:
                    media[entry + 8 : entry + 12] = bytes(4)
        (page,) = tiff.pages(bytes(media))
        assert page.error


def patched(media, tag, value):
    out = bytearray(media)
    at = int.from_bytes(out[4:8], "little")
    for k in range(int.from_bytes(out[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(out[entry : entry + 2], "little") == tag:
            out[entry + 8 : entry + 12] = value.to_bytes(4, "little")
    return bytes(out)


def test_sizes_are_checked_before_anything_is_allocated():
    image = np.full((40, 4, 1), 7, np.uint8)
    two = tiff.written([image], tiff.NONE, strip_rows=20)
    assert tiff.pages(two).__next__().error is None
    bad = [
        patched(two, tiff.STRIP_ROWS, 10),
        patched(patched(two, tiff.WIDTH, 16777215), tiff.HEIGHT, 16777215),
        patched(tiff.written([image], tiff.DEFLATE), tiff.HEIGHT, 16777215),
        patched(tiff.written([image], tiff.NONE), tiff.STRIP_SIZE, 10**9),
        patched(tiff.written([image], tiff.NONE), tiff.STRIP_SIZE, 10),
    ]
    for media in bad:
        (page,) = tiff.pages(media)
        assert page.error and not page.pixels


def test_a_bomb_is_unpacked_no_further_than_its_page():
    image = np.zeros((8, 8, 1), np.uint8)
    for scheme, pack in ((tiff.DEFLATE, lambda x: tiff.zlib.compress(x)), (tiff.PACKBITS, tiff.pack_bits), (tiff.LZW, tiff.pack_lzw)):
        assert len(tiff.decoded(scheme, pack(bytes(1_000_000)), 64)) <= 5000
        assert tiff.decoded(scheme, pack(image.tobytes()), 64)[:64] == image.tobytes()


def test_texts_go_through_every_coding():
    rng = np.random.default_rng(3)
    seen = set()
    for n in (0, 1, 300, 512, 513, 1000, 1024, 1025, 70_000, 2_500_000):
        text = rng.integers(97, 105, n, dtype=np.uint8).tobytes()
        payload, feature = tiff.digest(tiff.stored(text))
        assert payload[:n] == text and not any(payload[n:]) and len(payload) == max(64, -(-n // 64) * 64)
        seen.add(feature.split(":")[2])
    assert seen == {"lzw", "packbits", "deflate"}
    assert tiff.digest(tiff.stored(text))[1].startswith("3:")
