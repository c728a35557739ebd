"""Broken files, and LZW streams written by hand after the published format."""

import random

import numpy as np
import pytest

from faultline.llm import tiff


def bits(codes):
    """Codes of given widths, most significant bit first."""
    text = "".join(format(c, f"0{w}b") for c, w in codes)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def test_lzw_of_the_published_example():
    """The worked example of the TIFF 6.0 text: 7 7 7 8 8 7 7 6 6 gives clear 7 258 8 8 258 6 6 end."""
    stream = bits([(c, 9) for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)])
    assert tiff.lzw_decode(stream) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream


def test_lzw_codes_widen_one_early():
    """After the entry 510 is made codes have ten bits, after 1022 eleven, after 2046 twelve."""
    rng, data = random.Random(1), bytearray()
    codes, width, size = [(256, 9)], 9, 258
    for _ in range(3000):
        b = rng.randrange(256)
        data.append(b)
        codes.append((b, width))
        size += len(data) > 1 and len(codes) > 2
        if size == (1 << width) - 1 and width < 12:
            width += 1
    codes.append((257, width))
    assert tiff.lzw_decode(bits(codes)) == bytes(data)


@pytest.mark.parametrize("code", [300, 258, 511])
def test_lzw_code_after_a_clear_must_be_a_byte(code):
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode(bits([(256, 9), (code, 9)]))


@pytest.mark.parametrize("code", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_mutations_never_crash(code, tile):
    rng = random.Random(code)
    pages = [np.arange(900, dtype=np.uint16).reshape(30, 30), np.arange(64, dtype=np.float32).reshape(8, 8)]
    good = tiff.write_pages(pages[:1], code, 2, 8, tile) if code == tiff.LZW else tiff.write_pages(pages[:1] + pages, code, 1, 8, tile)
    for _ in range(700):
        bad = bytearray(good)
        for _ in range(rng.choice([1, 1, 2, 5])):
            bad[rng.randrange(len(bad))] = rng.choice([0, 1, 255, rng.randrange(256)])
        if rng.random() < 0.2:
            del bad[rng.randrange(len(bad)) :]
        for row in tiff.decode_rows(1, bytes(bad)):
            assert row[-1] or len(row[-2]) == row[2] * row[3] * row[4] * row[5] // 8


def test_oversize_pages_are_errors():
    good = bytearray(tiff.write_pages([np.zeros((2, 2), np.uint8)]))
    at = good.index(bytes([0, 1, 4, 0, 1, 0, 0, 0, 2, 0, 0, 0]))
    good[at + 8 : at + 12] = b"\xff\xff\xff\x7f"
    assert tiff.decode_rows(5, bytes(good))[0][-1]


def test_pages_of_every_kind_decode(spark):
    """All compressions, strips and tiles, byte orders and predictors, several pages a file: one row a page."""
    rng, want, rows = np.random.default_rng(2), {}, []
    for code in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for tile in (None, (16, 16)):
            for order in "<>":
                pages = [(rng.random((21, 33, n)) * 250).astype(kind) for n, kind in ((1, "u1"), (3, "u2"))]
                rows.append((len(rows), bytearray(tiff.write_pages(pages, code, 2, 8, tile, order))))
                want |= {(rows[-1][0], k): p for k, p in enumerate(pages)}
    media = spark.createDataFrame(rows, "media_id long, media binary").selectExpr("*", "1 as page", "2 as pixels")
    got = tiff.decode_tiff(media).collect()
    assert len(got) == len(want) and not any(r.error for r in got)
    for r in got:
        page = want[r.media_id, r.page]
        assert (r.height, r.width, r.samples, r.bits) == (*page.shape, 8 * page.dtype.itemsize) and r.pixels == page.tobytes()


def test_long_texts_become_media(spark):
    texts = ["word " * 300_000, "é" * 400_001, None]
    got = {r.doc_id: r for r in tiff.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        page = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        media = tiff.write_pages([page], tiff.DEFLATE, 2, 256)
        import hashlib

        assert (got[d].n_bytes, got[d].payload_bytes, got[d].media_bytes, got[d].media_sha256) == (len(raw), len(payload), len(media), hashlib.sha256(media).hexdigest())
        counts = [int((page // 16 == k).sum()) for k in range(16)]
        assert got[d].feature == f"64x{len(page)};mean={page.mean():.4f};std={page.std():.4f};hist={','.join(map(str, counts))}"
