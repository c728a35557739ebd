"""TIFF media columns: image directories, compressed strips and tiles, predictors, one row a page.

The reader walks the chain of image directories in either byte order, decodes PackBits, LZW or
deflate strips and tiles, undoes the horizontal and floating-point predictors and gives each page as
an array. The writer makes strips or tiles with the same compressions.

Defined results: a null or empty media value has no pages; a chain that comes back to a directory it
has visited stops there; a truncated, broken or foreign file, and one whose pages claim more than
``MAX_PIXEL_BYTES`` or more than their data can hold, raises ``TiffError`` in ``read_pages`` and gives
one row with ``error`` set in ``decode_tiff``, whatever pages came before. Texts are stored as rows of 64 bytes; a null text is
empty and stored as one row of zero bytes.
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

from .storage import tidied
from .text import string_column

# Fixed values of the TIFF 6.0 format: tags, field types and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: A page of more decoded bytes is an error; it would not fit a task.
MAX_PIXEL_BYTES = 1 << 30


class TiffError(ValueError):
    """The bytes aren't a TIFF file this reader can decode."""


# --- compressions -----------------------------------------------------------------------------

def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + run
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        j = min(j, i + 128)
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes most significant bit first, 9 to 12 bits, widening one code early; 256 clears, 257 ends."""
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out = list(start), 9, []
    prev, acc, bits = None, 0, 0
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, prev = list(start), 9, None
            continue
        if code == 257:
            break
        if prev is None:
            if code > 257:
                raise TiffError("LZW code out of range")
            entry = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        prev = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, size = 9, 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    put(256)
    at, n = 0, len(data)
    while at < n:
        end = at + 2
        code = data[at]
        while end <= n and (longer := table.get(data[at:end])) is not None:
            code = longer
            end += 1
        put(code)
        if end <= n:
            table[data[at:end]] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        elif size >= 4094:
            put(256)
            table, width, size = {}, 9, 258
        at = end - 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 0xFF)
    return bytes(out)


def decompress(data: bytes, code: int, need: int) -> bytes:
    """The first ``need`` bytes at least; a stream that goes on far beyond them is not followed."""
    if code == NONE:
        return data
    if code == PACKBITS:
        return packbits_decode(data)
    if code == LZW:
        return lzw_decode(data)
    if code in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, need)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    raise TiffError(f"compression {code} is not supported")


def compress(data: bytes, code: int, level: int = 1) -> bytes:
    coders = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, level)}
    return coders[code](data)


# --- predictors -------------------------------------------------------------------------------

def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """``block``: rows x columns x samples as stored. 2: differences along a row; 3: byte planes of floats."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, cols, samples = block.shape
        width = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, cols * width, samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, width, cols * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f">f{width}").reshape(rows, cols, samples).astype(f"{order}f{width}")
    raise TiffError(f"predictor {predictor} is not supported")


def apply_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    if predictor == 2:
        out = block.copy()
        out[:, 1:] -= block[:, :-1]
        return out
    rows, cols, samples = block.shape
    width = block.dtype.itemsize
    raw = np.ascontiguousarray(block.astype(f">f{width}")).view(np.uint8).reshape(rows, cols * samples, width).transpose(0, 2, 1).reshape(rows, cols * width, samples)
    out = raw.copy()
    out[:, 1:] -= raw[:, :-1]
    return out


# --- files ------------------------------------------------------------------------------------

def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and the fields of each image directory in chain order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(order + "H", data, at)[0]
            fields = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in _TYPES:
                    continue
                if count > len(data):
                    raise TiffError("a field larger than the file")
                fmt = f"{order}{count}{_TYPES[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(fmt) > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                fields[tag] = struct.unpack_from(fmt, data, where)
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise TiffError("truncated directory") from e
        yield order, fields


def page_pixels(data: bytes, order: str, f: dict[int, tuple]) -> np.ndarray:
    """A page as rows x columns x samples (chunky layout, samples of 8, 16, 32 or 64 bits)."""

    def one(tag: int, default: int | None = None) -> int:
        value = f.get(tag) or (default,)
        if value[0] is None or not isinstance(value[0], int) or value[0] < 0:
            raise TiffError(f"no usable field {tag}")
        return value[0]

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16, 32, 64) or one(PLANAR, 1) != 1:
        raise TiffError("only whole-byte chunky samples are supported")
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1), "u")
    if kind == "f" and bits == 8 or kind != "f" and one(PREDICTOR, 1) == 3:
        raise TiffError("sample format and size do not go together")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    tiled = TILE_WIDTH in f
    cols, rows = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    where, sizes = (f.get(TILE_OFFSETS), f.get(TILE_COUNTS)) if tiled else (f.get(STRIP_OFFSETS), f.get(STRIP_COUNTS))
    if not (width and height and samples and cols and rows and where and sizes):
        raise TiffError("a page without pixels, strips or tiles")
    across, down = -(-width // cols), -(-height // rows)
    if max(width * height, across * cols * rows) * samples * dtype.itemsize > MAX_PIXEL_BYTES:
        raise TiffError("a page too large to decode")
    if min(len(where), len(sizes)) < across * down:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, samples), dtype=dtype)
    for k, (at, size) in enumerate(zip(where[: across * down], sizes)):
        top, left = k // across * rows, k % across * cols
        full = rows if tiled else min(rows, height - top)
        if at < 0 or size < 0 or at + size > len(data):
            raise TiffError("a strip or tile outside the file")
        need = full * cols * samples * dtype.itemsize
        raw = decompress(data[at : at + size], one(COMPRESSION, NONE), need)
        if len(raw) < need:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw[:need], dtype=dtype).reshape(full, cols, samples)
        block = undo_predictor(block, one(PREDICTOR, 1), order)
        out[top : top + full, left : left + cols] = block[: height - top, : width - left]
    return out


def read_pages(data: bytes | None) -> list[np.ndarray]:
    return [page_pixels(data, *d) for d in directories(data)] if data else []


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of pages (rows x columns [x samples]), in strips of ``rows`` or tiles of ``(height, width)``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        page = page.astype(page.dtype.newbyteorder(order))
        th, tw = tile or (min(rows, height), width)
        where, sizes = [], []
        for top in range(0, height, th):
            for left in range(0, width, tw):
                block = page[top : top + th, left : left + tw]
                if tile and block.shape[:2] != tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                packed = compress(apply_predictor(block, predictor).tobytes(), compression)
                where.append(len(out))
                sizes.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        fields = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8 * page.dtype.itemsize] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [samples]), PLANAR: ("H", [1]), PREDICTOR: ("H", [predictor]), SAMPLE_FORMAT: ("H", [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]] * samples)}
        fields |= {TILE_WIDTH: ("I", [tw]), TILE_HEIGHT: ("I", [th]), TILE_OFFSETS: ("I", where), TILE_COUNTS: ("I", sizes)} if tile else {STRIP_OFFSETS: ("I", where), ROWS_PER_STRIP: ("I", [th]), STRIP_COUNTS: ("I", sizes)}
        ifd = len(out)
        extra, body = ifd + 2 + 12 * len(fields) + 4, b""
        entries = bytearray(struct.pack(order + "H", len(fields)))
        for tag, (code, values) in sorted(fields.items()):
            value = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(value) > 4:
                body += b"\0" * (len(body) % 2)
                entries += struct.pack(order + "HHII", tag, 3 if code == "H" else 4, len(values), extra + len(body))
                body += value
            else:
                entries += struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + value.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, ifd)
        link = ifd + len(entries)
        out += bytes(entries) + struct.pack(order + "I", 0) + body
    return bytes(out)


# --- operators --------------------------------------------------------------------------------

PAGES = "media_id long, page int, width int, height int, samples int, bits int, pixels binary, error string"
TEXT_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decode_rows(owner, data: bytes | None) -> list[tuple]:
    """The rows of ``PAGES`` of one file."""
    rows = []
    try:
        for k, page in enumerate(read_pages(data)):
            rows.append((owner, k, page.shape[1], page.shape[0], page.shape[2], 8 * page.dtype.itemsize, page.astype(page.dtype.newbyteorder("=")).tobytes(), None))
    except TiffError as e:
        rows = [(owner, None, None, None, None, None, None, str(e))]
    return rows


def decode_tiff(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """One row a page: size, sample layout and decoded samples (row-major, native order)."""

    @tidied
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = decode_rows(owner, data)
                if rows:
                    types = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
                    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in PAGES.split(", ")])

    return media.select(F.col(key).cast("long").alias("media_id"), F.col(column).cast("binary").alias("media")).mapInArrow(decode, PAGES)


def features(page: np.ndarray) -> str:
    """Size, mean, spread and a 16-step histogram of a page's 8-bit samples."""
    flat = page.ravel()
    counts = np.bincount(flat, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(flat)
    spread = (max(0.0, float(counts @ (values * values)) / len(flat) - mean * mean)) ** 0.5
    steps = ",".join(map(str, counts.reshape(16, 16).sum(axis=1)))
    return f"{page.shape[1]}x{page.shape[0]};mean={mean:.4f};std={spread:.4f};hist={steps}"


def _payload(text: pa.StringScalar) -> bytes:
    """A text's bytes and zeros up to a positive multiple of 64."""
    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
    return raw + b"\0" * (64 if not raw else -len(raw) % 64)


def text_files(docs: DataFrame) -> DataFrame:
    """``media_id, media``: every text as a file of two pages, its bytes and the same as pairs of bytes.

    Compression, strips or tiles, byte order and predictor go by the id, so all kinds of files occur.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, media = batch.column(0).to_pylist(), []
            for owner, text in zip(owners, string_column(batch, "text")):
                data, k = np.frombuffer(_payload(text), np.uint8), owner or 0
                pages = [data.reshape(-1, 64), data.view("<u2").reshape(-1, 32)]
                code = (NONE, LZW, DEFLATE, PACKBITS)[k % 4]
                media.append(write_pages(pages, code, 1 + k // 16 % 2, 64, (16, 16) if k // 4 % 2 else None, "<>"[k // 8 % 2]))
            yield pa.record_batch([pa.array(owners, pa.int64()), pa.array(media, pa.binary())], names=["media_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("media_id"), "text").mapInArrow(run, "media_id long, media binary")


def text_pages(docs: DataFrame) -> DataFrame:
    """The pages that ``text_files`` hold, read back: ``media_id, page, width, height, samples, bits, pixels_sha256, error``."""
    return decode_tiff(text_files(docs)).select("media_id", "page", "width", "height", "samples", "bits", F.sha2("pixels", 256).alias("pixels_sha256"), "error")


PAGES_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as raw from documents),
p as (select doc_id, raw || encode(repeat(chr(0), case when octet_length(raw) = 0 then 64 else (64 - octet_length(raw) % 64) % 64 end)) as b from d)
select doc_id as media_id, page, (64 // (page + 1))::int as width, (octet_length(b) // 64)::int as height, 1 as samples, 8 * (page + 1) as bits,
       sha256(b) as pixels_sha256, cast(null as varchar) as error
from p, (values (0), (1)) t(page)
"""


def text_media(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2, rows: int = 256) -> DataFrame:
    """Store every text as a TIFF of 64 columns, read the file back and describe what it holds."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TEXT_MEDIA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            texts = string_column(batch, "text")
            out: list[tuple] = []
            for owner, text in zip(batch.column(0).to_pylist(), texts):
                raw, payload = text.as_buffer().to_pybytes() if text.is_valid else b"", _payload(text)
                media = write_pages([np.frombuffer(payload, np.uint8).reshape(-1, 64)], compression, predictor, rows)
                page = read_pages(media)[0]
                back = page.tobytes()
                out.append((owner, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(page)))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TEXT_MEDIA)
