"""TIFF pages: a reader of image directories, and a writer for round trips.

The reader walks the chain of image directories (little or big endian),
gathers strips or tiles, decodes none, PackBits, LZW or deflate, undoes the
horizontal predictor, and gives one page for each directory.  Samples are
unsigned with 8 bits, interleaved; what else it meets (other samples, missing
strips, sizes that do not fit the file, more than ``MOST_BYTES``) is reported as
an error of the page, not raised, so one bad file loses no other.

A chain that loops ends where it would repeat.  Null or empty media give no
page.  Equal bytes give equal pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fragmill.llm import bytesops as B

# Fixed values of the format: tags, compression schemes, sizes of field types.
WIDTH, HEIGHT, BITS, SCHEME, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Bytes of samples that a page may claim; larger ones are errors.
MOST_BYTES = 1 << 30
SCHEMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}


@dataclass(frozen=True)
class Page:
    number: int
    width: int
    height: int
    samples: int
    scheme: str
    predictor: int
    tiled: bool
    chunks: int
    pixels: bytes
    error: str | None = None


def unpack_bits(data: bytes, size: int) -> bytes:
    """At most a little over ``size`` bytes."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + run
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes from the high bit on, 9 to 12 bits wide, widening one code early; 256 clears, 257 ends.  Stops past ``size`` bytes."""
    out, table = bytearray(), [bytes((k,)) for k in range(256)] + [b"", b""]
    bits = held = at = 0
    width, last = 9, b""
    while len(out) < size:
        while held < width:
            if at == len(data):
                return bytes(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if not last:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code beyond the table")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 0xFF)
        bits &= (1 << held) - 1

    table, width, word = {bytes((k,)): k for k in range(256)}, 9, b""
    put(256, 9)
    free = 258
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = free
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free == 4094:
            put(256, 12)
            table, free, width = {bytes((k,)): k for k in range(256)}, 258, 9
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257, width)
    if held:
        out.append(bits << 8 - held & 0xFF)
    return bytes(out)


def decoded(scheme: int, data: bytes, size: int) -> bytes:
    """A strip or tile of ``size`` bytes; what a bad one holds beyond them is not unpacked."""
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return unpack_lzw(data, size)
    raise ValueError(f"compression {scheme}")


def encoded(scheme: int, data: bytes) -> bytes:
    if scheme == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw}[scheme](data)


def undo_predictor(block: np.ndarray) -> np.ndarray:
    """Rows x columns x samples of differences to the left neighbour, modulo 256."""
    return np.cumsum(block, axis=1, dtype=np.uint8)


def predicted(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def _fields(media: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    """Whole-number fields of the directory at this offset, and the offset of the next."""
    (count,) = struct.unpack_from(order + "H", media, at)
    fields = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
        where = at + 10 + 12 * k
        if TYPE_SIZE.get(kind, 0) * n > 4:
            (where,) = struct.unpack_from(order + "I", media, where)
        if kind in (1, 3, 4):
            fields[tag] = struct.unpack_from(f"{order}{n}{' BxHI'[kind]}", media, where)
    (following,) = struct.unpack_from(order + "I", media, at + 2 + 12 * count)
    return fields, following


def _page(media: bytes, number: int, fields: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples, scheme, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(SCHEME, NONE), one(PREDICTOR, 1)
    if set(fields.get(BITS, (8,))) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2) or not width or not height:
        raise ValueError("only 8-bit interleaved samples, with no or the horizontal predictor")
    tiled = TILE_AT in fields
    across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    starts, sizes = (fields[TILE_AT], fields[TILE_SIZE]) if tiled else (fields[STRIP_AT], fields[STRIP_SIZE])
    if len(starts) != len(sizes) or len(starts) != -(-height // down) * -(-width // across):
        raise ValueError(f"{len(starts)} strips or tiles of {width} x {height} samples by {across} x {down}")
    if (most := -(-height // down) * down * -(-width // across) * across * samples) > MOST_BYTES:
        raise ValueError(f"a page of {most} bytes")
    canvas = np.zeros((-(-height // down) * down, -(-width // across) * across, samples), np.uint8)
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        y, x = divmod(k, -(-width // across))
        rows = down if tiled else min(down, height - y * down)
        if at + size > len(media):
            raise ValueError("a strip or tile beyond the end of the file")
        block = np.frombuffer(decoded(scheme, media[at : at + size], rows * across * samples), np.uint8, rows * across * samples).reshape(rows, across, samples)
        canvas[y * down : y * down + rows, x * across : x * across + across] = undo_predictor(block) if predictor == 2 else block
    return Page(number, width, height, samples, SCHEMES.get(scheme, str(scheme)), predictor, tiled, len(starts), canvas[:height, :width].tobytes())


def pages(media: bytes) -> Iterator[Page]:
    """One page for each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        yield Page(0, 0, 0, 0, "", 0, False, 0, b"", "not a TIFF")
        return
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        number = len(seen) - 1
        try:
            fields, at = _fields(media, order, at)
        except struct.error as e:
            yield Page(number, 0, 0, 0, "", 0, False, 0, b"", str(e))
            return
        try:
            yield _page(media, number, fields)
        except (ValueError, KeyError, IndexError, ZeroDivisionError, MemoryError, struct.error, zlib.error) as e:
            yield Page(number, 0, 0, 0, "", 0, False, 0, b"", str(e) or type(e).__name__)


def written(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, strip_rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF with one directory for each image (rows x columns x samples, 8 bits)."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        down, across = tile or (min(strip_rows, height), width)
        blocks = []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = image[y : y + down, x : x + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                blocks.append(encoded(scheme, (predicted(block) if predictor == 2 else block).tobytes()))
        starts = []
        for x in blocks:
            starts.append(len(out))
            out += x
        out += bytes(len(out) % 2)
        size = [len(x) for x in blocks]
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), SCHEME: (3, [scheme]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [across]), TILE_HEIGHT: (4, [down]), TILE_AT: (4, starts), TILE_SIZE: (4, size)} if tile else {STRIP_AT: (4, starts), STRIP_ROWS: (4, [down]), STRIP_SIZE: (4, size)}
        struct.pack_into(order + "I", out, link, len(out))
        rest, entries = len(out) + 6 + 12 * len(fields), b""
        more = b""
        for tag, (kind, values) in sorted(fields.items()):
            body = struct.pack(f"{order}{len(values)}{'HI'[kind == 4]}", *values)
            entries += struct.pack(order + "HHI", tag, kind, len(values))
            if len(body) > 4:
                entries += struct.pack(order + "I", rest + len(more))
                more += body
            else:
                entries += body.ljust(4, b"\0")
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + more
        out += bytes(len(out) % 2)
    return bytes(out)


_PAGES = "page int, width int, height int, samples int, scheme string, predictor int, tiled boolean, chunks int, pixels binary, error string"


def read_pages(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each page of ``files(key, media)``: the key, then page, width, height, samples, scheme, predictor, tiled, chunks, pixels, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(key), batch.column(media), strict=True):
                if data.as_py():
                    found = list(pages(data.as_py()))
                    columns = [[getattr(p, c) for p in found] for c in ("number", "width", "height", "samples", "scheme", "predictor", "tiled", "chunks", "pixels", "error")]
                    types = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), k.type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "page", "width", "height", "samples", "scheme", "predictor", "tiled", "chunks", "pixels", "error"])

    return files.select(key, media).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {_PAGES}")


#: Width of a page that holds text, rows of a strip, bytes of a page, and the sizes up to which a text is stored by LZW and by PackBits.
ROW, STRIP, PAGE = 64, 512, 1 << 20
LZW_UP_TO, PACKBITS_UP_TO = 512, 1024


def stored(text: bytes) -> bytes:
    """A text, padded with 0 to whole rows, as grey pages of up to ``PAGE`` bytes.

    Small texts lie in LZW tiles, middling ones in PackBits strips, others in
    deflated strips with the horizontal predictor.
    """
    payload = text + bytes(-len(text) % ROW or (0 if text else ROW))
    images = [np.frombuffer(payload[k : k + PAGE], np.uint8).reshape(-1, ROW, 1) for k in range(0, len(payload), PAGE)]
    if len(payload) <= LZW_UP_TO:
        return written(images, LZW, tile=(16, 32))
    if len(payload) <= PACKBITS_UP_TO:
        return written(images, PACKBITS, strip_rows=4)
    return written(images, DEFLATE, 2, STRIP)


def digest(media: bytes) -> tuple[bytes, str]:
    """The samples of all pages, and a feature: pages, shape, coding and a 4-step tone histogram."""
    found = list(pages(media))
    if bad := [p.error for p in found if p.error]:
        raise ValueError(bad[0])
    payload = b"".join(p.pixels for p in found)
    tones = np.bincount(np.frombuffer(payload, np.uint8) >> 6, minlength=4)
    p = found[0]
    return payload, f"{len(found)}:{p.width}x{p.height}x{p.samples}:{p.scheme}:{p.chunks}:" + "-".join(map(str, tones.tolist()))


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_bytes(batch.column("text"))
        rows = []
        for k in range(len(offsets) - 1):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            media = stored(text)
            payload, feature = digest(media)
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op2(docs: DataFrame) -> DataFrame:
    """Every text through a stored page and back; only digests leave the task that made the page."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(_round_trip, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")
