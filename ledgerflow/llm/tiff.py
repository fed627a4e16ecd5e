"""TIFF columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

The reader takes both byte orders, any chain of directories, strips or tiles, samples of 1, 2, 4, 8, 16, 32 and 64 bits,
chunky or planar, uncompressed, PackBits, LZW and deflate data, and the horizontal and floating-point predictors. Whatever
is wrong with a file ends in a TiffError. The writer stores byte payloads as grey images and is used to make files for
the reader.

LZW codes have widths that depend only on how many have come since the table was cleared, so they are packed and
unpacked by arrays; only the table itself is walked code by code.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format: tags, compressions and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_CODES = {1: "B", 3: "H", 4: "I"}
CLEAR, END, FIRST, WIDEST = 256, 257, 258, 12

#: Payload bytes are a multiple of UNIT; images are IMAGE_WIDTH wide, so a unit is 9 rows. Strips hold STRIP_ROWS rows.
UNIT, IMAGE_WIDTH, STRIP_ROWS = 576, 64, 128
#: The most bytes a page may hold decoded; a damaged header doesn't make the reader ask for more.
MOST_PAGE_BYTES = 1 << 30
_RUNS = re.compile(rb"(.)\1{2,}", re.DOTALL)


class TiffError(ValueError):
    """The file isn't a TIFF that this reader takes."""


def packbits_encode(data: bytes, row: int = 0) -> bytes:
    """Packed bytes; with ``row``, every row of so many bytes is packed for itself, as the format asks."""
    if row and len(data) > row:
        rows = np.frombuffer(data, np.uint8).reshape(-1, row)
        if row <= 128 and not ((rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2])).any():
            return np.column_stack((np.full(len(rows), row - 1, np.uint8), rows)).tobytes()  # no runs: a literal each
        return b"".join(packbits_encode(data[i : i + row]) for i in range(0, len(data), row))
    out, at = bytearray(), 0

    def literal(upto: int) -> None:
        nonlocal at
        while at < upto:
            n = min(128, upto - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for run in _RUNS.finditer(data):
        literal(run.start())
        left = run.end() - run.start()
        while left >= 3:
            n = min(128, left)
            out.append(257 - n)
            out.append(data[at])
            at += n
            left -= n
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, end = bytearray(), 0, len(data)
    while len(out) < size and i < end:
        n = data[i]
        i += 1
        if n < 128:
            if i + n + 1 > end:
                raise TiffError("PackBits data ends early")
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            if i >= end:
                raise TiffError("PackBits data ends early")
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


@lru_cache(maxsize=1)
def _schedule() -> tuple[np.ndarray, np.ndarray]:
    """Width of the n-th code after a clear, and the bits before it, for as many codes as a table can take.

    The n-th code meets a table of FIRST + n - 1 entries (the first one adds none); widths grow one code early.
    """
    entries = FIRST - 1 + np.maximum(np.arange((1 << WIDEST) - FIRST + 2), 1)
    widths = np.clip(np.floor(np.log2(entries + 1)).astype(np.int64) + 1, 9, WIDEST)
    return widths, np.concatenate(([0], np.cumsum(widths)[:-1]))


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early; CLEAR begins, and again when the table is full; END ends."""
    widths, _ = _schedule()
    blocks: list[list[int]] = []
    codes: list[int] = []
    put = codes.append
    table: dict[int, int] = {}
    following, prefix = FIRST, -1
    for byte in data:
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
        elif prefix < 0:
            prefix = byte
        else:
            put(prefix)
            table[key] = following
            following += 1
            prefix = byte
            if following == 4095:
                put(CLEAR)
                blocks.append(codes)
                codes, table, following = [], {}, FIRST
                put = codes.append
    if prefix >= 0:
        put(prefix)
    put(END)
    blocks.append(codes)
    every = np.array([CLEAR] + [c for block in blocks for c in block], np.uint16)
    wide = np.concatenate([np.array([9])] + [widths[: len(block)] for block in blocks])
    places = np.arange(15, -1, -1, dtype=np.uint16)
    bits = (every[:, None] >> places & 1).astype(np.uint8)
    return np.packbits(bits[places[None, :] < wide[:, None]]).tobytes()


def _codes(raw: np.ndarray, at: int, end: int) -> np.ndarray:
    """Codes from bit ``at`` on, as after a clear; so many as the data and a table can hold."""
    widths, before = _schedule()
    starts = before + at
    n = int(np.searchsorted(starts + widths, end, side="right"))
    starts, w = starts[:n], widths[:n]
    byte = starts >> 3
    word = raw[byte].astype(np.int64) << 16 | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2]
    return word >> 24 - (starts & 7) - w & (1 << w) - 1


_BYTES = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """The first ``size`` bytes, or fewer if the data ends before."""
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    widths, before = _schedule()
    out: list[bytes] = []
    have, at, end = 0, 0, 8 * len(data)
    while have < size:
        codes = _codes(raw, at, end)
        if not len(codes):
            raise TiffError("LZW data ends early")
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else len(codes)
        n, table, last = 0, _BYTES.copy(), b""
        add = table.append
        for code in codes[:stop].tolist():
            if last:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise TiffError("LZW code out of range")
                add(last + entry[:1])
            elif code < CLEAR:
                entry = _BYTES[code]
            else:
                raise TiffError("LZW code out of order")
            out.append(entry)
            n += len(entry)
            last = entry
        have += n
        if stop == len(codes):
            if have < size:
                raise TiffError("LZW data ends early, or without a clear in time")
        elif codes[stop] == END:
            break
        else:
            at += int(before[stop] + widths[stop])
    return b"".join(out)[:size]


def _packed(data: bytes, how: int, row: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return packbits_encode(data, row)
    if how == LZW:
        return lzw_encode(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise TiffError(f"compression {how} is not known")


def _unpacked(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate data: {e}") from e
    raise TiffError(f"compression {how} is not known")


def write_tiff(pages: list[dict]) -> bytes:
    """Pages: pixels (2-D uint8 array), compression, predictor (1 or 2), rows_per_strip or tile (height, width)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        pixels, how, predictor = page["pixels"], page.get("compression", NONE), page.get("predictor", 1)
        height, width = pixels.shape
        if "tile" in page:
            th, tw = page["tile"]
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            padded[:height, :width] = pixels
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            step = page.get("rows_per_strip", height)
            blocks = [pixels[y : y + step] for y in range(0, height, step)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            data = _packed(block.tobytes(), how, block.shape[1])
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) & 1)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [how], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        if "tile" in page:
            fields |= {TILE_WIDTH: [tw], TILE_HEIGHT: [th], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        else:
            fields |= {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [step], STRIP_COUNTS: counts}
        entries = b""
        for tag, values in sorted(fields.items()):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in FIELD_CODES:
                continue
            code = f"{order}{count}{FIELD_CODES[kind]}"
            where = at + 2 + 12 * i + 8
            if struct.calcsize(code) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + struct.calcsize(code) > len(data):
                raise TiffError(f"field {tag} lies outside the file")
            fields[tag] = struct.unpack_from(code, data, where)
        return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError("a directory lies outside the file") from e


def read_tiff(data: bytes) -> Iterator[dict]:
    """Pages in the order of the directories; pixels is (height, width, samples)."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        fields, at = _directory(data, order, at)
        try:
            page = _page(data, order, fields)
        except TiffError:
            raise
        except (ArithmeticError, LookupError, TypeError, ValueError) as e:  # sizes and offsets that fit nothing
            raise TiffError(f"a damaged directory: {e}") from e
        yield page


def _sample_type(bits: int, form: int, order: str) -> np.dtype:
    """How samples lie in a strip; those of fewer bits than a byte are unpacked to bytes."""
    if bits in (1, 2, 4, 8):
        return np.dtype("i1" if form == 2 and bits == 8 else "u1")
    if bits in (16, 32, 64) and form in (1, 2, 3, 4):
        return np.dtype(f"{order}{'uuif'[form] if form < 4 else 'u'}{bits // 8}")
    raise TiffError(f"{bits} bits per sample are not read")


def _unpack_bits(raw: bytes, rows: int, across: int, bits: int) -> np.ndarray:
    """Rows of samples of 1, 2 or 4 bits, each row padded to a byte."""
    row = -(-across * bits // 8)
    single = np.unpackbits(np.frombuffer(raw, np.uint8, rows * row).reshape(rows, row), axis=1)[:, : across * bits]
    return np.packbits(single.reshape(rows, across, bits), axis=2, bitorder="big")[:, :, 0] >> 8 - bits


def _undone(raw: bytes, rows: int, across: int, deep: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """A strip's or tile's samples (rows, across, deep) without its predictor."""
    if predictor == 3:  # bytes of a row by significance, each the difference from the one ``deep`` before
        if kind.kind != "f":
            raise TiffError("the floating-point predictor is for floats")
        planes = np.frombuffer(raw, np.uint8, rows * across * deep * kind.itemsize).reshape(rows, -1, deep)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, across * deep)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, across, deep)
    block = np.frombuffer(raw, kind, rows * across * deep).reshape(rows, across, deep)
    if predictor == 2:
        if kind.kind == "f":
            raise TiffError("the horizontal predictor is for whole numbers")
        block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    return block


def _page(data: bytes, order: str, fields: dict[int, tuple]) -> dict:
    def one(tag: int, default: int | None = None) -> int:
        values = fields.get(tag)
        if values:
            return values[0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    how, predictor, planar, form = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    if len(set(fields.get(BITS) or (bits,))) > 1:
        raise TiffError("samples of different bits are not read")
    if one(FILL_ORDER, 1) != 1:
        raise TiffError("low bits first are not read")
    kind = _sample_type(bits, form, order)
    if predictor not in (1, 2, 3) or predictor > 1 and bits < 8:
        raise TiffError(f"predictor {predictor} is not known for {bits} bits")
    if not 0 < width * height * samples * kind.itemsize <= MOST_PAGE_BYTES:
        raise TiffError("the page has no size, or too much")
    tiled = TILE_OFFSETS in fields
    if tiled:
        bw, bh, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields.get(TILE_COUNTS, ())
    else:
        bw, bh, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_COUNTS, ())
    if not bw or not bh or bw * bh * samples * kind.itemsize > MOST_PAGE_BYTES:
        raise TiffError("strips or tiles have no size, or too much")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise TiffError("strips or tiles are missing")
    pixels = np.empty((height, width, samples), kind.newbyteorder("="))
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, height - y)
        size = rows * (-(-bw * deep * bits // 8))
        raw = _unpacked(data[offset : offset + count], how, size)
        if len(raw) < size:
            raise TiffError("a strip or tile ends early")
        if bits < 8:
            block = _unpack_bits(raw, rows, bw * deep, bits).reshape(rows, bw, deep)
        else:
            block = _undone(raw, rows, bw, deep, kind, predictor)
        h, w = min(rows, height - y), min(bw, width - x)
        part = block[:h, :w]
        if planar == 2:
            pixels[y : y + h, x : x + w, plane] = part[:, :, 0]
        else:
            pixels[y : y + h, x : x + w] = part
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled, "pixels": pixels}


PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
_PAGE_TYPES = [*[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
_NAMES = lambda schema: [x.split()[0] for x in schema.split(", ")]
#: Bytes gathered before a batch is handed on.
_HAND_ON = 4 << 20


def decode_pages(files: DataFrame, id_col: str, media_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of the TIFF files in a binary column: the file's id, the columns to ``keep``, and PAGES.

    pixels holds the samples row by row (wider ones in the machine's order). A file that is null or empty has no
    pages; where reading fails, the pages before it stay and one row names the error. Equal files give equal pages; the
    pages of a file follow each other. ``keep`` may not name a column of PAGES.
    """
    own = files.select(id_col, *keep, media_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", " + PAGES

    def decode(batches):
        for batch in batches:
            at, rows, held = [], [], 0
            for i, media in enumerate(batch.column(batch.num_columns - 1)):
                data, number = media.as_py(), 0
                try:
                    for number, p in enumerate(read_tiff(data) if data else ()):
                        raw = p["pixels"].tobytes()
                        rows.append((number, p["width"], p["height"], p["samples"], p["bits"], p["compression"], p["predictor"], p["tiled"], raw, None))
                        at.append(i)
                        held += len(raw)
                        number += 1
                except TiffError as e:
                    rows.append((number, *[None] * 8, str(e)))
                    at.append(i)
                if held > _HAND_ON:
                    yield _table(batch, at, rows)
                    at, rows, held = [], [], 0
            yield _table(batch, at, rows)

    def _table(batch, at, rows):
        first = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int32()))
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PAGE_TYPES)
        return pa.RecordBatch.from_arrays([*first.columns, *(pa.array(c, t) for c, t in zip(columns, _PAGE_TYPES, strict=True))], names=[*first.schema.names, *_NAMES(PAGES)])

    return own.mapInArrow(decode, schema)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of the text with bytes 255 up to a positive multiple of UNIT; and their number before."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def text_to_tiff(payload: bytes) -> bytes:
    """Three pages of a third of the rows each: LZW in strips, PackBits in strips, deflate in tiles; two with a predictor."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, IMAGE_WIDTH)
    third = len(rows) // 3
    return write_tiff(
        [
            {"pixels": rows[:third], "compression": LZW, "predictor": 2, "rows_per_strip": min(third, STRIP_ROWS)},
            {"pixels": rows[third : 2 * third], "compression": PACKBITS, "rows_per_strip": min(third, STRIP_ROWS)},
            {"pixels": rows[2 * third :], "compression": DEFLATE, "predictor": 2, "tile": (256 if third > 64 else 16, 64)},
        ]
    )


STORED = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary"
_STORED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, media): every whole text as a TIFF file. A null text counts as empty."""

    def store(batches):
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                media = text_to_tiff(payload)
                rows.append((key.as_py(), n, len(media), hashlib.sha256(media).hexdigest(), media))
                held += len(media)
                if held > _HAND_ON:
                    yield _filled(rows, _STORED_TYPES, STORED)
                    rows, held = [], 0
            yield _filled(rows, _STORED_TYPES, STORED)

    return docs.select(id_col, text_col).mapInArrow(store, STORED)


def _filled(rows: list[tuple], types: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES(schema))


def _feature(sizes: list[tuple[int, int]], samples: np.ndarray) -> str:
    """Pages' sizes, and the share of samples in each eighth of the value range, in thousandths."""
    shares = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    return "+".join(f"{w}x{h}" for w, h in sizes) + ":" + ",".join(map(str, shares))


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a TIFF, decode the file's pages and describe what was read; one row per row of ``docs``.

    A null text counts as empty; equal texts give equal values; ids may be null; an empty table gives none. A stored file
    that can't be read back is an error.
    """
    pages = decode_pages(stored_texts(docs, id_col, text_col), "doc_id", "media", ("n_bytes", "media_bytes", "media_sha256"))

    def digest(batches):
        """The pages of a file follow each other: page 0 begins the next one."""
        own, parts, sizes = None, [], []

        def described():
            back = b"".join(parts)
            key, n, media_bytes, media_sha256 = own
            feature = _feature(sizes, np.frombuffer(back, np.uint8))
            return key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), media_bytes, media_sha256, feature, len(parts)

        for batch in batches:
            rows = []
            for *first, page, width, height, pixels, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "pixels", "error")), strict=True):
                if error:
                    raise TiffError(error)
                if page == 0:
                    if own is not None:
                        rows.append(described())
                    own, parts, sizes = first, [], []
                parts.append(pixels)
                sizes.append((width, height))
            yield _filled(rows, _DIGEST_TYPES, DIGESTS)
        if own is not None:
            yield _filled([described()], _DIGEST_TYPES, DIGESTS)

    return pages.mapInArrow(digest, DIGESTS)


def op1(spark, sf_dir: str) -> DataFrame:
    return text_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
