"""TIFF: a writer and a reader for images of 8- or 16-bit samples, after the public TIFF 6.0 description.

The reader walks the image directories in either byte order, undoes PackBits, LZW or deflate of each strip or tile,
undoes horizontal differencing, and puts the parts in place. The writer makes what the reader reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, PER_PIXEL, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_BYTES = 322, 323, 324, 325
KINDS = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
CLEAR, STOP = 256, 257
#: The most samples of a page; larger ones count as damaged, so that a few bytes can't ask for all memory.
MOST = 1 << 28


class Damaged(ValueError):
    """The bytes aren't a TIFF that this reader knows."""


@dataclass
class Page:
    page: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    samples: bytes


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 1
            i += 1
    return bytes(out[:most])


def pack_bits(data: bytes) -> bytes:
    out, i, plain = bytearray(), 0, 0

    def literal(to: int) -> None:
        for a in range(plain, to, 128):
            b = min(a + 128, to)
            out.append(b - a - 1)
            out.extend(data[a:b])

    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            literal(i)
            out.append(257 - (j - i))
            out.append(data[i])
            plain = j
        i = j
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    entries = [bytes([i]) for i in range(256)] + [b"", b""]
    out = bytearray()
    hold = held = at = 0
    width, last = 9, None
    while len(out) < most:
        while held < width:
            if at >= len(data):
                return bytes(out[:most])
            hold, held, at = (hold << 8) | data[at], held + 8, at + 1
        held -= width
        code, hold = hold >> held, hold & ((1 << held) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            del entries[258:]
            width, last = 9, None
            continue
        if last is None:
            if code >= len(entries):
                raise Damaged("LZW code before its entry")
            now = entries[code]
        else:
            if code < len(entries):
                now = entries[code]
            elif code == len(entries):
                now = last + last[:1]
            else:
                raise Damaged("LZW code before its entry")
            entries.append(last + now[:1])
        out += now
        last = now
        n = len(entries) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out[:most])


def pack_lzw(data: bytes) -> bytes:
    out, hold, held = bytearray(), 0, 0
    known: dict[bytes, int] = {}
    size, width = 258, 9

    def put(code: int) -> None:
        nonlocal hold, held
        hold, held = (hold << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(hold >> held)
            hold &= (1 << held) - 1

    put(CLEAR)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if len(longer) == 1 or longer in known:
            run = longer
            continue
        put(known[run] if len(run) > 1 else run[0])
        known[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(CLEAR)
            known.clear()
            size, width = 258, 9
        run = data[i : i + 1]
    if run:
        put(known[run] if len(run) > 1 else run[0])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(STOP)
    if held:
        out.append(hold << (8 - held) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise Damaged(str(e)) from e


UNPACK = {NONE: lambda d, n: d[:n], LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: pack_bits}


def pages(data: bytes) -> Iterator[Page]:
    """The images of a file in their order. Raises Damaged at the first one that can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise Damaged("no TIFF header")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise Damaged("image directories run in a circle or past the end")
        seen.add(at)
        try:
            tags, at = _directory(data, order, at)
            page = _page(data, order, tags, number)
        except (struct.error, KeyError, IndexError) as e:
            raise Damaged(f"image directory {number}: {e!r}") from e
        yield page
        number += 1


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    n = struct.unpack_from(order + "H", data, at)[0]
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in KINDS:
            continue
        size, letter = KINDS[kind]
        if count * size > len(data):
            raise Damaged("more values than bytes")
        where = at + 2 + 12 * i + 8
        if count * size > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, tags: dict[int, list[int]], number: int) -> Page:
    one = lambda tag, least=None: tags[tag][0] if tag in tags or least is None else least
    width, height, channels, bits = one(WIDTH), one(HEIGHT), one(PER_PIXEL, 1), one(BITS, 1)
    squeeze, differ = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or squeeze not in UNPACK or differ not in (1, 2) or one(PLANAR, 1) != 1:
        raise Damaged(f"unknown form: {bits} bits, compression {squeeze}, predictor {differ}")
    if width * height * channels > MOST:
        raise Damaged("a page of too many samples")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_AT in tags
    part_w = one(TILE_W) if tiled else width
    part_h = one(TILE_H) if tiled else min(one(STRIP_ROWS, height), height)
    if part_w < 1 or part_h < 1:
        raise Damaged("an empty part")
    image = np.zeros((height, width, channels), dtype=kind.newbyteorder("="))
    across = -(-width // part_w)
    for i, (at, n) in enumerate(zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        y, x = i // across * part_h, i % across * part_w
        if y >= height:
            break
        rows = part_h if tiled else min(part_h, height - y)
        if at + n > len(data):
            raise Damaged("a part runs past the end")
        raw = UNPACK[squeeze](data[at : at + n], rows * part_w * channels * kind.itemsize)
        if len(raw) < rows * part_w * channels * kind.itemsize:
            raise Damaged("a part is too short")
        part = np.frombuffer(raw, dtype=kind).astype(image.dtype).reshape(rows, part_w, channels)
        if differ == 2:
            part = np.cumsum(part, axis=1, dtype=image.dtype)
        image[y : y + rows, x : x + part_w] = part[: height - y, : width - x]
    return Page(number, width, height, channels, bits, squeeze, image.tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 256, tile: tuple[int, int] | None = None, big: bool = False) -> bytes:
    """A file of the images, each (height, width) or (height, width, channels) of unsigned 8- or 16-bit samples. tile: height and width, else strips."""
    order = ">" if big else "<"
    out = bytearray((b"MM" if big else b"II") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, channels = image.shape
        kind = image.dtype.newbyteorder(order)
        part_h, part_w = tile or (strip_rows, width)
        starts, sizes = [], []
        for y in range(0, height, part_h):
            for x in range(0, width, part_w):
                part = image[y : y + part_h, x : x + part_w]
                if tile:
                    part = np.pad(part, ((0, part_h - part.shape[0]), (0, part_w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                packed = PACK[compression](part.astype(kind).tobytes())
                starts.append(len(out))
                sizes.append(len(packed))
                out += packed
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [image.dtype.itemsize * 8] * channels, COMPRESSION: [compression], PHOTOMETRIC: [2 if channels == 3 else 1], PER_PIXEL: [channels], PREDICTOR: [predictor]}
        tags |= {TILE_W: [part_w], TILE_H: [part_h], TILE_AT: starts, TILE_BYTES: sizes} if tile else {STRIP_AT: starts, STRIP_ROWS: [part_h], STRIP_BYTES: sizes}
        fields = b""
        for tag, values in sorted(tags.items()):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, PER_PIXEL, PREDICTOR)
            packed = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                packed, at = struct.pack(order + "I", len(out)), packed
                out += at
            fields += struct.pack(order + "HHI", tag, 3 if short else 4, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
