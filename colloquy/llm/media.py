"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import in_batches

UNIT, TILE = 64, 32


def _token(data: bytes, at: int) -> tuple[bytes, int]:
    """The next word of a Netpbm header, without comments, and the place after it."""
    while at < len(data) and (data[at] in b" \t\n\r\v\f" or data[at] == 35):
        if data[at] == 35:
            while at < len(data) and data[at] not in b"\n\r":
                at += 1
        else:
            at += 1
    start = at
    while at < len(data) and data[at] not in b" \t\n\r\v\f#":
        at += 1
    if start == at:
        raise ValueError("truncated Netpbm header")
    return data[start:at], at


def _number(data: bytes, at: int, least: int, most: int) -> tuple[int, int]:
    word, at = _token(data, at)
    if not word.isdigit() or not least <= int(word) <= most:
        raise ValueError("bad number in the Netpbm header")
    return int(word), at


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as uint8 or uint16, (height, width) or (height, width, 3), and the sample that is white. Bits come out as 1
    for white, so that larger samples are lighter in all kinds."""
    kind, at = _token(data, 0)
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    width, at = _number(data, at, 1, 2**31 - 1)
    height, at = _number(data, at, 1, 2**31 - 1)
    bits = kind in (b"P1", b"P4")
    most, at = (1, at) if bits else _number(data, at, 1, 65535)
    depth = 3 if kind in (b"P3", b"P6") else 1
    n, size = width * height * depth, 2 if most > 255 else 1
    if kind in (b"P1", b"P2", b"P3"):
        rest = b"\n".join(line.split(b"#")[0] for line in data[at:].splitlines())
        words = [b"%c" % x for x in b"".join(rest.split())] if bits else rest.split()
        words = words[:n] if n <= len(words) else words
        if not all(w.isdigit() and len(w) < 6 for w in words):
            raise ValueError("bad Netpbm sample")
        flat = np.array([int(w) for w in words], np.int64)
    elif len(data) - at - 1 < (((width + 7) // 8) * height if bits else n * size):
        raise ValueError("truncated Netpbm samples")
    elif bits:
        row = (width + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if size == 2 else np.uint8, n, at + 1)
    if len(flat) < n:
        raise ValueError("truncated Netpbm samples")
    if flat.max() > most:
        raise ValueError("Netpbm sample above the maximum")
    flat = (1 - flat if bits else flat).astype(np.uint16 if size == 2 else np.uint8)
    return np.ascontiguousarray(flat.reshape((height, width, 3) if depth == 3 else (height, width))), most


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 8 (grey or palette), 24 or 32 bits, bottom-up or top-down, as RGB or grey uint8."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    offset, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32) or (packed == 3 and bits != 32):
        raise ValueError("BMP variant not supported")
    row = (width * bits // 8 + 3) // 4 * 4
    if width <= 0 or not height or offset < 14 + head or offset + row * abs(height) > len(data):
        raise ValueError("bad BMP size")
    rows = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256 or 14 + head + 4 * used > len(data) or rows[:, :width].max() >= used:
            raise ValueError("bad BMP palette")
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
        out = palette[rows[:, :width]]
        return np.ascontiguousarray(out[..., 0] if (palette[:, :1] == palette).all() else out)
    return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1])


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP."""
    h, w = samples.shape
    row = (w + 3) // 4 * 4
    rows = np.zeros((h, row), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 14 + 40 + 1024 + h * row, 0, 0, 14 + 40 + 1024, 40, w, h, 1, 8, 0, h * row, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of a file, and the sample that is white."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each target pixel's area, from an integral image; areas may end inside a source pixel."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, along: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(along) - 2)
        part = (edges - low).reshape(-1, *[1] * (along.ndim - 1))
        return along[low] * (1 - part) + along[low + 1] * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    corner = at(xs, at(ys, total).T).T
    area = (h / height) * (w / width)
    return (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, most: int = 255, side: int = TILE) -> bytes:
    """A side x side uint8 tile of an image in NPY form, scaled so that the sample `most` becomes 255."""
    return npy(np.clip(np.rint(area_resize(grey(image), side, side) * (255 / most)), 0, 255).astype(np.uint8))


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def media_tiles(images: DataFrame, id_col: str = "id", data_col: str = "data", side: int = TILE, most_pixels: int = 100_000_000) -> DataFrame:
    """(id, height, width, tile, dhash, error) of a column of Netpbm or BMP files.

    Null, empty or broken files, such with samples above their maximum or sizes that their bytes don't fill, and files of
    over `most_pixels` pixels have nulls and an error text; other columns are not read, repeated rows stay. Tiles are
    scaled by the file's maximum, and bits are black or white as the format has it.
    """

    def one(data: bytes | None):
        try:
            image, most = decode(data or b"")
            if image.shape[0] * image.shape[1] > most_pixels:
                raise ValueError("too many pixels")
            return (*image.shape[:2], tile(image, most, side), difference_hash(image), None)
        except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
            return None, None, None, None, str(e)[:200] or "broken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x.as_py()) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True))], ["id", "height", "width", "tile", "dhash", "error"])

    kind = images.schema[id_col].dataType.simpleString()
    return in_batches(images.select(images[id_col].alias("id"), images[data_col].alias("data"))).mapInArrow(run, f"id {kind}, height int, width int, tile binary, dhash string, error string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_files: bool = False) -> DataFrame:
    """Stores each text as an 8-bit grey PGM of 64 samples a row, reads it back and computes its features.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference
    hash), tile_sha256, and with keep_files the PGM and the NPY tile. Null and empty texts are one row of 64 zeros;
    equal texts give equal values; repeated rows stay; no shuffle, no limit on length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py()
                payload = payload_of(text)
                stored = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))
                image, _ = decode(stored)
                back = image.tobytes()
                small = tile(image)
                rows.append((len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), hashlib.sha256(small).hexdigest(), *((stored, small) if keep_files else ())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", *(("media", "tile") if keep_files else ())]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *((pa.binary(),) * 2 if keep_files else ())]
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} {sql[t]}" for n, t in zip(names[1:], kinds, strict=True))])).withColumnRenamed("id", id_col)
