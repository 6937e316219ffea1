"""Media columns: TIFF files in a binary column, one row for each page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are plain, PackBits,
LZW or deflate, chunky or planar, of unsigned samples of 1, 2, 4, 8 or 16 bits, undoes horizontal prediction, and gives
the samples of each page, row by row: a byte each, or two (low first) of 16 bits. The writer makes files of 8-bit
samples, and is what stores texts losslessly for the round trip: plain content decides which scheme, predictor and blocks
a text gets, so all of them are written and read.

A null or empty value has no pages; a page that can't be read is one row with an error beside the file's other pages; so
is a directory that can't be followed; repeated rows are rows of their
own; an empty table gives an empty result; other columns are ignored.
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
from pyspark.sql import functions as F

from cloakwork.llm.common import materialize
from cloakwork.llm.memory import map_arrow

# Fixed values of the TIFF 6.0 format: tags, compression schemes, field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 266, 284, 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_TYPES = {1: "B", 3: "H", 4: "I"}
_BYTES = {"B": 1, "H": 2, "I": 4}
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_UNREADABLE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)

#: A text's payload is padded to rows of 64 RGB pixels; a page holds at most so many of them.
ROW, PAGE_ROWS, STRIP_ROWS = 192, 4096, 1024
#: Pages go on from their task when so many bytes of them are held.
PAGE_BYTES = 2 << 20
#: How texts are stored, picked by their content: scheme, predictor, and tiles of so many rows and columns or strips.
WAYS = (
    (PACKBITS, 1, None), (PACKBITS, 2, (16, 64)), (LZW, 1, None), (LZW, 2, (16, 64)),
    (DEFLATE, 1, (16, 64)), (DEFLATE, 2, None), (DEFLATE, 1, None), (DEFLATE, 2, (16, 64)),
)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, all between them as it is."""
    values, out = np.frombuffer(data, np.uint8), bytearray()
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1)) if len(data) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    long, at = lengths > 2, 0

    def literally(i: int, j: int) -> None:
        for k in range(i, j, 128):
            part = data[k : min(k + 128, j)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(starts[long].tolist(), lengths[long].tolist()):
        literally(at, start)
        at = start + n
        while n > 1:
            out += bytes((257 - min(n, 128), data[start]))
            n -= min(n, 128)
        literally(at - n, at)
    literally(at, len(data))
    return bytes(out)


_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    fresh = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, previous, at, end = list(fresh), [], b"", 0, 8 * len(data)
    data += bytes(3)
    while True:
        n = len(table)
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
        if at + width > end:
            break
        i = at >> 3
        code = ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (24 - width - (at & 7))) & ((1 << width) - 1)
        at += width
        if code == _CLEAR:
            table, previous = list(fresh), b""
        elif code == _END:
            break
        else:
            if code > n or (code == n and not previous):
                raise ValueError("an LZW code that isn't in the table")
            entry = table[code] if code < n else previous + previous[:1]
            out.append(entry)
            if previous:
                table.append(previous + entry[:1])
            previous = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """As unpack_lzw reads it; a full table is cleared. Codes are found one by one and put into bits together."""
    codes, table, size, word = [_CLEAR], {}, 258, -1
    for c in data:
        if word < 0:
            word = c
        elif (longer := table.get(word << 8 | c)) is not None:
            word = longer
        else:
            codes.append(word)
            table[word << 8 | c] = size
            size += 1
            if size == 4094:
                codes.append(_CLEAR)
                table, size = {}, 258
            word = c
    if word >= 0:
        codes.append(word)
    codes.append(_END)
    flat = np.array(codes, np.uint16)
    cleared = np.flatnonzero(flat == _CLEAR)
    since = np.arange(len(flat)) - cleared[np.searchsorted(cleared, np.arange(len(flat)), "left") - 1] - 1  # codes since the clear before each
    since[0] = 0
    width = 9 + (since >= 254) + (since >= 766) + (since >= 1790)
    bits = np.unpackbits(flat.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


_PACK = {PLAIN: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1)}
_UNPACK = {PLAIN: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples, uint8 or, of 16 bits, little-endian uint16


def _directories(data: bytes) -> Iterator[tuple[int, str, int]]:
    """Number, byte order and place of each image directory."""
    order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42 or not at:
        raise ValueError("not a TIFF file, or one without a directory")
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        yield len(seen) - 1, order, at
        at = following


def _tags(data: bytes, order: str, at: int) -> dict[int, list[int]]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _TYPES:
            code = _TYPES[kind]
            place = at + 10 + 12 * k
            if count * _BYTES[code] > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
    return tags


def _block(body: bytes, order: str, bits: int, predictor: int, rows: int, width: int, samples: int) -> np.ndarray:
    """The samples of a strip or tile; rows begin at a byte."""
    line = -(-width * samples * bits // 8)
    if len(body) < rows * line:
        raise ValueError(f"a strip or tile has {len(body)} bytes of {rows * line}")
    if bits < 8:
        parts = np.unpackbits(np.frombuffer(body, np.uint8)[: rows * line].reshape(rows, line), axis=1).reshape(rows, -1, bits)
        return (parts @ (1 << np.arange(bits)[::-1]).astype(np.uint8))[:, : width * samples].reshape(rows, width, samples)
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    found = np.frombuffer(body[: rows * line], kind).reshape(rows, width, samples)
    found = found if bits == 8 else found.astype("<u2")
    return np.cumsum(found, axis=1, dtype=found.dtype) if predictor == 2 else found


#: No scheme makes one byte more than so many samples' bytes: a larger page isn't allocated. The most is a full table of
#: LZW strings, of which a code of 12 bits stands for one of at most 3,840 bytes.
MOST_GROWTH = 2_560


def _page(data: bytes, number: int, order: str, at: int) -> Page:
    tags = _tags(data, order, at)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    scheme, predictor, bits, fill = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(BITS, 1), one(FILL_ORDER, 1)
    if len(set(tags.get(BITS, [1]))) != 1 or bits not in (1, 2, 4, 8, 16) or bits == 16 and 3 in tags.get(SAMPLE_FORMAT, []):
        raise ValueError("samples aren't integers of 1, 2, 4, 8 or 16 bits")
    if scheme not in _UNPACK or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"no compression {scheme} with predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    places, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if min(width, height, samples, bw, bh) < 1 or max(width * height, bw * bh) * samples * bits > 8 * MOST_GROWTH * len(data):
        raise ValueError(f"a page of {width} x {height} x {samples} in blocks of {bw} x {bh}")
    planes, each = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
    across, down = -(-width // bw), -(-height // bh)
    if min(len(places), len(sizes)) < planes * across * down:
        raise ValueError("blocks are missing")
    pixels = np.zeros((height, width, samples), np.uint8 if bits <= 8 else "<u2")
    for k in range(planes * across * down):
        plane, nth = divmod(k, across * down)
        y, x = nth // across * bh, nth % across * bw
        rows = bh if tiled else min(bh, height - y)
        packed = data[places[k] : places[k] + sizes[k]]
        body = _UNPACK[scheme](packed.translate(_TURNED) if fill == 2 else packed)
        block = _block(body, order, bits, predictor, rows, bw, each)
        pixels[y : y + rows, x : x + bw, plane * each : plane * each + each] = block[: height - y, : width - x]
    return Page(number, width, height, samples, scheme, predictor, pixels)


def pages(data: bytes) -> Iterator[Page]:
    """All pages of a file; an error at the first that can't be read."""
    return (_page(data, *found) for found in _directories(data))


def readable_pages(data: bytes) -> Iterator[Page | str]:
    """Each page of a file, or what is wrong with it."""
    try:
        for number, order, at in _directories(data):
            try:
                found: Page | str = _page(data, number, order, at)
            except _UNREADABLE as e:
                found = f"page {number}: {type(e).__name__}: {e}"[:200]
            yield found
    except _UNREADABLE as e:
        yield f"{type(e).__name__}: {e}"[:200]


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of one page for each image (height x width x samples, 8 bits)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, len(padded), th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate((b[:, :1], b[:, 1:] - b[:, :-1]), axis=1)
            packed = _PACK[compression](b.tobytes())
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tw], TILE_HEIGHT: [th], TILE_OFFSETS: offsets, TILE_SIZES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_SIZES: sizes}
        short = {BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR}
        places = {}
        for tag, v in fields.items():
            code = "H" if tag in short else "I"
            if len(v) * _BYTES[code] > 4:
                places[tag] = len(out)
                out += struct.pack(f"{order}{len(v)}{code}", *v)
                out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag in sorted(fields):
            v, code = fields[tag], "H" if tag in short else "I"
            out += struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(v))
            out += struct.pack(order + "I", places[tag]) if tag in places else struct.pack(f"{order}{len(v)}{code}", *v).ljust(4, b"\0")
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def tiff_pages(files: DataFrame, key: str, content: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page of each file, a file's pages one after the other: key, the columns of keep, page, width,
    height, samples, compression, predictor, pixels and error."""
    names = ["page", "width", "height", "samples", "compression", "predictor", "pixels", "error"]
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
    own = [f"k{i}" for i in range(len(keep) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content")
            rows: list[tuple] = []
            files: list[int] = []
            held = 0

            def made() -> pa.RecordBatch:
                at = pa.array(files, pa.int64())  # noqa: B023
                own_columns = [batch.column(k).take(at) for k in own]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own_columns, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*own, *names])  # noqa: B023

            for i in range(batch.num_rows):
                data = contents[i].as_py()
                for p in readable_pages(data) if data else ():
                    files.append(i)
                    if isinstance(p, str):
                        rows.append((None, None, None, None, None, None, None, p))
                        continue
                    rows.append((p.number, p.width, p.height, p.samples, p.compression, p.predictor, p.pixels.tobytes(), None))
                    held += p.pixels.nbytes
                    if held > PAGE_BYTES:
                        yield made()
                        rows, files, held = [], [], 0
            if rows:
                yield made()

    given = files.select(*[F.col(c).alias(k) for k, c in zip(own, (key, *keep))], F.col(content).alias("content"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "content")
    out = given.transform(map_arrow, run, f"{schema}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string")
    return out.select(*[F.col(k).alias(c) for k, c in zip(own, (key, *keep))], *names)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and it with spaces added up to a positive multiple of ROW."""
    body = (text or "").encode()
    return len(body), body.ljust(max(1, -(-len(body) // ROW)) * ROW, b" ")


def stored(payload: bytes) -> bytes:
    """A payload as a TIFF of 64-pixel RGB rows in pages of PAGE_ROWS rows; its checksum picks scheme, predictor and blocks."""
    scheme, predictor, tile = WAYS[zlib.crc32(payload) % len(WAYS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], scheme, predictor, tile=tile)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column("text").to_pylist():
                size, payload = payload_of(text)
                sizes.append(size)
                files.append(stored(payload))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, n_bytes long, media binary")


def feature_of(images: list[np.ndarray]) -> str:
    """Pages, size, mean of each channel and a 64-bit average hash of the first page's 8 x 8 block means."""
    first = images[0]
    rows = np.add.reduceat(first, np.arange(8) * len(first) // 8, axis=0, dtype=np.int64) if len(first) >= 8 else np.repeat(first.astype(np.int64), 8, axis=0)[:: len(first)][:8]
    blocks = rows.reshape(8, 8, -1).sum(axis=2)
    bits = "".join("1" if b > m else "0" for b, m in zip(blocks.ravel().tolist(), [blocks.mean()] * 64))
    count = sum(i.shape[0] * i.shape[1] for i in images)
    means = [sum(int(i[:, :, c].sum(dtype=np.int64)) for i in images) / count for c in range(3)]
    return f"{len(images)}p{first.shape[1]}x{sum(map(len, images))};" + ",".join(f"{m:.3f}" for m in means) + f";{int(bits, 2):016x}"


_FEATURES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, those of a file one after the other → one row a file. One file's pages are held at a time."""
    file: tuple = ()
    images: list[np.ndarray] = []

    def row() -> tuple:
        _, doc_id, n_bytes, media_bytes, media_sha256 = file
        payload = b"".join(i.tobytes() for i in images)
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media_bytes, media_sha256, feature_of(images)

    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _FEATURES.values())], names=list(_FEATURES))
    for batch in batches:
        rows = []
        for *now, width, height, samples, pixels, error in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes", "media_bytes", "media_sha256", "width", "height", "samples", "pixels", "error"))):
            if error is not None:
                raise ValueError(f"stored text {now[1]} can't be read: {error}")
            if file and file[0] != now[0]:
                rows.append(row())
                images = []
            file = tuple(now)
            images.append(np.frombuffer(pixels, np.uint8).reshape(height, width, samples))
        if rows:
            yield made(rows)
    if file:
        yield made([row()])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored texts, from the pages that are read back. Pages aren't shuffled: those of a file
    leave tiff_pages() together and are put together in the same task."""
    files = media.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = tiff_pages(files, "row", "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read.transform(map_arrow, _described, schema)


def op10_tiff_media(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF file in a table, read back and described."""
    return media_features(materialize(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
