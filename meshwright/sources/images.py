"""Finding and reading image slices and point files."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImageDirectoryError
from ..schema import PIXELS
from .codecs import decoded_gif, decoded_jpeg, decoded_png, grey

# Suffixes of image files.
SUFFIXES = ("tiff", "tif", "jpg", "jpeg", "png", "bmp", "gif")


def is_image(path: Column) -> Column:
    """Whether the name ends in an image suffix; case counts."""
    return path.rlike(rf"\.({'|'.join(SUFFIXES)})$")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def slice_number(path: Column) -> Column:
    """The number at the stem's end, of four digits or else three; null without."""
    four, three = (F.regexp_extract(stem(path), rf"(\d{{{n}}})$", 1) for n in (4, 3))
    return F.when(four != "", four.cast("int")).when(three != "", three.cast("int"))


def in_depth(number: Column, low: float | None = None, high: float | None = None) -> Column:
    """Strictly between the bounds; no bound: no limit."""
    ok = number.isNotNull()
    if low is not None:
        ok &= number > low
    return ok & (number < high) if high is not None else ok


def has_prefix(path: Column, prefix: str | None) -> Column:
    """Whether the stem contains ``prefix``; None: always."""
    return F.lit(True) if prefix is None else stem(path).contains(prefix)


def four_digits(number: Column) -> Column:
    """Zero-padded to four digits; more digits are an error."""
    return F.when(F.length(number.cast("string")) <= 4, F.lpad(number.cast("string"), 4, "0")).otherwise(F.raise_error(F.lit("a slice number has at most four digits")))


def slices(spark: SparkSession, path: str, depth: tuple[float | None, float | None] | None = None, prefix: str | None = None, dim: int = 2) -> DataFrame:
    """(path, z, content) of a folder's image files, or of one file; for two dimensions the first by name only.

    Names are chosen before any content is read: first from a listing, which
    reads no content, and the content of the chosen files only.
    """
    files = spark.read.format("binaryFile").load(path)
    named = files.select("path").where(is_image(F.col("path")) & has_prefix(F.col("path"), prefix))
    if dim == 2:
        first = named.agg(F.min("path")).first()[0]
        if first is None:
            raise ImageDirectoryError(path)
        return spark.read.format("binaryFile").load(literal(first)).select("path", F.lit(0).alias("z"), "content")
    own = named.withColumn("z", slice_number(F.col("path"))).where(in_depth(F.col("z"), *(depth or (None, None))))
    if own.isEmpty():
        raise ImageDirectoryError(path)
    kept = is_image(F.col("path")) & has_prefix(F.col("path"), prefix)
    return files.where(kept).withColumn("z", slice_number(F.col("path"))).where(in_depth(F.col("z"), *(depth or (None, None)))).select("path", "z", "content")


def literal(path: str) -> str:
    """A path that names itself where patterns are understood."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: runs of literal bytes and of repeated ones."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF writes it: codes of 9 to 12 bits, high bits first, 256 to clear the table and 257 to end."""
    out, bits, n_bits, width = bytearray(), 0, 0, 9
    table, last = [bytes([i]) for i in range(256)] + [b"", b""], b""
    for byte in data:
        bits, n_bits = bits << 8 | byte, n_bits + 8
        if n_bits < width:
            continue
        n_bits -= width
        code, bits = bits >> n_bits, bits & (1 << n_bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else max(9, (len(table) + 1).bit_length())
    return bytes(out)


#: TIFF's numbers of ways to pack data.
PACKED: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


def decoded_tiff(content: bytes) -> np.ndarray:
    """The first page of a TIFF in strips, of 8 or 16 bits a sample, plain or packed by LZW, Deflate or PackBits, as grey; of 16 bits the high ones."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise ValueError("not a TIFF")
    start = struct.unpack(order + "I", content[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", content[start : start + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[start + 2 + 12 * i : start + 10 + 12 * i])
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if size:
            at = start + 10 + 12 * i
            if n * size > 4:
                at = struct.unpack(order + "I", content[at : at + 4])[0]
            tags[tag] = struct.unpack(order + f"{n}{code}", content[at : at + n * size])
    width, height, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    depth, way, ahead = set(tags.get(258, (8,))), tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if depth not in ({8}, {16}) or way not in PACKED or tags.get(284, (1,))[0] != 1 or ahead not in (1, 2) or 273 not in tags:
        raise ValueError("only TIFF files in strips of 8 or 16 bits a sample, plain or packed by LZW, Deflate or PackBits, are read")
    kind = np.dtype(np.uint8 if depth == {8} else order + "u2")
    data = b"".join(PACKED[way](content[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    image = np.frombuffer(data, kind, width * height * channels).reshape(height, width, channels).astype(kind.newbyteorder("="))
    if ahead == 2:  # each sample is kept as the step from the one before
        image = np.cumsum(image, axis=1, dtype=image.dtype)
    image = image.astype(np.int32) >> (8 if depth == {16} else 0)
    return grey(255 - image if tags.get(262, (1,))[0] == 0 else image)


def decoded_bmp(content: bytes) -> np.ndarray:
    """An uncompressed BMP of 8 bits with a palette, 24 or 32 bits, as grey."""
    at, size, width, height, _, bits, way = struct.unpack("<IIiiHHI", content[10:34])
    if bits not in (8, 24, 32) or way not in (0, 3) or (way == 3 and bits != 32):
        raise ValueError("only uncompressed BMP files of 8, 24 or 32 bits are read")
    row = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(content, np.uint8, row * abs(height), at).reshape(abs(height), row)[:, : width * bits // 8]
    if bits == 8:
        n = (struct.unpack("<I", content[46:50])[0] or 256) if size >= 40 else 256
        palette = np.frombuffer(content, np.uint8, 4 * n, 14 + size).reshape(n, 4)
        image = palette[np.minimum(raw, n - 1)]
    else:
        image = raw.reshape(abs(height), width, bits // 8)
    image = image[:, :, 2::-1].astype(np.int32)  # stored as blue, green, red
    return grey(image if height < 0 else image[::-1])


def decoded(content: bytes) -> np.ndarray:
    """PNG, GIF, JPEG, BMP or TIFF by their first bytes, as grey of 0 to 255."""
    for start, decoder in ((b"\x89PNG", decoded_png), (b"GIF8", decoded_gif), (b"\xff\xd8", decoded_jpeg), (b"BM", decoded_bmp)):
        if content.startswith(start):
            return decoder(content)
    return decoded_tiff(content)


def pixels(found: DataFrame, image_id: int = 0) -> DataFrame:
    """The pixels of slices; a file that cannot be read is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                try:
                    image = decoded(bytes(row.content))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    raise ValueError(f"cannot read {row.path}: {e}") from e
                r, c = np.indices(image.shape)
                yield pd.DataFrame({"image_id": image_id, "z": row.z, "r": r.ravel(), "c": c.ravel(), "v": image.ravel()}).astype({"z": "int32", "r": "int32", "c": "int32", "v": "int32"})

    return found.select("path", "z", "content").mapInPandas(run, PIXELS)


def encoded_tiff(image: np.ndarray) -> bytes:
    """A grey 8-bit TIFF."""
    height, width = image.shape
    data = image.astype(np.uint8).tobytes()
    tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(data))]
    entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def point_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """``columns`` (new name: name in the header) of a CSV file with a header, as numbers; names may hold dots and units."""
    found = spark.read.csv(path, header=True)
    return found.select(*(F.col(f"`{old}`").cast("double").alias(new) for new, old in columns.items()))


def point_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A file of numbers parted by blanks; lines that do not start with a number are headers."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^[+-]?[0-9.]"))
    return lines.select(*(fields[i].cast("double").alias(n) for i, n in enumerate(columns)))


def bonds(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from 0, from a file of pairs counted from 1."""
    t = point_table(spark, path, ["a", "b"])
    return t.select((F.col("a") - 1).cast("long").alias("src"), (F.col("b") - 1).cast("long").alias("dst"))
