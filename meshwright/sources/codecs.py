"""Image files packed by prediction, codes and transforms, as grey arrays: PNG, GIF and baseline JPEG.

A file is decoded within a task; files are spread over tasks by Spark.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

# The passes of an interlaced PNG as first row, first column, step of rows, step of columns.
PNG_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
# Samples a pixel by a PNG's kind of colour; 3 is an index into a palette.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# First row and step of rows of an interlaced GIF.
GIF_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def grey(image: np.ndarray) -> np.ndarray:
    """(rows, columns, samples) as grey: of three or more samples red, green and blue weighed; else the first."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.int32)
    return np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.int32)


def unfiltered(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """(rows, columns, bytes) of a PNG without its prediction: diagonal by diagonal, as a pixel needs those to its left, above and between."""
    height, width, _ = lines.shape
    out = np.zeros((height + 1, width + 1, lines.shape[2]), np.int16)
    for t in range(height + width - 1):
        r = np.arange(max(0, t - width + 1), min(height, t + 1))
        c = t - r
        left, up, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r, None]
        far = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]  # of the sum less the corner, from each
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[r + 1, c + 1] = (lines[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _png_part(raw: bytes, at: int, height: int, width: int, samples: int, depth: int) -> tuple[np.ndarray, int]:
    """One pass of a PNG's rows from ``at`` on, as (height, width, samples), and where it ends."""
    size, step = (width * samples * depth + 7) // 8, max(1, samples * depth // 8)
    rows = np.frombuffer(raw, np.uint8, height * (1 + size), at).reshape(height, 1 + size)
    if rows[:, 0].max(initial=0) > 4:
        raise ValueError("broken PNG data")
    data = unfiltered(rows[:, 1:].reshape(height, size // step, step), rows[:, 0]).reshape(height, size)
    if depth == 16:
        data = data[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(data, axis=1).reshape(height, -1, depth)
        data = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * samples]
    return data.reshape(height, width, samples), at + height * (1 + size)


def decoded_png(content: bytes) -> np.ndarray:
    """Any PNG as grey: 1 to 16 bits a sample (of 16 the high ones), grey, colours or palette, interlaced or not; transparency is passed over."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head, palette = 8, [], None, None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[3] not in PNG_SAMPLES or head[2] not in (1, 2, 4, 8, 16) or (head[3] == 3 and palette is None):
        raise ValueError("broken PNG header")
    width, height, depth, colour, _, _, interlaced = head
    raw, samples = zlib.decompress(b"".join(data)), PNG_SAMPLES[colour]
    image, at = np.zeros((height, width, samples), np.uint8), 0
    for r, c, down, right in PNG_PASSES if interlaced else ((0, 0, 1, 1),):
        rows, columns = len(range(r, height, down)), len(range(c, width, right))
        if rows and columns:
            image[r::down, c::right], at = _png_part(raw, at, rows, columns, samples, depth)
    if colour == 3:
        if image.max(initial=0) >= len(palette):
            raise ValueError("a PNG names a colour that its palette lacks")
        image = palette[image[:, :, 0]]
    elif depth < 8:
        image = image * (255 // ((1 << depth) - 1))
    return grey(image)


def unpacked_codes(data: bytes, least: int) -> bytes:
    """LZW as GIF writes it: codes low bits first, from ``least`` + 1 up to 12 bits, a full table stays until it is cleared."""
    clear = 1 << least
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, bits, n_bits, table, last, width = bytearray(), 0, 0, list(start), b"", least + 1
    for byte in data:
        bits, n_bits = bits | byte << n_bits, n_bits + 8
        while n_bits >= width:
            code, bits, n_bits = bits & (1 << width) - 1, bits >> width, n_bits - width
            if code == clear:
                table, last, width = list(start), b"", least + 1
                continue
            if code == clear + 1:
                return bytes(out)
            if code > len(table) or (code == len(table) and not last):
                raise ValueError("broken LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last, width = entry, min(12, len(table).bit_length())
    return bytes(out)


def decoded_gif(content: bytes) -> np.ndarray:
    """The first image of a GIF on its screen's background, as grey; transparency is passed over."""
    if content[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    if len(content) < 13:
        raise ValueError("broken GIF data")
    width, height, flags, ground, _ = struct.unpack("<HHBBB", content[6:13])

    def colours(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        n = 2 << (flags & 7) if flags & 128 else 0
        return (np.frombuffer(content, np.uint8, 3 * n, at).reshape(n, 3) if n else None), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := content[at] if at < len(content) else 0:
            parts.append(content[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    shared, at = colours(13, flags)
    while content[at : at + 1] == b"\x21":  # remarks, times and the like
        _, at = blocks(at + 2)
    if content[at : at + 1] != b"\x2c":
        raise ValueError("a GIF without an image")
    left, top, columns, rows, flags = struct.unpack("<HHHHB", content[at + 1 : at + 10])
    own, at = colours(at + 10, flags)
    palette = own if own is not None else shared
    least = content[at] if at < len(content) else 0
    if palette is None or not 2 <= least <= 8:
        raise ValueError("a GIF without colours")
    data = np.frombuffer(unpacked_codes(blocks(at + 1)[0], least), np.uint8)
    if len(data) < rows * columns or data[: rows * columns].max(initial=0) >= len(palette):
        raise ValueError("broken GIF data")
    order = np.concatenate([np.arange(a, rows, step) for a, step in GIF_PASSES]) if flags & 64 else np.arange(rows)
    image = np.empty((rows, columns), np.uint8)
    image[order] = data[: rows * columns].reshape(rows, columns)
    behind = shared[ground] if shared is not None and ground < len(shared) else np.zeros(3, np.uint8)
    screen = np.full((max(height, top + rows), max(width, left + columns), 3), behind, np.uint8)
    screen[top : top + rows, left : left + columns] = palette[image]
    return grey(screen)


#: Places of a block's coefficients in the order of a JPEG: diagonals, up and down in turn.
ZIGZAG = [8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))]
#: Cosines of the transform of 8 samples: coefficient by sample.
COSINES = np.array([[np.cos((2 * x + 1) * k * np.pi / 16) / (8**0.5 if k == 0 else 2) for x in range(8)] for k in range(8)])

Codes = list[tuple[int, int]]


def codes(counts: bytes, symbols: bytes) -> Codes:
    """(length, symbol) by the next 16 bits, of codes that are counted by length and go upwards."""
    out: Codes = []
    at = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out += [(length, symbol)] * (1 << 16 - length)
        at += n
    if len(out) > 1 << 16 or at > len(symbols):
        raise ValueError("broken JPEG codes")
    return out + [(0, 0)] * ((1 << 16) - len(out))


def coefficients(data: bytes, n: int, plan: list[tuple[int, Codes, Codes]], out: np.ndarray) -> None:
    """Read ``n`` units of a scan between restarts into ``out`` (unit, block, coefficient); ``plan`` has each block's component and codes."""
    acc = held = at = 0
    last = dict.fromkeys((c for c, _, _ in plan), 0)
    for unit in range(n):
        for block, (component, first, later) in enumerate(plan):
            k = 0
            while k < 64:
                if held < 32:
                    acc = (acc & (1 << held) - 1) << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\xff"), "big")
                    held, at = held + 32, at + 4
                length, symbol = (later if k else first)[acc >> held - 16 & 0xFFFF]
                if not length or at > len(data) + 8:  # past the end there are ones, which are no code
                    raise ValueError("JPEG data end early" if at > len(data) else "broken JPEG data")
                held -= length
                run, bits = symbol >> 4, symbol & 15
                if k and not bits:
                    if run < 15:
                        break
                    k += 16
                    continue
                held -= bits
                value = acc >> held & (1 << bits) - 1
                if bits and value < 1 << bits - 1:
                    value -= (1 << bits) - 1
                if k == 0:
                    last[component] += value
                    value = last[component]
                k += run
                if k > 63:
                    raise ValueError("broken JPEG data")
                out[unit, block, k] = value
                k += 1


def decoded_jpeg(content: bytes) -> np.ndarray:
    """A JPEG of one pass (baseline or extended, 8 bits, Huffman codes) as grey: its brightness, or the weighed colours if it holds red, green and blue. Others are named in the error."""
    at, steps, dc, ac, every, adobe, jfif = 2, {}, {}, {}, 0, None, False
    parts: dict[int, dict] = {}
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("broken JPEG markers")
        mark = content[at + 1]
        if mark == 0xFF:  # filling
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body, at = content[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide, own = body[0] >> 4, body[0] & 15
                steps[own] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[129 if wide else 65 :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("only JPEG files of 8 bits with one or three components are read")
            for i in range(n):
                own, factors, table = body[6 + 3 * i : 9 + 3 * i]
                parts[own] = {"h": factors >> 4, "v": factors & 15, "table": table}
            most_h, most_v = max(p["h"] for p in parts.values()), max(p["v"] for p in parts.values())
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts.values():
                p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64), np.int32)
        elif 0xC2 <= mark <= 0xCF and mark != 0xCC:
            raise ValueError("progressive, lossless and arithmetic JPEG files are not read; convert them to PNG or TIFF")
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark == 0xE0 and body[:4] == b"JFIF":
            jfif = True
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            if not parts:
                raise ValueError("a JPEG scan without a header")
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(content, at)
            stop = end.start() if end else len(content)
            runs = [run.replace(b"\xff\x00", b"\xff") for run in re.split(rb"\xff+[\xd0-\xd7]", content[at:stop])]
            named = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            for own, tables in named:
                parts[own]["codes"] = own, dc[tables >> 4], ac[tables & 15]
                parts[own]["steps"] = steps[parts[own]["table"]]
            if len(named) == 1:  # blocks of one component go row by row, without those that only fill units
                p = parts[named[0][0]]
                plan = [(named[0][0], 0, 0)]
                grid = -(-(-(-height * p["v"] // most_v)) // 8), -(-(-(-width * p["h"] // most_h)) // 8), 1, 1
            else:
                plan = [(own, r, c) for own, _ in named for r in range(parts[own]["v"]) for c in range(parts[own]["h"])]
                grid = down, across, None, None
            units = grid[0] * grid[1]
            found, each = np.zeros((units, len(plan), 64), np.int32), every or units
            if len(runs) < -(-units // each):
                raise ValueError("JPEG data end early")
            for i, start in enumerate(range(0, units, each)):
                coefficients(runs[i], min(each, units - start), [parts[own]["codes"] for own, _, _ in plan], found[start : start + each])
            found = found.reshape(grid[0], grid[1], len(plan), 64)
            for i, (own, r, c) in enumerate(plan):
                tall, wide = grid[2] or parts[own]["v"], grid[3] or parts[own]["h"]
                parts[own]["blocks"][r : r + tall * grid[0] : tall, c : c + wide * grid[1] : wide] = found[:, :, i]
            at = stop
    if not parts or any("codes" not in p for p in parts.values()):
        raise ValueError("JPEG data end early")

    def plane(p: dict) -> np.ndarray:
        rows, columns, _ = p["blocks"].shape
        square = np.zeros((rows, columns, 64))
        square[:, :, ZIGZAG] = p["blocks"] * p["steps"]
        samples = COSINES.T @ square.reshape(rows, columns, 8, 8) @ COSINES
        flat = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        return flat.repeat(most_v // p["v"], 0).repeat(most_h // p["h"], 1)[:height, :width]

    if any(most_v % p["v"] or most_h % p["h"] for p in parts.values()):
        raise ValueError("JPEG files whose components differ by other than whole factors are not read")
    is_rgb = len(parts) == 3 and (adobe == 0 if adobe is not None else not jfif and bytes(parts) == b"RGB")
    return grey(np.stack([plane(p) for p in (parts.values() if is_rgb else list(parts.values())[:1])], axis=2))
