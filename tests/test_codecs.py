"""PNG, GIF and JPEG files written here by the plain rules of their formats, and read by the library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from meshwright.sources import codecs
from meshwright.sources import images as files


def predicted(row, above, step, kind):
    """A PNG row's bytes less their guesses, byte by byte."""
    out = bytearray([kind])
    for j, value in enumerate(row):
        left, up, corner = (row[j - step] if j >= step else 0), above[j], (above[j - step] if j >= step else 0)
        p = left + up - corner
        paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        out.append((value - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
    return bytes(out)


def png(image, depth=8, colour=0, interlaced=False, palette=None, kinds=(0, 1, 2, 3, 4)):
    """``image`` (rows, columns, samples) of numbers below 2 ** depth."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    height, width, samples = image.shape
    data = b""
    for r, c, down, right in codecs.PNG_PASSES if interlaced else ((0, 0, 1, 1),):
        part = image[r::down, c::right]
        if not part.size:
            continue
        above = None
        for i, line in enumerate(part):
            bits = "".join(format(int(v), f"0{depth}b") for v in line.ravel())
            row = bytes(int(bits[j : j + 8].ljust(8, "0"), 2) for j in range(0, len(bits), 8))
            data += predicted(row, above or bytes(len(row)), max(1, samples * depth // 8), kinds[i % len(kinds)])
            above = row
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced)))
    packed = zlib.compress(data)
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("depth", "colour", "samples"), [(1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (8, 6, 4), (16, 6, 4), (1, 3, 1), (4, 3, 1), (8, 3, 1)])
def test_png(depth, colour, samples, interlaced):
    rng = np.random.default_rng(depth + colour)
    palette = rng.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
    for shape in ((1, 1), (3, 2), (13, 22), (22, 13)):
        image = rng.integers(0, 1 << depth, (*shape, samples))
        if palette is not None:
            want = palette[image[:, :, 0]]
        else:
            want = image >> 8 if depth == 16 else image * 255 // ((1 << depth) - 1)
        want = np.rint(want[:, :, :3] @ [0.299, 0.587, 0.114]) if want.shape[2] > 2 else want[:, :, 0]
        assert (files.decoded(png(image, depth, colour, interlaced, palette)) == want).all()
    with pytest.raises(ValueError, match="PNG"):
        files.decoded(png(image, depth, colour, interlaced, palette).replace(b"IHDR", b"IHDX"))


def codes_of_gif(data, least, room=4096):
    """GIF's codes of indices; the table is cleared once it holds ``room`` entries, or never."""
    clear, out, bits = 1 << least, [], []
    table, width = {bytes([i]): i for i in range(clear)}, least + 1
    n = clear + 2
    put = lambda code: bits.append(format(code, f"0{width}b")[::-1])
    put(clear)
    word = b""
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word])
        if n < 4096:
            table[longer] = n
            n += 1
            width = min(12, max(width, (n - 1).bit_length()))
        if n >= room:
            put(clear)
            table, width, n = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        word = bytes([b])
    put(table[word])
    n += n < 4096
    width = min(12, max(width, (n - 1).bit_length()))
    put(clear + 1)
    text = "".join(bits)
    out = bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))
    return bytes([least]) + b"".join(bytes([len(out[i : i + 255])]) + out[i : i + 255] for i in range(0, len(out), 255)) + b"\0"


def gif(image, palette, least, interlaced=False, own=False, at=(0, 0), screen=None, room=4096):
    """A GIF of one image; its colours are its own or the screen's."""
    rows, columns = image.shape
    high, wide = screen or image.shape
    flag = 128 | least - 1
    colours = palette.astype(np.uint8).tobytes()
    lines = image[[r for a, step in codecs.GIF_PASSES for r in range(a, rows, step)]] if interlaced else image
    out = b"GIF89a" + struct.pack("<HHBBB", wide, high, 0 if own else flag, 1, 0) + (b"" if own else colours)
    out += b"\x21\xfe\x02hi\0" + b"\x21\xf9\x04\0\0\0\0\0"
    out += b"\x2c" + struct.pack("<HHHHB", at[1], at[0], columns, rows, (flag if own else 0) | 64 * interlaced) + (colours if own else b"")
    return out + codes_of_gif(bytes(lines.astype(np.uint8).ravel()), least, room) + b"\x3b"


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("room", [4095, 1 << 20])
def test_gif(interlaced, own, room):
    rng = np.random.default_rng(3)
    for least, shape in ((2, (1, 1)), (2, (7, 9)), (4, (37, 21)), (8, (120, 130))):
        palette = rng.integers(0, 256, (1 << least, 3))
        shade = np.rint(palette @ [0.299, 0.587, 0.114])
        for image in (rng.integers(0, 1 << least, shape), np.zeros(shape, int), np.arange(shape[0] * shape[1]).reshape(shape) // 5 % (1 << least)):
            assert (files.decoded(gif(image, palette, least, interlaced, own, room=room)) == shade[image]).all()
    got = files.decoded(gif(image, palette, least, interlaced, own, (2, 3), (130, 140), room))
    want = np.full((130, 140), 0 if own else shade[1])
    want[2:122, 3:133] = shade[image]
    assert (got == want).all()
    with pytest.raises(ValueError, match="GIF data"):
        files.decoded(gif(image, palette, least)[:900] + b"\0")


# Codes of the JPEG files here: 12 of four bits for steps, the end of a block in two bits, all else in nine.
FIRST = bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))
LATER = bytes([0, 1] + [0] * 6 + [161] + [0] * 7), bytes([0] + [r << 4 | s for r in range(16) for s in range(1, 11)] + [0xF0])


def jpeg(planes, factors, step=1, every=0, apart=False, adobe=None, names=(1, 2, 3), jfif=True):
    """Planes at their own sizes (those of the first fill the file), each with its (h, v); ``apart`` gives every one its scan."""
    height, width = planes[0].shape
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    down, across = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    order = [(0, 0)] + [(i, s - i) if s % 2 else (s - i, i) for s in range(1, 15) for i in range(s + 1) if s - i < 8 and i < 8]
    cos = np.array([[(0.5**0.5 if k == 0 else 1) / 2 * np.cos(np.pi * k * (x + 0.5) / 8) for x in range(8)] for k in range(8)])

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def block(i, r, c, last):
        full = np.pad(planes[i], ((0, 800 - planes[i].shape[0]), (0, 800 - planes[i].shape[1])), mode="edge")[8 * r : 8 * r + 8, 8 * c : 8 * c + 8]
        found = np.rint(cos @ (full - 128.0) @ cos.T / step).astype(int)
        zigzag = [int(found[p]) for p in order]
        size, bits = number(zigzag[0] - last)
        out, run = format(size, "04b") + bits, 0
        for k in range(1, 64):
            if zigzag[k] == 0:
                run += 1
                continue
            while run > 15:
                out, run = out + format(128 + 160, "09b"), run - 16
            size, bits = number(zigzag[k])
            out, run = out + format(128 + 10 * run + size - 1, "09b") + bits, 0
        return out + ("00" if run else ""), zigzag[0]

    def packed(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    def scan(chosen):
        if len(chosen) == 1:
            h, v = factors[chosen[0]]
            units = [[(chosen[0], r, c)] for r in range(-(-(-(-height * v // most_v)) // 8)) for c in range(-(-(-(-width * h // most_h)) // 8))]
        else:
            units = [[(i, r * factors[i][1] + y, c * factors[i][0] + x) for i in chosen for y in range(factors[i][1]) for x in range(factors[i][0])] for r in range(down) for c in range(across)]
        out = segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([names[i], 0]) for i in chosen) + bytes([0, 63, 0]))
        for n, a in enumerate(range(0, len(units), every or len(units))):
            last, text = [0] * len(planes), ""
            for i, r, c in (b for unit in units[a : a + (every or len(units))] for b in unit):
                bits, last[i] = block(i, r, c, last[i])
                text += bits
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + packed(text)
        return out

    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, 2 + len(body)) + body
    out = b"\xff\xd8" + (segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") if jfif else b"")
    out += segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe])) if adobe is not None else b""
    out += segment(0xDB, bytes([0] + [step] * 64)) + b"\xff" + segment(0xDD, struct.pack(">H", every))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([n, h << 4 | v, 0]) for n, (h, v) in zip(names, factors, strict=False)))
    out += segment(0xC4, b"\0" + FIRST[0] + FIRST[1] + b"\x10" + LATER[0] + LATER[1])
    return out + b"".join(scan([i]) for i in range(len(planes))) * apart + (b"" if apart else scan(list(range(len(planes))))) + b"\xff\xd9"


@pytest.mark.parametrize("every", [0, 1, 3])
@pytest.mark.parametrize("apart", [False, True])
def test_jpeg(every, apart):
    rng = np.random.default_rng(4)
    for height, width in ((1, 1), (8, 8), (19, 37), (40, 33)):
        noise, smooth = rng.integers(0, 256, (height, width)), np.add.outer(np.arange(height) * 3, np.arange(width) * 2) % 256
        for plane in (noise, smooth, np.full((height, width), 255)):
            assert np.abs(files.decoded(jpeg([plane], [(1, 1)], every=every)) - plane).max() <= 2
            halves = [rng.integers(0, 256, (-(-height // 2), -(-width // 2))) for _ in range(2)]
            assert np.abs(files.decoded(jpeg([plane, *halves], [(2, 2), (1, 1), (1, 1)], every=every, apart=apart)) - plane).max() <= 2
        rough = files.decoded(jpeg([smooth], [(1, 1)], step=3, every=every))
        assert np.abs(rough - smooth).mean() <= 2
        colours = [rng.integers(0, 256, (height, width)) for _ in range(3)]
        want = np.stack(colours, 2) @ [0.299, 0.587, 0.114]
        for how in ({"adobe": 0}, {"names": tuple(b"RGB"), "jfif": False}):
            assert np.abs(files.decoded(jpeg(colours, [(1, 1)] * 3, every=every, apart=apart, **how)) - want).max() <= 2


def test_jpeg_refusals():
    content = jpeg([np.arange(400).reshape(20, 20) % 251], [(1, 1)])
    for broken, name in ((content.replace(b"\xff\xc0", b"\xff\xc2"), "progressive"), (content[:-200], "early"), (content[:300], "JPEG"), (content[:2], "early"), (b"\xff\xd8" + b"abcdef", "markers")):
        with pytest.raises(ValueError, match=name):
            files.decoded(broken)


def test_folder_of_all_formats(spark, tmp_path):
    image = np.add.outer(np.arange(30), 2 * np.arange(40))
    palette = np.repeat(np.arange(256)[:, None], 3, 1)
    written = {"a0001.png": png(image[:, :, None]), "a0002.gif": gif(image, palette, 8), "a0003.jpg": jpeg([image], [(1, 1)]), "a0004.jpeg": jpeg([image], [(1, 1)], every=2), "a0005.tif": files.encoded_tiff(image)}
    for name, content in written.items():
        (tmp_path / name).write_bytes(content)
    rows = files.pixels(files.slices(spark, str(tmp_path), dim=3)).toPandas()
    assert sorted(set(rows["z"])) == [1, 2, 3, 4, 5] and len(rows) == 5 * image.size
    far = np.abs(rows["v"] - image[rows["r"], rows["c"]])
    assert far[rows["z"].isin([1, 2, 5])].max() == 0 and far.max() <= 1
