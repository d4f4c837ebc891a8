"""Filters, morphology, skeletons and their graphs, by hand and against numpy."""

from itertools import product
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.errors import ImageDirectoryError, InvalidArgumentsError, StructuralElementError
from meshwright.functions import geometry as geo
from meshwright.operators import imaging, learning, morphology, nematic, skeleton, thinning, weights
from meshwright.plans import queries
from meshwright.sources import graphs
from meshwright.sources import images as files
from meshwright.schema import NetworkFrame

SKELETON = """
...#....
.......#
........
""".strip()


def pixels(spark, image, image_id=0):
    image = np.asarray(image)
    return spark.createDataFrame([(image_id, 0, r, c, int(v)) for (r, c), v in np.ndenumerate(image)], "image_id long, z int, r int, c int, v int")


def voxels(spark, at):
    return spark.createDataFrame([(0, 0, r, c) for r, c in at], "image_id long, z int, r int, c int")


def as_array(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r["r"], r["c"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).integers(0, 256, (7, 9))


def mirrored(image, k):
    return np.pad(image, k, mode="reflect")


def test_gaussian_against_numpy(spark, image):
    p, w = mirrored(image, 1), np.outer([1, 2, 1], [1, 2, 1]) / 16
    want = np.rint([[(p[r : r + 3, c : c + 3] * w).sum() for c in range(9)] for r in range(7)])
    assert (as_array(imaging.gaussian_blur(pixels(spark, image), 3), image.shape) == want).all()


@pytest.mark.parametrize("border", ["reflect", "edge", None])
@pytest.mark.parametrize("half", [1, 3, 9])
def test_tiles_see_what_the_image_shows(spark, border, half):
    """Sums and counts under windows, tile by tile, against the whole image; some pixels are not there."""
    rng = np.random.default_rng(half)
    image, side = rng.integers(0, 9, (21, 13)), 2 * half + 1
    gone = {(4, 4), (20, 12)}
    df = pixels(spark, image).where("NOT (r = 4 AND c = 4) AND NOT (r = 20 AND c = 12)").withColumn("h", F.lit("clash"))
    held = image.astype(float)
    for at in gone:
        held[at] = np.nan
    wide = np.pad(held, half, mode=border) if border else np.pad(held, half, constant_values=np.nan)
    got = {(r["r"], r["c"]): r["v"] for r in imaging.tiled(df, half, lambda cells, own: np.nansum(cells, 0) + 100_000 * (~np.isnan(cells)).sum(0), border, tile=4).collect()}
    want = {(r, c): np.nansum(w := wide[r : r + side, c : c + side]) + 100_000 * (~np.isnan(w)).sum() for r in range(21) for c in range(13) if (r, c) not in gone}
    assert got == want


def test_laplacian_kernel_is_the_sum_of_second_differences():
    k = np.array(imaging.laplacian_kernel())
    assert k.sum() == 0 and (k == k.T).all() and k[2, 2] == -24 and k[0, 0] == 2


def test_blends_of_a_flat_image(spark):
    flat = np.full((5, 5), 100)
    for f in (lambda p: imaging.gradient_blend(p, imaging.SOBEL_X), imaging.laplacian_blend):
        assert set(as_array(f(pixels(spark, flat)), flat.shape).ravel()) == {75}


def test_median_and_autolevel_inside_the_image(spark, image):
    want = [[np.sort(image[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].ravel()) for c in range(9)] for r in range(7)]
    got = as_array(imaging.median(pixels(spark, image)), image.shape)
    assert all(got[r, c] == want[r][c][len(want[r][c]) // 2] for r in range(7) for c in range(9))
    flat = as_array(imaging.autolevel(pixels(spark, np.full((3, 3), 7)), 1), (3, 3))
    assert (flat == 0).all()


def test_thresholds(spark):
    two = np.array([[10, 12, 200], [11, 201, 202]])
    p = pixels(spark, two)
    assert (as_array(imaging.threshold_otsu(p), two.shape) == np.where(two > 100, 255, 0)).all()
    assert (as_array(imaging.threshold(p, 11, fg_color=1), two.shape) == np.where(two > 11, 0, 255)).all()
    with pytest.raises(ValueError):
        imaging.binarized(p, imaging.Options.of({"Thresh_method": 7}))


def test_options_take_text():
    o = imaging.Options.of('{"bsize": "3", "thresh": 103.0, "Thresh_method": "2", "other": 1}')
    assert (o.bsize, o.thresh, o.Thresh_method) == (3, 103.0, 2) and imaging.Options.of(o.to_json()) == o and imaging.odd(3) == 7


def test_low_pass_by_lines_is_the_whole_spectrum(spark):
    rng = np.random.default_rng(12)
    two = pixels(spark, rng.integers(0, 256, (9, 14)), 1).unionByName(pixels(spark, rng.integers(0, 256, (6, 5)), 2)).where("r <> 3 OR c < 7")
    for window in (1, 3):
        whole = {tuple(r) for r in imaging.low_pass(two, window).collect()}
        assert {tuple(r) for r in imaging.low_pass(two, window, most=40).collect()} == whole and len(whole) == two.count()


def test_low_pass_spans_the_range(spark, image):
    out = as_array(imaging.low_pass(pixels(spark, image), 1), image.shape)
    assert out.min() == 0 and out.max() == 255


def test_branch_patterns():
    assert len(morphology.branch_codes()) == 46


def test_end_and_branch_points_and_pruning(spark):
    plus = voxels(spark, [(2, c) for c in range(5)] + [(r, 2) for r in range(5) if r != 2])
    place = lambda df: {(r["r"], r["c"]) for r in df.collect()}
    assert place(morphology.branch_points(plus)) == {(2, 2)}
    assert place(morphology.end_points(plus)) == {(0, 2), (4, 2), (2, 0), (2, 4)}
    # one round leaves the small plus, where no arm has a single neighbour
    assert place(morphology.prune(plus, 2)) == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}


def test_closing_fills_a_hole(spark):
    ring = voxels(spark, [(r, c) for r in range(1, 4) for c in range(1, 4) if (r, c) != (2, 2)])
    box = spark.createDataFrame([(0, 1, 5, 5)], "image_id long, depth int, height int, width int")
    assert morphology.closed(ring, morphology.ball(1, True), box).count() == 9
    with pytest.raises(StructuralElementError):
        morphology.debubble(ring, 1, box)


def blobs(shape, seed, share=0.35):
    """Smooth random shapes."""
    x = np.random.default_rng(seed).random(shape)
    for axis in range(3):
        if shape[axis] > 1:
            for _ in range(3):
                x = (x + np.roll(x, 1, axis) + np.roll(x, -1, axis)) / 3
    return x > np.quantile(x, 1 - share)


def test_thinning_keeps_topology():
    bar = np.zeros((1, 9, 20), bool)
    bar[0, 2:7, 2:18] = True
    thin = thinning.thinned(bar.copy(), (True, False, False))
    assert 10 <= thin.sum() < 20 and not (thin & ~bar).any()
    ring = np.zeros((1, 12, 12), bool)
    ring[0, 1:11, 1:11] = True
    ring[0, 4:8, 4:8] = False
    left = {tuple(p) for p in np.argwhere(thinning.thinned(ring, (True, False, False)))}
    near = lambda p: [q for s in morphology.AROUND if (q := (p[0] + s[0], p[1] + s[1], p[2] + s[2])) in left]
    assert left and all(len(near(p)) == 2 for p in left)  # one closed line
    for seed in range(4):
        before = blobs((12, 14, 16), seed)
        after = thinning.thinned(before.copy(), (False,) * 3)
        assert 0 < after.sum() < before.sum() and not (after & ~before).any() and euler(after) == euler(before)


def test_images_thinned_together_are_thinned_alone():
    rng = np.random.default_rng(2)
    images = [np.argwhere(blobs(shape, k)) + rng.integers(-9, 9, 3) for k, shape in enumerate([(6, 7, 8), (1, 9, 9), (5, 1, 12), (8, 8, 1)])] + [np.array([[2, 3, 4]])]
    for own, left in zip(images, thinning.thinned_together(images), strict=True):
        low = own.min(0)
        volume = np.zeros(own.max(0) - low + 1, bool)
        volume[tuple((own - low).T)] = True
        alone = np.argwhere(thinning.thinned(volume, tuple(bool(n == 1) for n in volume.shape), None, tuple(low))) + low
        assert sorted(map(tuple, left.tolist())) == sorted(map(tuple, alone.tolist()))


def euler(on):
    """Vertices less edges plus faces less cells of the closed voxels: pieces less tunnels plus hollows."""
    wide = np.pad(on, 1)
    total = 0
    for spans in product((0, 1), repeat=3):  # an element is held if some voxel around it is
        held = np.zeros([n - 1 for n in wide.shape], bool)
        for shift in product(*((0, 1) if not s else (0,) for s in spans)):
            held |= wide[tuple(slice(k, k + n - 1) for k, n in zip(shift, wide.shape, strict=True))]
        total += (-1) ** sum(spans) * int(held.sum())
    return total


def test_simple_points_by_search():
    def pieces(cells, near):
        out, left = [], set(cells)
        while left:
            stack = [left.pop()]
            own = set(stack)
            while stack:
                p = stack.pop()
                found = {q for q in left if near(p, q)}
                left -= found
                own |= found
                stack += found
            out.append(own)
        return out

    def searched(code):
        on = {c for n, c in enumerate(thinning.CELLS) if code >> n & 1 and any(c)}
        off = {c for c in thinning.CELLS if c not in on and 1 <= sum(map(abs, c)) <= 2}
        touching = pieces(on, lambda p, q: max(abs(a - b) for a, b in zip(p, q, strict=True)) <= 1)
        through = pieces(off, lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1)
        return len(touching) == 1 and sum(any(sum(map(abs, s)) == 1 for s in p) for p in through) == 1

    rng = np.random.default_rng(3)
    codes = np.concatenate([(rng.random((800, 27)) < share) @ (1 << np.arange(27)) for share in (0.2, 0.5, 0.85)]).astype(np.int32) | 1 << thinning.CENTRE
    assert thinning.simple(codes).tolist() == [searched(int(c)) for c in codes]


def test_tiles_are_thinned_as_the_whole(spark):
    volumes = {1: blobs((30, 34, 150), 5), 2: blobs((1, 60, 140), 6), 3: blobs((20, 20, 20), 7)}
    rows = [(i, int(z) - 7, int(r) + 100, int(c) - 70) for i, v in volumes.items() for z, r, c in np.argwhere(v)]
    df = spark.createDataFrame([*rows, (4, 0, 0, 0), (4, 90_000, -90_000, 90_000)], "image_id long, z int, r int, c int")
    whole = {tuple(r) for r in thinning.in_one_task(df.where("image_id < 4")).collect()}
    got = {tuple(r) for r in thinning.skeletons(df, box=10_000, passes=1, side=16, words=1).collect()}
    assert {r for r in got if r[0] < 4} == whole and {r for r in got if r[0] == 4} == {(4, 0, 0, 0), (4, 90_000, -90_000, 90_000)}


def test_remove_objects(spark):
    v = voxels(spark, [(0, 0), (1, 1), (5, 5)])
    assert {(r["r"], r["c"]) for r in morphology.remove_objects(v, 2).collect()} == {(0, 0), (1, 1)}


def test_objects_of_small_images_are_told_apart_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(z) - 2, 10**9 * int(r > 5) + int(r), int(c) * (-1) ** i) for i in range(6) for z, r, c in np.argwhere(rng.random((3, 9, 9)) < 0.12)]
    df = spark.createDataFrame(rows, "image_id long, z int, r int, c int")
    want = {tuple(r) for r in morphology.remove_objects(df, 3, few=0).collect()}
    monkeypatch.setattr(morphology, "components", None)
    assert {tuple(r) for r in morphology.remove_objects(df, 3).collect()} == want and 0 < len(want) < len(rows)
    assert morphology.remove_objects(df.limit(0), 3).isEmpty()


AT = [(0, 3), (1, 7), (2, 3), (3, 2), (3, 3), (3, 0), (5, 5), (6, 5), (6, 6), (6, 8), (8, 3), (5, 1), (6, 0), (7, 1), (6, 2), (1, 3), (3, 1), (4, 4), (7, 4), (6, 7)]


def test_skeleton_of_nine_by_nine(spark):
    """Twenty voxels: eight nodes, five edges and a ring."""
    assert len(set(AT)) == 20
    g = skeleton.vectorised(voxels(spark, AT))
    at = {r["id"]: (int(r["y"]), int(r["x"])) for r in g.vertices.collect()}
    assert at == {0: (0, 3), 1: (1, 7), 2: (2, 2), 3: (3, 0), 4: (5, 5), 5: (6, 8), 6: (8, 3), 7: (5, 1)}
    edges = [(r["src"], r["dst"], len(r["pts"])) for r in g.edges.orderBy("eid").collect()]
    assert edges == [(0, 2, 3), (3, 2, 3), (2, 4, 3), (4, 6, 3), (4, 5, 3), (7, 7, 5)]
    assert skeleton.voxels_of(g).count() == 20


def test_stacks_hold_every_image_of_their_label(spark, tmp_path):
    rows = [(i, i % 2, [0.4] * 64) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    slices = queries._volumes(spark, str(tmp_path)).groupBy("image_id").agg(F.sort_array(F.collect_set("z")).alias("z")).collect()
    assert {r["image_id"]: r["z"] for r in slices} == {0: list(range(12)), 1: list(range(12))}


def test_nodes_by_joins_agree_with_tracing(spark):
    ring = {(5, 1)}
    joined = {(r["r"], r["c"]) for r in skeleton.nodes(voxels(spark, AT)).collect()}
    traced = {(int(r["y"]), int(r["x"])) for r in skeleton.vectorised(voxels(spark, AT)).vertices.collect()}
    assert joined == traced - ring


def test_options_of_tracing():
    at = [(0, r, c) for r, c in AT]
    assert len(skeleton.trace(at, iso=False)[0]) == 7 and len(skeleton.trace(at, ring=False)[1]) == 5


def test_widths_and_weights(spark):
    band = np.zeros((7, 12), int)
    band[2:5] = 1
    e = spark.createDataFrame([(0, 0, 0, 1, [(0, 3, c) for c in range(12)]), (0, 1, 0, 1, [(0, 3, 3)])], "image_id long, eid long, src long, dst long, pts array<struct<z:int,r:int,c:int>>")
    out = weights.weighted(weights.pixel_widths(e, pixels(spark, band)), ["Width", "Length", "Area", "Resistance"], r_j=1.0, rho=2.0)
    rows = {r["eid"]: r for r in out.collect()}
    assert (rows[0]["width"], rows[0]["length"], rows[0]["area"], rows[0]["resistance"]) == (2.0, 12.0, 4.0, 12 * 2 / 4 + 2)
    assert rows[1]["pixel_width"] == 10 and rows[1]["width"] == 1.0 and rows[1]["perp_bisector"] is None
    with pytest.raises(TypeError):
        weights.weighted(e, "Length")
    with pytest.raises(TypeError):
        weights.weight("Colour", F.lit(3), F.lit(2))


def test_nematic_of_parallel_vectors(spark):
    v = spark.createDataFrame([(2.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    row = nematic.order_parameter(v).first()
    assert row["nematic_order"] == pytest.approx(1) and abs(row["director_x"]) == pytest.approx(1)
    assert row["qxx"] + row["qyy"] + row["qzz"] == pytest.approx(0)


def test_nematic_against_numpy(spark):
    a = np.random.default_rng(2).normal(size=(40, 3))
    row = nematic.order_parameter(spark.createDataFrame([tuple(map(float, x)) for x in a], "x double, y double, z double")).first()
    u = a / np.linalg.norm(a, axis=1)[:, None]
    value, vector = np.linalg.eigh(1.5 * (u[:, :, None] * u[:, None]).mean(0) - 0.5 * np.eye(3))
    assert row["nematic_order"] == pytest.approx(value[-1])
    assert abs(np.dot([row[f"director_{k}"] for k in "xyz"], vector[:, -1])) == pytest.approx(1)


def test_crops():
    c = geo.Crop.of([1, 3, 2, 6])
    assert geo.Crop.parse(str(c)) == c and geo.Crop.of([4, 5]).bounds == ((0, 4), (0, 5)) and geo.Crop.parse("None") is None
    assert geo.Crop.of([0.5, 3.2, 1, 2]).whole().bounds == ((0, 4), (1, 2))
    with pytest.raises(InvalidArgumentsError):
        geo.Crop.of([1, 2, 3, 4, 5, 6]).outer()
    (x0, x1), (y0, y1) = geo.rotating_crop(100, 200).bounds
    assert x1 - x0 <= 100 / 2**0.5 and (x0 + x1) / 2 == 100 and (y0 + y1) / 2 == 50


def test_angles(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)], "a double, b double")
    got = [r[0] for r in rows.select(geo.angle(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0, 90, 0, 45, 135, 45])


def png(grey):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    h, w = grey.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_slices_from_files(spark, tmp_path, image):
    for i in (280, 281, 282, 283):
        (tmp_path / f"slice{i:04d}.tiff").write_bytes(files.encoded_tiff(image + 0 * i))
    (tmp_path / "other0282.png").write_bytes(png(image))
    (tmp_path / "notes.txt").write_text("x")
    found = files.slices(spark, str(tmp_path), (280, 283), "slice", 3)
    assert sorted(r["z"] for r in found.select("z").collect()) == [281, 282]
    got = files.pixels(found.where("z = 282"))
    assert (as_array(got, image.shape) == image).all()
    assert (as_array(files.pixels(files.slices(spark, str(tmp_path), prefix="other")), image.shape) == image).all()
    with pytest.raises(ImageDirectoryError):
        files.slices(spark, str(tmp_path), prefix="absent")
    (tmp_path / "bad0001.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="cannot read"):
        files.pixels(files.slices(spark, str(tmp_path), prefix="bad")).collect()


def tiff(image, way=1, pack=bytes, ahead=1, order="<"):
    """A TIFF of one strip."""
    height, width = image.shape
    bits = image.dtype.itemsize * 8
    steps = np.diff(image, axis=1, prepend=np.zeros((height, 1), image.dtype)).astype(image.dtype) if ahead == 2 else image
    data = pack(steps.astype(steps.dtype.newbyteorder(order)).tobytes())
    tags = [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, way), (262, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(data)), (317, 3, ahead)]
    entries = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0)) for t, k, v in tags)
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(data)) + data + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)


def packed_lzw(data):
    """Codes as TIFF has them, each as wide as the reader's table asks for."""
    table, out, n = {bytes([i]): i for i in range(256)}, [(256, 9)], 258
    word = b""
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        out.append((table[word], max(9, min(12, n.bit_length()))))
        table[word + bytes([b])] = n
        n += 1
        if n == 4094:
            out.append((256, 12))
            table, n = {bytes([i]): i for i in range(256)}, 258
        word = bytes([b])
    out += [(table[word], max(9, min(12, n.bit_length()))), (257, max(9, min(12, (n + 1).bit_length())))]
    bits = "".join(format(code, f"0{width}b") for code, width in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("ahead", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_packed_tiffs(kind, ahead, order):
    image = np.random.default_rng(5).integers(0, 60, (41, 67)).astype(kind) * kind(3)
    if kind == np.uint16:
        image = image * 200
    want = image >> 8 if kind == np.uint16 else image
    for way, pack in ((1, bytes), (8, zlib.compress), (5, packed_lzw), (32773, lambda d: b"".join(bytes([len(d[i : i + 128]) - 1]) + d[i : i + 128] for i in range(0, len(d), 128)))):
        assert (files.decoded(tiff(image, way, pack, ahead, order)) == want).all()
    assert files.unpacked_bits(bytes([2, 7, 8, 9, 253, 5, 128, 0, 1])) == bytes([7, 8, 9, 5, 5, 5, 5, 1])


def test_bitmaps_and_refusals():
    image = np.random.default_rng(6).integers(0, 255, (5, 7)).astype(np.uint8)
    rows = b"".join(bytes(np.repeat(r, 3)).ljust(24, b"\0") for r in image[::-1])
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 54, 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0)
    assert (files.decoded(head + rows) == image).all()
    for content, name in ((b"\xff\xd8\xff", "JPEG"), (b"GIF89a", "GIF"), (tiff(image, 7), "LZW")):
        with pytest.raises(ValueError, match=name):
            files.decoded(content)


def test_points_with_headers(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("Name,Center Of Mass X (µm),Center Of Mass Y (µm)\na,1.5,2\nb,3,4.25\n")
    rows = files.point_csv(spark, str(tmp_path / "seeds.csv"), {"x": "Center Of Mass X (µm)", "y": "Center Of Mass Y (µm)"}).collect()
    assert sorted(map(tuple, rows)) == [(1.5, 2.0), (3.0, 4.25)]


def test_point_files(spark, tmp_path):
    (tmp_path / "p.dat").write_text("id x y\n 1  2.5   3\n 2 4 -1e1\n")
    assert [tuple(r) for r in files.point_table(spark, str(tmp_path / "p.dat"), ["i", "x", "y"]).collect()] == [(1, 2.5, 3), (2, 4, -10)]
    assert [tuple(r) for r in files.bonds(spark, str(tmp_path / "p.dat")).collect()] == [(0, 1), (1, 3)]


def test_positions_are_exported_without_edges(spark, tmp_path):
    v = spark.createDataFrame([(2, 2.0, 0.0, 1.0), (1, 1.0, 0.5, 0.0)], "id long, x double, y double, z double")
    graphs.write_positions(v, str(tmp_path))
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/vertexPositions.csv").collect()] == [("1.0", "0.5", "0.0"), ("2.0", "0.0", "1.0")]
    assert not (tmp_path / "edgeList.csv").exists()


def test_graph_files_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, 0.0, 1.0, 2.0), (1, 1.0, 1.0, 2.0)], "id long, x double, y double, z double")
    g = NetworkFrame(v, spark.createDataFrame([(0, 1)], "src long, dst long"))
    graphs.write_graph(g, str(tmp_path / "g"), {"dim": 2})
    graphs.write_graph(g, str(tmp_path / "g"), {"dim": 2}, "append", 1)
    back, options = graphs.read_graph(spark, str(tmp_path / "g"), 1)
    assert back.vertices.count() == 2 and back.edges.count() == 1 and options == {"dim": 2}
    graphs.write_csv(g, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "edgeList.csv")).collect()[0][1] == "1"
    with pytest.raises(InvalidArgumentsError):
        graphs.labelled(v, v.limit(1).select("id", F.lit(1).alias("k")), "id", "k")
    assert graphs.labelled(v, v.select("id", F.lit(1).alias("k")), "id", "k").count() == 2


def test_patches_and_masks(spark, image):
    p = learning.patches(pixels(spark, image), pixels(spark, image).where("r = 3 AND c = 4"), 1)
    assert p.first()["patch"] == pytest.approx(((image[2:5, 3:6] / 255) - 0.5).ravel())
    assert learning.augmented(p, 1).count() == 8
    out = learning.predicted(p, lambda a: np.full(len(a), 0.7)).first()
    assert out["v"] == 255
    assert {r["class"] for r in learning.as_classes(spark.createDataFrame([(5,), (9,)], "k int"), "k").collect()} == {0, 1}


def test_windows_of_several_scales_and_settings(spark, image):
    df, p = pixels(spark, image), learning.Params(half=1, scales=2, factor=3)
    got = {r["scale"]: r["patch"] for r in learning.multi_scale(df, df.where("r = 3 AND c = 4"), p).collect()}
    for scale, step in ((0, 1), (1, 3)):
        want = [image[3 + i * step, 4 + j * step] / 255 - 0.5 for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert np.allclose(got[scale], want)
    assert learning.Params.parse(p.to_ini()) == p and learning.Params.parse("[params]\nepochs = 9\nother = x").epochs == 9


def test_stored_skeletons_and_options(spark, tmp_path):
    at = [(5, c) for c in range(3, 9)] + [(9, 9)]
    graphs.write_voxels(voxels(spark, at), str(tmp_path / "skeleton"))
    g = graphs.read_skeleton(spark, str(tmp_path / "skeleton"), planar=True, giant=True)
    assert g.vertices.count() == 2 and g.edges.count() == 1
    assert graphs.read_skeleton(spark, str(tmp_path / "skeleton"), crop_to=[0, 0, 0, 2]).edges.count() == 1
    o = imaging.Options(gamma=3.0, asize=7)
    o.write(spark, str(tmp_path / "options"))
    assert imaging.Options.read(spark, str(tmp_path / "options")) == o
    with pytest.raises(InvalidArgumentsError):
        weights.weighted(spark.range(1), ["FixedWidthConductance", "VariableWidthConductance"])
    flat = spark.createDataFrame([(0.0, 1.0, 1.0)], "x double, y double, z double")
    assert nematic.angles(flat).first()["angle"] == 45.0
    with pytest.raises(TypeError):
        nematic.angles(flat.withColumn("x", F.lit(1.0)))


def as_graph(g):
    spots = lambda pts: tuple((p["z"], p["r"], p["c"]) for p in pts)
    v = {(r["image_id"], r["id"], r["z"], r["y"], r["x"], spots(r["pts"])) for r in g.vertices.collect()}
    return v, {(r["image_id"], r["eid"], r["src"], r["dst"], spots(r["pts"])) for r in g.edges.collect()}


def test_pointer_doubling_traces_as_one_task_does(spark):
    rng = np.random.default_rng(4)
    images = {0: AT_3D, 1: [(0, r, c) for r, c in AT], 2: [(0, 5, 5)], 3: [(0, 0, c) for c in range(40)]}
    images[4] = [(0, r, c) for r in range(10) for c in range(10) if r in (0, 9) or c in (0, 9)]  # one ring
    images[5] = [tuple(p) for p in np.argwhere(thinning.thinned(blobs((1, 40, 40), 8), (True, False, False)))]
    images[6] = [tuple(p) for p in np.argwhere(thinning.thinned(blobs((14, 16, 18), 9), (False,) * 3))]
    images[7] = [tuple(p) for p in np.argwhere(rng.random((1, 14, 14)) < 0.3)]
    images[8] = [(0, 0, 0), (0, 0, 1), (0, 1, 0)]  # a ring of three
    df = spark.createDataFrame([(i, *map(int, p)) for i, at in images.items() for p in at], "image_id long, z int, r int, c int")
    for options in ((False, True, True), (True, False, False)):
        assert as_graph(skeleton.by_doubling(df, *options)) == as_graph(skeleton.in_one_task(df, *options))
    mixed = skeleton.vectorised(df, few=50)
    assert as_graph(mixed) == as_graph(skeleton.in_one_task(df, False, True, True))
    nothing = skeleton.by_doubling(df.limit(0))
    assert nothing.vertices.count() == nothing.edges.count() == 0


AT_3D = [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 2), (4, 4, 2), (2, 2, 3), (2, 1, 4), (9, 9, 9)]


def test_patches_over_tiles(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (23, 31))
    areas = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 22, 30), (0, 0, 11, 16), (0, 0, 11, 16)], "image_id long, z int, r int, c int")
    got = {(r["r"], r["c"]): r["patch"] for r in learning.patches(pixels(spark, image), areas, 2, 3, tile=8).collect()}
    wide = np.pad(image / 255 - 0.5, 6)
    assert set(got) == {(0, 0), (22, 30), (11, 16)}
    for (r, c), patch in got.items():
        assert patch == pytest.approx(wide[r : r + 13 : 3, c : c + 13 : 3].ravel().tolist())
    with pytest.raises(InvalidArgumentsError):
        learning.as_classes(spark.range(learning.MOST_CLASSES + 5), "id")


def test_binary_images_as_folders(spark, tmp_path):
    both = pixels(spark, np.eye(3, dtype=int) * 255, 1).unionByName(pixels(spark, np.ones((2, 2), int), 2))
    graphs.write_pixels(both, str(tmp_path / "binary"))
    back = graphs.read_pixels(spark, str(tmp_path / "binary"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in both.collect()} and back.where("image_id = 2").count() == 4


def test_pages_alike_in_four_digits_keep_their_own_masks(spark, tmp_path):
    from meshwright.plans import queries

    spark.createDataFrame([(3,), (30003,), (10002,), (4,)], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["mask"] for r in queries.masks_by_name(spark, str(tmp_path)).collect()}
    assert got == {3: 3, 30003: -1, 10002: -1, 4: -1}


def test_widths_are_measured_in_batches_of_images(spark):
    e = spark.createDataFrame([(7, 0, [(0, 1, 0), (0, 1, 1), (0, 1, 2)]), (7, 1, [(0, 1, 2)]), (9, 0, [(0, 0, 0), (0, 0, 1)])], "image_id long, eid long, pts array<struct<z:int,r:int,c:int>>")
    pixels = spark.createDataFrame([(7, 0, r, c, 1) for r in range(3) for c in range(3)] + [(8, 0, 0, 0, 1)], "image_id long, z int, r int, c int, v int")
    got = weights.pixel_widths(e, pixels)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    assert {(r["image_id"], r["eid"]): (r["pixel_width"], r["perp_bisector"] and [*map(list, r["perp_bisector"])]) for r in got.collect()} == {
        (7, 0): (2, [[0, 0, 1], [0, 2, 1]]), (7, 1): (10, None), (9, 0): (0, [[0, 0, 1], [0, 0, 1]])}


def test_runs_of_small_images_need_no_doubling(spark, monkeypatch):
    from meshwright.plans import queries

    line = [(1, 0, 0, c) for c in range(4)]
    monkeypatch.setattr(queries.inp, "voxels", lambda *_: spark.createDataFrame(line, "image_id long, z int, r int, c int"))
    monkeypatch.setattr(skeleton, "by_doubling", None)
    assert [tuple(r) for r in queries.skeleton_runs(spark, "").collect()] == [(1, 0, 0, 0, 1, 0, 3, 4)]


def test_boxes_are_not_broadcast(spark):
    v = spark.createDataFrame([(1, 0, 0, 0)], "image_id long, z int, r int, c int")
    box = spark.createDataFrame([(1, 1, 1, 2)], "image_id long, depth int, height int, width int")
    got = morphology.dilated(v, morphology.ball(1, True), box)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString()
    assert {(r["r"], r["c"]) for r in got.collect()} == {(0, 0), (0, 1)}
