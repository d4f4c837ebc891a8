"""Files of frames, written here by the format's layout."""

import numpy as np
import pytest

from meshwright.operators import points
from meshwright.sources import trajectories as tr


def write(path, frames, version):
    """Frames as dictionaries of arrays by chunk name."""
    names = list(dict.fromkeys(n for f in frames for n in f))
    kinds = {np.dtype(v): k for k, v in tr.KINDS.items()}
    body, entries = b"", []
    for k, frame in enumerate(frames):
        for name, value in frame.items():
            value = value.reshape(len(value), -1)
            entries.append((k, len(value), tr.HEADER.size + len(body), value.shape[1], names.index(name), kinds[value.dtype], 0))
            body += value.tobytes()
    text = b"".join(n.encode() + b"\0" for n in names) if version >= 0x20000 else b"".join(n.encode().ljust(tr.NAME, b"\0") for n in names)
    text = text.ljust(-(-len(text) // tr.NAME) * tr.NAME, b"\0")
    table = np.array([*entries, (0, 0, 0, 0, 0, 0, 0)], tr.ENTRY)
    at = tr.HEADER.size + len(body)
    head = tr.HEADER.pack(tr.MAGIC, at, len(table), at + table.nbytes, len(text) // tr.NAME, 0, version, b"test", b"points", b"")
    path.write_bytes(head + body + table.tobytes() + text)


@pytest.fixture(params=[0x10000, 0x20000])
def file(request, tmp_path):
    rng = np.random.default_rng(2)
    frames = []
    for k, n in enumerate((5, 5, 7, 4)):
        f = {tr.COUNT: np.array([n], "<u4"), tr.POSITION: rng.random((n, 3)).astype("<f4")}
        if k == 0:
            f |= {tr.BOX: np.array([2, 3, 4, 0, 0, 0], "<f4")}
        if k == 2:
            f |= {tr.TYPE: np.arange(n, dtype="<u4")}
        frames.append(f)
    path = tmp_path / "frames.bin"
    write(path, frames, request.param)
    return str(path), frames


def test_frames_are_read_side_by_side(spark, file):
    path, frames = file
    df = tr.frames_of(spark, path, size=1)
    assert df.rdd.getNumPartitions() == 4
    want = {(k, i, i if k == 2 else 0, *map(float, p), 2.0, 3.0, 4.0) for k, f in enumerate(frames) for i, p in enumerate(f[tr.POSITION])}
    assert {tuple(r) for r in df.collect()} == want
    assert spark.read.format("particle_frames").load(path).rdd.getNumPartitions() == 1
    assert df.where("frame > 1 AND frame <= 2").count() == 7
    few = spark.read.format("particle_frames").schema("x double, frame int").load(path)
    assert sorted(map(tuple, few.collect())) == sorted((float(p[0]), k) for k, f in enumerate(frames) for p in f[tr.POSITION])
    near = points.cutoff_graph(df, 0.6, ("frame",))
    assert near.count() == sum(int((np.linalg.norm(p[i] - p[j]) <= 0.6)) for f in frames for p in [f[tr.POSITION].astype(float)] for i in range(len(p)) for j in range(i))


def test_filters_on_frames_are_taken_over(file):
    path, _ = file
    schema = tr.StructType().add("frame", "integer").add("pid", "long")
    reader = tr.FrameReader(path, 1, schema)
    rest = tr.GreaterThan(("pid",), 1)
    assert [*reader.pushFilters([tr.GreaterThanOrEqual(("frame",), 1), tr.LessThan(("frame",), 3), rest])] == [rest]
    assert [[k for k, _ in p.held] for p in reader.partitions()] == [[1], [2]]
    reader = tr.FrameReader(path, 1, schema)
    assert [*reader.pushFilters([tr.EqualTo(("frame",), 9)])] == [] and [p.held for p in reader.partitions()] == [[]]


def test_other_files_and_columns_are_refused(tmp_path, file):
    (tmp_path / "other").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no file of frames"):
        tr.index(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no columns"):
        tr.FrameReader(file[0], 1, tr.StructType().add("velocity", "double"))
