import numpy as np
import pytest

from treeline.__main__ import arguments, main
from treeline.model import POINTS
from treeline.sources import config, matrix, sequence


@pytest.fixture
def square(tmp_path):
    path = str(tmp_path / "square.bin")
    matrix.write_matrix(path, np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 2.0], [1.2, 2.0]]))
    return path


def test_matrix_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).random((1000, 7))
    path = str(tmp_path / "m.bin")
    matrix.write_matrix(path, x)
    matrix.register(spark)
    got = spark.read.format("treeline_matrix").option("partitionRows", 130).load(path)
    assert got.rdd.getNumPartitions() == 8
    rows = got.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1000)) and np.array_equal(np.array([r.coords for r in rows]), x)
    assert np.array_equal(np.array([r.coords for r in matrix.read_matrix(spark, path).orderBy("id").collect()]), x)
    some = spark.read.format("treeline_matrix").options(rows=10, dims=2).load(path).orderBy("id").collect()
    assert np.array_equal(np.array([r.coords for r in some]), x[:10, :2])


@pytest.mark.parametrize("damage", [b"", b"\x01\x00", b"\x02\x00\x00\x00\x01\x00\x00\x00" + b"\0" * 8])
def test_damaged_matrices_are_refused(tmp_path, damage):
    path = tmp_path / "bad.bin"
    path.write_bytes(damage)
    with pytest.raises(matrix.MatrixError):
        matrix.header(str(path))


def test_too_large_a_prefix_is_refused(square):
    for options in ({"rows": "5"}, {"dims": "3"}):
        with pytest.raises(matrix.MatrixError):
            matrix.MatrixReader({"path": square} | options)
    assert [(p.start, p.stop) for p in matrix.MatrixReader({"path": square, "rows": "3", "partitionrows": "2"}).partitions()] == [(0, 2), (2, 3)]


def test_properties(tmp_path):
    path = tmp_path / "c"
    path.write_text("# no\nspark.a=1\nspark.b : x\\\n  y\n! no\nother=2\nbare\n")
    assert config.read_properties(str(path)) == {"spark.a": "1", "spark.b": "xy", "other": "2", "bare": ""}


def test_command_line(spark, square, tmp_path, capsys):
    assert main([square, "--splits", "3", "--out", str(tmp_path / "edges"), "--show", "1"]) == 0
    assert "edges=3 weight=4.354066" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        arguments([])


def test_points_are_written_as_a_matrix(spark, tmp_path):
    x = np.random.default_rng(4).random((1500, 5))
    points = spark.createDataFrame([(3 * k, row.tolist()) for k, row in enumerate(x)], POINTS).repartition(6)
    path = str(tmp_path / "m.bin")
    matrix.write_points(points, path)
    assert matrix.header(path) == (1500, 5)
    assert np.array_equal(np.array([r.coords for r in matrix.read_matrix(spark, path).orderBy("id").collect()]), x)
    matrix.write_points(points.limit(0), path)
    assert matrix.header(path) == (0, 0)
    with pytest.raises(matrix.MatrixError):
        matrix.write_points(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], POINTS), path)


def test_sequence_files(spark, tmp_path):
    x = np.random.default_rng(5).random((700, 6))
    points = spark.createDataFrame([(3 * k, row.tolist()) for k, row in enumerate(x)], POINTS).repartition(3)
    for kind in ("none", "record", "block"):
        folder = (tmp_path / kind).as_uri()
        sequence.write_points(points, folder, kind)
        rows = sequence.read_points(spark, folder).orderBy("id").collect()
        assert [r.id for r in rows] == [3 * k for k in range(700)] and np.array_equal(np.array([r.coords for r in rows]), x)
    sizes = {kind: sum(f.stat().st_size for f in (tmp_path / kind).iterdir() if f.name.startswith("part-")) for kind in ("none", "block")}
    assert sizes["block"] < sizes["none"]
    assert len(list((tmp_path / "none").glob("part-*"))) == 3
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], POINTS)
    sequence.write_points(odd, (tmp_path / "odd").as_uri())
    assert sorted((r.id, r.coords) for r in sequence.read_points(spark, (tmp_path / "odd").as_uri()).collect()) == [(1, [1.0, 2.0]), (2, [])]
    with pytest.raises(Exception, match="long"):
        sequence.write_points(spark.createDataFrame([(1 << 31, [1.0])], POINTS), (tmp_path / "wide").as_uri())


def test_sequence_files_of_a_class_of_their_own(spark, tmp_path):
    """Values of another class are read as bytes: an id, a length and so many doubles, all big-endian."""
    import struct

    short, sync = (lambda b: bytes([len(b)]) + b), bytes(range(16))
    # Of the class only the name matters, which must be one that is on the class path.
    head = b"SEQ\x06" + short(b"org.apache.hadoop.io.NullWritable") + short(b"org.apache.hadoop.io.ObjectWritable") + b"\0\0" + struct.pack(">i", 0) + sync
    for k in range(3):
        body = b""
        for i in range(k, 300, 3):
            value = struct.pack(">ii2d", i, 2, i / 7, -float(i))
            body += struct.pack(">ii", len(value), 0) + value + (struct.pack(">i", -1) + sync if i % 10 == 0 else b"")
        (tmp_path / f"part-{k:05d}").write_bytes(head + body)
    rows = sequence.read_points(spark, tmp_path.as_uri(), split_bytes=500).orderBy("id").collect()
    assert [(r.id, r.coords) for r in rows] == [(i, [i / 7, -float(i)]) for i in range(300)]
    (tmp_path / "part-00003").write_bytes(head + struct.pack(">ii", 5, 0) + b"abcde")
    with pytest.raises(Exception, match="no point"):
        sequence.read_points(spark, tmp_path.as_uri()).collect()
    (tmp_path / "part-00003").write_bytes(head + struct.pack(">ii", 500, 0) + b"abcde")
    with pytest.raises(Exception, match="EOF"):
        sequence.read_points(spark, tmp_path.as_uri()).collect()


def test_split_command(spark, square, tmp_path, capsys):
    assert main(["split", square, "--splits", "2", "--out", str(tmp_path / "s"), "--show", "1", "--sample", "2"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out == ["0: [0.00, 0.00]", "1: [2.00, 0.00]", "0: [0.00, 0.00] || 0: [0.00, 0.00]", "split=0 points=2", "split=1 points=2"]


def test_sweep_command(spark, capsys):
    assert main(["sweep", "--points", "60", "--dims", "2", "3", "--splits", "1", "3", "--fanin", "2"]) == 0
    got = [eval(x) for x in capsys.readouterr().out.splitlines()]
    assert len(got) == 4 and {x["edges"] for x in got} == {59} and got[0]["weight"] == got[1]["weight"]


@pytest.mark.parametrize(("n", "d"), [(1000, 7), (37, 1), (64, 63), (1, 5), (2500, 2)])
def test_matrix_by_ranges_of_a_file(spark, tmp_path, n, d):
    x = np.random.default_rng(n).random((n, d))
    path = tmp_path / "m.bin"
    matrix.write_matrix(str(path), x)
    got = matrix.read_matrix(spark, path.as_uri(), split_bytes=1 << 10).orderBy("id").collect()
    assert [r.id for r in got] == list(range(n)) and np.array_equal(np.array([r.coords for r in got]), x)
    some = matrix.read_matrix(spark, str(path), rows=1, dims=1).collect()
    assert [(r.id, r.coords) for r in some] == [(0, [x[0, 0]])]


def test_matrix_ranges_are_several_tasks(spark, tmp_path):
    path = tmp_path / "m.bin"
    matrix.write_matrix(str(path), np.zeros((4000, 8)))
    assert matrix._ranges(spark, path.as_uri(), 4000, 8, 0, 1 << 15).rdd.getNumPartitions() >= 7
    assert matrix.record_words(37, 1) == 38 and matrix.record_words(1000, 7) == 1 and matrix.record_words(1000, 3) == 3001


def test_matrix_folders(spark, tmp_path):
    x = np.random.default_rng(6).random((700, 3))
    points = spark.createDataFrame([(5 * k, row.tolist()) for k, row in enumerate(x)], POINTS).repartition(5)
    uri = (tmp_path / "folder").as_uri()
    matrix.write_parts(points, uri, 3)
    assert sorted(p.name for p in (tmp_path / "folder").iterdir() if p.suffix == ".bin") == ["part-00000.bin", "part-00001.bin", "part-00002.bin"]
    got = matrix.read_matrix(spark, uri, rows=600, dims=2).orderBy("id").collect()
    assert [r.id for r in got] == list(range(600)) and np.array_equal(np.array([r.coords for r in got]), x[:600, :2])
    (tmp_path / "folder" / "part-00003.bin").write_bytes(b"\x01\x00")
    for bad, options in ((uri, {}), (str(tmp_path / "none"), {}), ((tmp_path / "folder" / "part-00000.bin").as_uri(), {"rows": 9999}), ((tmp_path / "folder" / "part-00000.bin").as_uri(), {"dims": 4})):
        with pytest.raises(matrix.MatrixError):
            matrix.read_matrix(spark, bad, **options)
