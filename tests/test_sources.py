"""The frame source, the file sink and image decoding."""

import pathlib
import zlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from captionmill.sources import images, whole_files


def frame_rows(spark, sizes):
    rows = [(v, i, 12.5 if v == "a" else None, h, w, bytes((i + k) % 256 for k in range(h * w))) for v, (n, h, w) in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, whole_files.FRAMES)


def test_frames_round_trip_in_splits(spark, tmp_path):
    rows, df = frame_rows(spark, {"a": (23, 3, 5), "b": (1, 7, 2), "ü c": (4, 1, 1)})
    whole_files.write_frames(df.repartition(5), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pgm", "b.pgm", "ü c.pgm"]
    read = whole_files.read_frames(spark, str(tmp_path), split_bytes=100)
    assert sorted(tuple(r) for r in read.collect()) == sorted((*r[:5], bytearray(r[5])) for r in rows)
    assert read.rdd.getNumPartitions() > 5
    whole_files.write_frames(df.where("video_id = 'b'"), str(tmp_path))  # overwrites the folder
    assert [p.name for p in tmp_path.iterdir()] == ["b.pgm"]


def test_odd_frame_folders(spark, tmp_path):
    assert whole_files.read_frames(spark, str(tmp_path)).count() == 0
    (tmp_path / "empty.pgm").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no frames")
    (tmp_path / "cut.pgm").write_bytes(b"P5\n2 2\n255\n1234P5\n2 2\n255\n12")
    assert [(r["video_id"], bytes(r["gray"])) for r in whole_files.read_frames(spark, str(tmp_path)).collect()] == [("cut", b"1234")]
    (tmp_path / "bad.pgm").write_bytes(b"P6\n2 2\n255\n")
    with pytest.raises(Exception, match="no sequence"):
        whole_files.read_frames(spark, str(tmp_path)).count()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "old.txt").write_text("old")
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("body").alias("body")).repartition(8)
    with pytest.raises(Exception, match="broken"):
        whole_files.write_files(rows, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["old.txt"]
    for name in ("a/b", "..", "_hidden", None):
        with pytest.raises(Exception, match="no name"):
            whole_files.write_files(spark.createDataFrame([(name, b"x")], "name string, body binary"), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["old.txt"]


def test_a_name_in_two_tasks_is_refused_and_append_keeps_files(spark, tmp_path):
    rows = spark.createDataFrame([("same", b"1"), ("same", b"2")], "name string, body binary")
    with pytest.raises(Exception, match="two tasks"):
        whole_files.write_files(rows.repartition(2), str(tmp_path))
    assert not [p for p in tmp_path.iterdir()]
    whole_files.write_files(rows.coalesce(1), str(tmp_path))
    whole_files.write_files(spark.createDataFrame([("more", None)], "name string, body binary"), str(tmp_path), overwrite=False)
    assert {p.name: p.read_bytes() for p in pathlib.Path(tmp_path).iterdir()} == {"same": b"12", "more": b""}


@pytest.mark.parametrize("shape", [(1, 1), (5, 9), (11, 3)])
def test_png_filters(shape):
    gray = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (images.decode(images.encode_png(gray)) == gray).all()


def png(colour, lines, w, h, palette=b""):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    return images.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_colours():
    assert images.decode(png(2, b"\0\xff\0\0\0\xff\0", 2, 1)).tolist() == [[76, 150]]
    assert images.decode(png(6, b"\0\xff\xff\xff\x10", 1, 1)).tolist() == [[255]]
    assert images.decode(png(4, b"\0\x07\xff", 1, 1)).tolist() == [[7]]
    assert images.decode(png(3, b"\0\1\0", 2, 1, b"\0\0\0\xff\xff\xff")).tolist() == [[255, 0]]


def test_what_cannot_be_read_is_counted(spark):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    good = images.encode_png(gray)
    flipped = good[:45] + bytes([good[45] ^ 1]) + good[46:]
    rows = [("png", good), ("pgm", b"P5\n# x\n4 3\n255\n" + gray.tobytes()), ("cut", good[:-20]), ("flip", flipped), ("short", b"P5\n4 3\n255\n12"), ("none", None), ("empty", b""), ("text", b"hello"), ("deep", b"P5\n1 1\n65535\n12")]
    seen = Observation("images")
    got = images.readable(spark.createDataFrame(rows, "name string, content binary"), seen).collect()
    assert {r["name"]: (r["height"], r["width"], bytes(r["gray"])) for r in got} == {n: (3, 4, gray.tobytes()) for n in ("png", "pgm")}
    assert seen.get == {"ok": 2, "unreadable": 5, "empty": 2}
