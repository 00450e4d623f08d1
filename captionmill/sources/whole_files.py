"""A data source for folders of whole files: gray frames read from frame sequences,
and a sink of one file a name.

Frame sequences are binary PGM files, which may hold any number of images one after
another; all images of a file share one header, whose comment ``# fps <rate>`` gives
the rate. So the place of every frame is known from a file's first bytes and its size,
and a long video is split into partitions of frames that are read side by side.

The sink takes rows (name, body) and appends the bodies of a name, which one task must
hold in order, to the file of that name. A task writes below ``_pending``; only when
all tasks have told the driver what they wrote do the files get their names, and what
failed tasks left goes. A folder is named by an address that all executors share.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FRAMES = "video_id string, frame_idx long, native_fps double, height int, width int, gray binary"
_ARROW = pa.schema([("video_id", pa.string()), ("frame_idx", pa.int64()), ("native_fps", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("gray", pa.binary())])
_HEADER = re.compile(rb"P5\s(?:#[^\n]*\n)*?(?:# fps ([0-9.eE+-]+)\n)?(?:#[^\n]*\n)*(\d+)\s+(\d+)\s+(\d+)\s")
SPLIT, BATCH = 32 << 20, 8 << 20  # bytes of frames in a partition and in an Arrow batch
PENDING = "_pending"


def pgm_header(content: bytes) -> tuple[int, float | None, int, int] | None:
    """(bytes of the header, rate, width, height) of an 8-bit binary PGM image."""
    m = _HEADER.match(content)
    if not m or not 0 < int(m[4]) < 256 or not int(m[2]) or not int(m[3]):
        return None
    return m.end(), float(m[1]) if m[1] else None, int(m[2]), int(m[3])


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as Spark's own readers would take it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _open(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


@dataclass
class Stretch(InputPartition):
    """Frames ``first`` to ``first + n`` of one file."""

    path: str
    first: int
    n: int


class PgmReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.split = options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self):
        fs, at = _open(self.folder)
        out = []
        for f in sorted(fs.get_file_info(pfs.FileSelector(at)), key=lambda f: f.path):
            if f.type != pfs.FileType.File or f.extension != "pgm" or not f.size:
                continue
            size, _, w, h = self._head(fs, f.path)
            each = size + w * h
            step = max(1, self.split // each)
            out += [Stretch(f.path, i, min(step, f.size // each - i)) for i in range(0, f.size // each, step)]
        return out or [Stretch("", 0, 0)]

    def _head(self, fs, path):
        with fs.open_input_file(path) as f:
            head = pgm_header(f.read(4096))
        if head is None:
            raise ValueError(f"{path} is no sequence of 8-bit binary PGM images")
        return head

    def read(self, partition):
        if not partition.n:
            return
        fs, _ = _open(self.folder)
        size, fps, w, h = self._head(fs, partition.path)
        video, each = partition.path.rsplit("/", 1)[-1].removesuffix(".pgm"), size + w * h
        step = max(1, BATCH // each)
        with fs.open_input_file(partition.path) as f:
            for i in range(partition.first, partition.first + partition.n, step):
                k = min(step, partition.first + partition.n - i)
                f.seek(i * each)
                raw = f.read(k * each)
                gray = [raw[j * each + size : (j + 1) * each] for j in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array([video] * k), pa.array(range(i, i + k), pa.int64()), pa.array([fps] * k, pa.float64()), pa.array([h] * k, pa.int32()), pa.array([w] * k, pa.int32()), pa.array(gray, pa.binary())], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (where it lies, its name)."""

    files: list


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        fs, at = _open(self.folder)
        own = f"{at}/{PENDING}/{uuid.uuid4().hex}"
        files, out, last = [], None, None
        try:
            for batch in iterator:
                for name, body in zip(batch["name"].to_pylist(), batch["body"].cast(pa.binary()).to_pylist()):
                    if out is None or name != last:
                        if out:
                            out.close()
                        if not re.fullmatch(r"[^/\x00]+", name or "") or name in (".", "..") or name.startswith("_"):
                            raise ValueError(f"no name for a file: {name!r}")
                        fs.create_dir(own)
                        files.append((f"{own}/{len(files)}", name))
                        out, last = fs.open_output_stream(files[-1][0]), name
                    out.write(body or b"")
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, at = _open(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("two tasks hold rows of one file; deal rows by name first")
        if self.overwrite:
            for f in fs.get_file_info(pfs.FileSelector(at, allow_not_found=True)):
                if f.type == pfs.FileType.File and f.base_name not in names:
                    fs.delete_file(f.path)
        for path, name in files:
            fs.move(path, f"{at}/{name}")
        self._clear(fs, at)

    def abort(self, messages):
        self._clear(*_open(self.folder))

    def _clear(self, fs, at):
        if fs.get_file_info(f"{at}/{PENDING}").type == pfs.FileType.Directory:
            fs.delete_dir(f"{at}/{PENDING}")


class PgmFrames(DataSource):
    """Frames of a folder of PGM sequences, a file a video."""

    @classmethod
    def name(cls):
        return "pgm_frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return PgmReader(self.options)


class WholeFiles(DataSource):
    """The sink of one file a name."""

    @classmethod
    def name(cls):
        return "whole_files"

    def schema(self):
        return "name string, body binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options, overwrite)


def read_frames(spark: SparkSession, folder: str, split_bytes: int = SPLIT) -> DataFrame:
    """video_id, frame_idx, native_fps, height, width and gray of a folder of PGM
    sequences. Empty files hold no frame; a cut last frame is left out; a file with
    another header is an error."""
    spark.dataSource.register(PgmFrames)
    return spark.read.format("pgm_frames").option("splitbytes", str(split_bytes)).load(qualified(spark, folder))


def write_files(bodies: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Rows (name, body) as files of a folder; a name's rows must lie in one task in order."""
    spark = bodies.sparkSession
    spark.dataSource.register(WholeFiles)
    rows = bodies.select(F.col("name").cast("string").alias("name"), F.col("body").cast("binary").alias("body"))
    rows.write.format("whole_files").mode("overwrite" if overwrite else "append").save(qualified(spark, folder))


def write_frames(frames: DataFrame, folder: str) -> None:
    """A PGM sequence for each video, frames in order of ``frame_idx``."""
    fps = F.when(F.col("native_fps").isNotNull(), F.concat(F.lit("# fps "), F.col("native_fps").cast("string"), F.lit("\n"))).otherwise("")
    header = F.concat(F.lit("P5\n"), fps, F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    rows = frames.repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
    write_files(rows.select(F.concat("video_id", F.lit(".pgm")).alias("name"), F.concat(header.cast("binary"), "gray").alias("body")), folder)
