"""Recordings as a Spark data source: `spark.read.format("recordings")`, also as a stream.

The listing is cut into pieces of about `splitBytes`: small files share one, a
large file has several, and each task finds out from the header which windows
of audio begin in its byte range. So a long recording is cut by many tasks, no
task holds more than a few windows, only the header is read of a file that is
turned away, and nothing at all of one above the size limit. Every file gives
rows: its windows, or one row with an error; an empty file is one without a
header. (Spark's own file scans pass over empty files.)

A mono recording of whole numbers is cut anywhere. Files of several channels
are scaled by the peak of the whole and float samples must all be finite, so
those files are read twice, block by block, by the task of their first piece.
"""

from __future__ import annotations

import dataclasses
import json
import posixpath
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.constants import SegmentSpec
from shoalsong.sources import wav

SPLIT_BYTES = 64 << 20
#: Bytes of a file that are read at once, and bytes of windows that leave a task at once.
BLOCK_BYTES, BATCH_BYTES = 8 << 20, 4 << 20

FILE_SCHEMA = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    *schemas.WAV_HEADER.fields,
])


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder, given as a path or a URI."""
    uri = re.sub(r"^s3a:", "s3:", path) if re.match(r"\w[\w+.-]*:", path) else "file://" + path
    return fs.FileSystem.from_uri(uri)


def listing(path: str) -> list[tuple[str, int]]:
    """(path below the folder, size) of all .wav files, by path. The folder may be missing."""
    system, root = open_folder(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = root.rstrip("/") + "/"
    return sorted((i.path.removeprefix(prefix), i.size) for i in found
                  if i.type == fs.FileType.File and i.path.endswith(".wav"))


@dataclasses.dataclass
class Piece:
    """The bytes [begin, end) of a file; the first piece of a file begins at 0, and speaks for it."""

    name: str
    size: int
    begin: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces


def plan(files: list[tuple[str, int]], split_bytes: int, whole: bool = False) -> list[Pieces]:
    """The files cut and put together into partitions of about `split_bytes`. A file counts 4 KB at
    least, as opening it takes time; `whole` files count no more than that."""
    partitions, held, total = [], [], 0
    for name, size in files:
        step = size if whole else split_bytes
        for begin in range(0, max(size, 1), max(step, 1)):
            piece = Piece(name, size, begin, min(size, begin + step))
            held.append(piece)
            total += max(4096, 0 if whole else piece.end - piece.begin)
            if total >= split_bytes:
                partitions.append(Pieces(held))
                held, total = [], 0
    return partitions + ([Pieces(held)] if held or not partitions else [])


class FileBytes:
    """Bytes of an open file by slices; only what is asked for is read."""

    def __init__(self, file) -> None:
        self.file = file

    def __getitem__(self, part: slice) -> bytes:
        start = part.start or 0
        return self.file.read_at(max(part.stop - start, 0), start)


def verdict(header: dict, spec: SegmentSpec) -> dict:
    """The header with num_segments and n_resampled, and with an error if the duration is out of bounds."""
    if header.get("error_code"):
        return header
    frames, rate = header["frames"], header["sample_rate"]
    seconds = frames / rate
    resampled = frames if rate == spec.rate else int(np.floor(frames / rate * spec.rate))
    count = resampled // spec.samples
    if seconds < spec.min_seconds or (count == 0 and seconds <= spec.max_seconds):
        return {**header, "error_code": C.AUDIO_TOO_SHORT, "error": f"{seconds:.2f} s, at least {spec.min_seconds:.2f} s required"}
    if seconds > spec.max_seconds:
        return {**header, "error_code": C.AUDIO_TOO_LONG, "error": f"{seconds:.2f} s, at most {spec.max_seconds:.2f} s allowed"}
    return {**header, "n_resampled": resampled, "num_segments": count}


def head_of(file, size: int) -> dict:
    return wav.judge(wav.find_chunks(FileBytes(file), size))


class Signal:
    """The mono signal of an open file, read by ranges of frames."""

    def __init__(self, file, header: dict) -> None:
        self.file, self.header = file, header
        self.width = header["channels"] * header["bits"] // 8
        self.peak = None
        if self.one_task(header):
            self._look()

    @staticmethod
    def one_task(header: dict) -> bool:
        return header["channels"] > 1 or header["audio_format"] == wav.IEEE_FLOAT

    def _bytes(self, first: int, last: int) -> bytes:
        return self.file.read_at((last - first) * self.width, self.header["data_offset"] + first * self.width)

    def _look(self) -> None:
        """Go through the file once: the peak of mixed channels, and whether all samples are numbers."""
        step, peak = max(1, BLOCK_BYTES // self.width), 0.0
        for first in range(0, self.header["frames"], step):
            mixed = self._mixed(self._bytes(first, min(first + step, self.header["frames"])))
            if not np.isfinite(mixed).all():
                raise ValueError("samples are not finite numbers")
            peak = max(peak, float(np.abs(mixed).max(initial=0.0)))
        self.peak = peak

    def _mixed(self, data: bytes):
        bits, kind, channels = (self.header[k] for k in ("bits", "audio_format", "channels"))
        if channels == 1:
            return wav.scaled(data, bits, kind, compat=False)
        return wav.integers(data, bits, kind, compat=False)[0].reshape(-1, channels).mean(axis=1, dtype=np.float64)

    def frames(self, first: int, last: int):
        mixed = self._mixed(self._bytes(first, last))
        if self.header["channels"] > 1 and self.peak:
            mixed = mixed / self.peak
        return mixed.astype(np.float32)

    def windows(self, first: int, last: int, spec: SegmentSpec) -> Iterator:
        """Windows [first, last), a block of the file at a time."""
        rate, target, size = self.header["sample_rate"], spec.rate, spec.samples
        frames = self.header["frames"]
        step = max(1, BLOCK_BYTES // max(1, self.width * (size * rate // target + 2)))
        for i in range(first, last, step):
            stop = min(i + step, last)
            begin = i * size * rate // target
            end = min(frames, -(-stop * size * rate // target) + 2)
            signal = self.frames(begin, end)
            for k in range(i, stop):
                if rate == target:
                    yield signal[k * size - begin:(k + 1) * size - begin]
                else:
                    at, share = wav.grid_of(rate, target, k * size, (k + 1) * size)
                    yield wav.interpolate(signal, at - begin, share)


def windows_of(piece: Piece, header: dict, spec: SegmentSpec) -> range:
    """The windows whose first frame begins in the piece."""
    if Signal.one_task(header):
        return range(header["num_segments"] if piece.begin == 0 else 0)
    width = header["bits"] // 8

    def place(i: int) -> int:
        return header["data_offset"] + i * spec.samples * header["sample_rate"] // spec.rate * width

    every = range(header["num_segments"])
    return range(bisect_left(every, piece.begin, key=place), bisect_left(every, piece.end, key=place))


class _Settings:
    """The options of a scan, as strings or numbers in any case."""

    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.rows = options.get("rows", "segments")
        if self.rows not in ("segments", "files"):
            raise ValueError(f"rows must be segments or files, not {self.rows}")
        base = C.CURRENT_SPEC
        self.spec = SegmentSpec(
            int(options.get("rate", base.rate)), float(options.get("seconds", base.seconds)),
            float(options.get("minseconds", base.min_seconds)), float(options.get("maxseconds", base.max_seconds)))
        self.max_bytes = int(options.get("maxbytes", C.MAX_FILE_BYTES))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.log = options.get("log")
        self.files_per_batch = int(options["maxfilespertrigger"]) if "maxfilespertrigger" in options else None

    def partitions(self, files: list[tuple[str, int]]) -> list[Pieces]:
        # Of a file that is too large nothing is read, so it is not cut.
        if self.rows == "files":
            return plan(files, self.split_bytes, whole=True)
        large = [f for f in files if f[1] > self.max_bytes]
        return plan([f for f in files if f[1] <= self.max_bytes], self.split_bytes) + (
            plan(large, self.split_bytes, whole=True) if large else [])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(self.path)
        rows = self._file_rows(system, root, partition) if self.rows == "files" else self._segment_rows(system, root, partition)
        schema = _arrow(FILE_SCHEMA if self.rows == "files" else schemas.SEGMENT)
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += 64 if self.rows == "files" or row[2] is None else 4 * len(row[2])
            if size >= BATCH_BYTES:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    def _head(self, system, root, piece: Piece) -> dict:
        if piece.size > self.max_bytes:
            return {"error_code": C.FILE_TOO_LARGE, "error": f"File exceeds {self.max_bytes} byte limit"}
        with system.open_input_file(posixpath.join(root, piece.name)) as file:
            return head_of(file, piece.size)

    def _file_rows(self, system, root, partition):
        for piece in partition.pieces:
            try:
                head = self._head(system, root, piece)
            except Exception as problem:
                head = {"error": str(problem), "error_code": C.PROCESSING_FAILED}
            yield (piece.name, posixpath.join(root, piece.name), piece.size, *[head.get(f.name) for f in schemas.WAV_HEADER.fields])

    def _segment_rows(self, system, root, partition):
        spec = self.spec
        for piece in partition.pieces:
            head, speaks = {}, piece.begin == 0  # the first piece speaks for the file, a fault in a later one for itself
            try:
                head = verdict(self._head(system, root, piece), spec)
                if not head.get("error_code"):
                    speaks = True
                    with system.open_input_file(posixpath.join(root, piece.name)) as file:
                        own = windows_of(piece, head, spec)
                        windows = Signal(file, head).windows(own.start, own.stop, spec) if own else ()
                        for i, window in zip(own, windows):
                            yield (piece.name, i, window, spec.rate, head["sample_rate"], head["n_resampled"] / spec.rate,
                                   head["num_segments"], None, None)
            except Exception as problem:
                head = {**head, "error": str(problem), "error_code": C.PROCESSING_FAILED}
            if speaks and head.get("error_code"):
                yield (piece.name, None, None, spec.rate, head.get("sample_rate"), None, None, head["error_code"], head["error"])


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "array<float>": pa.list_(pa.float32())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class RecordingReader(DataSourceReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings = settings

    def partitions(self) -> list[Pieces]:
        return self.settings.partitions(listing(self.settings.path))

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.settings.read(partition)


class RecordingStream(DataSourceStreamReader):
    """New files, whenever they appear and however old they say they are.

    Option `log` names a folder that holds what each batch takes, as one small
    file per batch: a batch that is repeated after a fault takes the same files,
    and a file is taken once. It belongs to one query, like its checkpoint.
    """

    def __init__(self, settings: _Settings) -> None:
        if not settings.log:
            raise ValueError("a stream of recordings needs the option log, a folder of its own")
        self.settings = settings
        self.seen: set[str] = set()
        self.last = 0

    def _entry(self, number: int) -> str:
        return f"{number:09d}.json"

    def _catch_up(self, system, root) -> None:
        while system.get_file_info(posixpath.join(root, self._entry(self.last + 1))).type == fs.FileType.File:
            self.last += 1
            self.seen.update(name for name, _ in self._files(system, root, self.last))

    def _files(self, system, root, number: int) -> list[tuple[str, int]]:
        with system.open_input_stream(posixpath.join(root, self._entry(number))) as file:
            return [tuple(x) for x in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        system, root = open_folder(self.settings.log)
        system.create_dir(root, recursive=True)
        self._catch_up(system, root)
        new = [f for f in listing(self.settings.path) if f[0] not in self.seen][: self.settings.files_per_batch]
        if new:
            entry = posixpath.join(root, self._entry(self.last + 1))
            with system.open_output_stream(entry + ".tmp") as file:
                file.write(json.dumps(new).encode())
            system.move(entry + ".tmp", entry)
            self._catch_up(system, root)
        return {"batch": self.last}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        system, root = open_folder(self.settings.log)
        files = [f for n in range(start["batch"] + 1, end["batch"] + 1) for f in self._files(system, root, n)]
        return self.settings.partitions(files)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.settings.read(partition)


class RecordingSource(DataSource):
    """Options: path; rows, segments (`schemas.SEGMENT`) or files (one row per file with what its header
    says); rate, seconds, minSeconds, maxSeconds; maxBytes; splitBytes; log and maxFilesPerTrigger of a stream."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self):
        return schemas.SEGMENT if _Settings(self.options).rows == "segments" else FILE_SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(_Settings(self.options))

    def streamReader(self, schema) -> RecordingStream:
        return RecordingStream(_Settings(self.options))


def _options(spec: SegmentSpec | None, options: dict) -> dict:
    given = {} if spec is None else {
        "rate": spec.rate, "seconds": spec.seconds, "minSeconds": spec.min_seconds, "maxSeconds": spec.max_seconds}
    return {**given, **options}


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per .wav file below the folder, empty ones too: its length and what its header says."""
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recordings").options(rows="files", **options).load(path)


def read_segments(spark: SparkSession, path: str, spec: SegmentSpec | None = None, **options) -> DataFrame:
    """One row per window of every file, or one with an error, as `analysis.segments_of` gives."""
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recordings").options(**_options(spec, options)).load(path)


def stream_segments(spark: SparkSession, path: str, log: str, spec: SegmentSpec | None = None, **options) -> DataFrame:
    """The same of files as they appear; `log` is a folder for this query alone."""
    spark.dataSource.register(RecordingSource)
    return spark.readStream.format("recordings").options(log=log, **_options(spec, options)).load(path)
