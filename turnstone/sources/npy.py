"""NumPy's .npy files as a Spark data source: rows of a matrix, read by byte ranges."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def header(raw) -> tuple[np.dtype, int, int, int]:
    """(type, rows, columns, where the rows begin); matrices of plain numbers in row order only."""
    if raw.read(6) != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    version = raw.read(2)[0]
    size = 2 if version == 1 else 4
    length = int.from_bytes(raw.read(size), "little")
    head = ast.literal_eval(raw.read(length).decode("utf-8" if version > 2 else "latin-1"))
    kind, shape = np.dtype(head["descr"]), head["shape"]
    if head["fortran_order"] and len(shape) > 1 or kind.kind not in "fiu" or not 1 <= len(shape) <= 2:
        raise ValueError(f"a matrix of numbers in row order is needed, not {head}")
    return kind, shape[0], shape[1] if len(shape) == 2 else 1, 8 + size + length


class Rows(InputPartition):
    """Rows of a file from `first`; `ahead` are those of the files before it."""

    def __init__(self, path: str, first: int, stop: int, ahead: int):
        self.path, self.first, self.stop, self.ahead = path, first, stop, ahead


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes, self.batch = options["path"], int(options.get("range_bytes", 32 << 20)), int(options.get("batch_rows", 1024))

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.path)
        at = store.get_file_info(path)
        found = sorted(f.path for f in store.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".npy")) if at.type == pafs.FileType.Directory else [path]
        out, ahead = [], 0
        for name in found:
            with store.open_input_file(name) as raw:
                kind, n, width, _ = header(raw)
            step = max(1, self.range_bytes // max(1, width * kind.itemsize))
            out += [Rows(name, a, min(n, a + step), ahead) for a in range(0, n, step)]
            ahead += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as raw:
            kind, _, width, start = header(raw)
            for a in range(partition.first, partition.stop, self.batch):
                n = min(self.batch, partition.stop - a)
                data = raw.read_at(n * width * kind.itemsize, start + a * width * kind.itemsize)
                values = np.frombuffer(data, kind).astype(np.float32)
                vec = pa.FixedSizeListArray.from_arrays(pa.array(values), width).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n) + partition.ahead), vec], names=["id", "vec"])


class Npy(DataSource):
    """spark.read.format("npy").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(dict(self.options))


def read_npy(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """id (the row's number), vec."""
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("range_bytes", str(range_bytes)).load(path)


def write_npy(matrix: DataFrame, folder: str, rows: int = 1 << 18) -> None:
    """id, vec as float32 rows of .npy files of up to `rows` rows, names in order of ids: one or more for each task, each put in its place whole."""
    dim = matrix.select(F.size("vec")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        task, n, held = TaskContext.get(), 0, []

        def write() -> None:
            name = f"{path}/part-{task.partitionId():06d}-{n:04d}"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                np.lib.format.write_array(out, np.concatenate(held), allow_pickle=False)
            if store.get_file_info(f"{name}.npy").type != pafs.FileType.NotFound:  # of an earlier attempt
                store.delete_file(f"{name}.npy")
            store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.npy")

        store.create_dir(path, recursive=True)
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                held.append(np.array(part.column(0).to_pylist(), dtype="<f4").reshape(len(part), dim[0]))
                if sum(map(len, held)) >= rows:
                    write()
                    n, held = n + 1, []
        if held:
            write()
        yield pa.RecordBatch.from_arrays([pa.array([n + bool(held)], pa.int64())], names=["files"])

    matrix.repartitionByRange("id").sortWithinPartitions("id").select("vec").mapInArrow(run, "files long").agg(F.sum("files")).collect()
