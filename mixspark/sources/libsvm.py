"""libsvm text in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mixspark.sources.scratch import shared_file
from mixspark.sources.views import vector_view

# Bytes of a file that one task reads, bytes read at a time, and rows of an Arrow batch.
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 4096
ROWS = "key string, label double, features array<double>, width int"


def lines(file, start: int, end: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end) of an open file."""
    base, rest, skip = max(0, start - 1), b"", start > 0  # what stands before the first line's beginning
    file.seek(base)
    while True:
        data = file.read(block)
        chunk, at = rest + data, 0
        while (stop := chunk.find(b"\n", at)) >= 0:
            if skip:
                skip = False
            elif base + at >= end:
                return
            else:
                yield base + at, chunk[at:stop]
            at = stop + 1
        base, rest = base + at, chunk[at:]
        if not data:
            if rest and not skip and base < end:
                yield base, rest
            return


def parsed(line: bytes, width: int) -> tuple[float, list[float], int]:
    """Label, the first ``width`` features and the highest index of a line."""
    label, *cells = line.split()
    features, last = [0.0] * width, 0
    for cell in cells:
        index, _, value = cell.partition(b":")
        i = int(index)
        if i <= last:
            raise ValueError(f"indices of a line must ascend from 1: {line[:80]!r}")
        if i <= width:
            features[i - 1] = float(value)
        last = i
    return float(label), features, last


class Split(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))


class LibsvmReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.width = int(options.get("width", "0"))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        system, path = shared_file(self.path, "")
        root = system.get_file_info(path.rstrip("/"))
        found = [root] if root.type == fs.FileType.File else system.get_file_info(
            fs.FileSelector(path.rstrip("/"), recursive=True))
        files = sorted((f.path[len(root.path):], f.size) for f in found
                       if f.type == fs.FileType.File and f.base_name[0] not in "._")
        return [Split(name, at, min(size, at + self.split)) for name, size in files
                for at in range(0, size, self.split)] or [Split("", 0, 0)]

    def read(self, partition):
        name, start, end = partition.value
        if end == 0:
            return
        system, path = shared_file(self.path + name, "")
        rows = []
        with system.open_input_file(path.rstrip("/")) as file:
            for at, line in lines(file, start, end):
                if line.strip() and not line.startswith(b"#"):
                    rows.append((f"{name.lstrip('/')}:{at}", *parsed(line, self.width)))
                    if len(rows) == BATCH_ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        types = (pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "label", "features", "width"])


class Libsvm(DataSource):
    """libsvm text whose rows know the file and the place in it where they begin."""

    @classmethod
    def name(cls):
        return "libsvm_places"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return LibsvmReader(self.options)


def read_libsvm(spark: SparkSession, path, n_cats: int, num_features: int | None = None,
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Mixed view of a libsvm dataset. The key of a row is its file's name under ``path`` and the byte where
    its line begins: keys need no shuffle, equal rows differ in them, and neither partitions nor the size
    of splits change them. Give ``num_features`` where it is known: without it the data are read once more
    to find the width, and splits may disagree."""
    spark.dataSource.register(Libsvm)
    source = spark.read.format("libsvm_places").option("splitBytes", split_bytes)
    if num_features is None:
        num_features = source.load(path).agg(F.max("width")).first()[0] or 0
    rows = source.option("width", int(num_features)).load(path)
    return vector_view(rows, n_cats, "key")


def sibling_path(path: str, split: str) -> str:
    """Path of the dev or test set that belongs to a train set: its last part with another word."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return folder + slash + name.replace("train", split)


def read_splits(spark: SparkSession, train: str, n_cats: int, num_features: int,
                dev: str | None = None, test: str | None = None) -> DataFrame:
    """Train, dev and test sets of one width as a single view with a ``split`` column. The dev and
    test paths follow from the train path unless given."""
    paths = {
        "train": train,
        "dev": dev or sibling_path(train, "dev"),
        "test": test or sibling_path(train, "test"),
    }
    out = None
    for split, path in paths.items():
        part = read_libsvm(spark, path, n_cats, num_features).withColumn("split", F.lit(split))
        part = part.withColumn("key", F.concat_ws(":", "split", "key"))
        out = part if out is None else out.unionByName(part)
    return out


def libsvm_rows(view: DataFrame, extra=()) -> DataFrame:
    """(label, features) with categoricals first, then numerics, then any extra columns."""
    parts = [F.col("cats").cast("array<double>"), F.col("nums")]
    if extra:
        parts.append(F.array(*[F.col(c).cast("double") for c in extra]))
    return view.select(
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.concat(*parts)).alias("features"),
    )


def write_libsvm(view: DataFrame, path: str, mode: str = "errorifexists") -> None:
    libsvm_rows(view).write.format("libsvm").mode(mode).save(path)


def scored_rows(scored: DataFrame) -> DataFrame:
    """Scored rows as plain columns: label, features with the score last."""
    return scored.select(
        "key",
        F.col("label").cast("double").alias("label"),
        F.concat(
            F.col("cats").cast("array<double>"), F.col("nums"), F.array(F.col("score"))
        ).alias("features"),
    )


def export_scored(scored: DataFrame, path: str, fmt: str = "parquet",
                  mode: str = "errorifexists") -> None:
    """Write scored rows with their true label, as Parquet or libsvm."""
    if fmt == "libsvm":
        libsvm_rows(scored, extra=("score",)).write.format("libsvm").mode(mode).save(path)
    else:
        scored_rows(scored).write.format(fmt).mode(mode).save(path)
