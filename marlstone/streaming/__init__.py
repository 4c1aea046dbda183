"""Following an archive: each published segment is one more batch of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import arrow_fs
from ..sources.archive import Archive, unsealed
from ..sources.types import spark_schema


def _published(path: str, name: str):
    """Manifests -> the segments of a schema that each of them published."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(0).to_pylist():
                try:
                    manifest = unsealed(raw)
                except ValueError:
                    continue  # damaged: what it published comes with the manifest of a rebuild
                segments = manifest["schemas"].get(name, {"segments": ()})["segments"]
                found += [f"{path}/{s['path']}" for s in segments if s["number"] == manifest["number"]]
            yield pa.RecordBatch.from_pydict({"segment": pa.array(found, pa.string())})

    return run


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for segment in batch.column(0).to_pylist():
            fs, at = arrow_fs(f"{segment}.json")
            with fs.open_input_stream(at) as f:
                found += [f"{segment}/{name}" for _, name, _ in unsealed(f.read().decode())]
        yield pa.RecordBatch.from_pydict({"file": pa.array(found, pa.string())})


def _rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, at = arrow_fs(file)
                with fs.open_input_file(at) as f:
                    for part in pq.ParquetFile(f).iter_batches(columns=schema.names):
                        yield pa.RecordBatch.from_arrays([part.column(n).cast(schema.field(n).type) for n in schema.names], schema.names)

    return run


def follow(archive: Archive, name: str) -> DataFrame:
    """A stream of a schema's rows, segment by segment as they are published.

    The stream reads the archive's manifests, so writes that lose or never publish are not seen.
    Files are dealt to tasks by name. Segments that only a rebuild could recover come again with
    its manifest. Order between rows is not kept.
    """
    columns = spark_schema(archive.columns(name))
    manifests = archive.spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(f"{archive.path}/manifest")
    files = manifests.mapInArrow(_published(archive.path, name), "segment string").mapInArrow(_files, "file string")
    return files.repartition("file").mapInArrow(_rows(to_arrow_schema(columns)), columns)
