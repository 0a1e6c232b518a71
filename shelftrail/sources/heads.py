"""A data source that lists files and reads no more than the beginning of each.

    spark.dataSource.register(FileHeads)
    spark.read.format("file_heads").option("path", folder).option("bytes", 12).load()

gives path, size, head and error. Folders are listed on the driver, file names only; files are opened by tasks, `files` at a
time, so memory follows neither their size nor their number in a task. A file that cannot be read has an error and no head.
The folder is a path or URI that Arrow opens: local, S3, GCS, HDFS.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, head binary, error string"
FILES_PER_TASK = 1_000


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        super().__init__(None)
        self.paths = paths


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.bytes, self.files = options["path"], int(options.get("bytes", 64)), int(options.get("files", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.uri)
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        seen = [(p, n) for p, n in found if not p.rpartition("/")[2].startswith(("_", "."))]
        return [Files(seen[i : i + self.files]) for i in range(0, len(seen), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.uri)
        rows = []
        for path, size in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    rows.append({"path": path, "size": size, "head": f.read(self.bytes), "error": None})
            except OSError as e:
                rows.append({"path": path, "size": size, "head": None, "error": str(e)[:200]})
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("head", pa.binary()), ("error", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)
