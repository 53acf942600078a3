"""JSON batches as a source and a sink: files that each hold one array of objects, as requests and replies are.

    spark.dataSource.register(JsonBatches)
    spark.read.format("json_batches").load(path)              # path, item, text, language, maskMeta
    df.write.format("json_batches").mode("append").save(path)  # arrays of one object a row

Reading deals files to tasks by size; a file is a request, and one above `maxBytes` is an error, as is one that holds no array of
objects. A task writes as many arrays as keep below `maxBytes`; an object that is longer by itself has a file of its own. Writing
goes to a folder of its own below the target and moves there when every task is done: a failed job leaves nothing behind, since
no task writes once that folder is gone, and of a task that ran twice one run counts. `mode("overwrite")` takes away the files that were there before, at that
moment and not earlier.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from palimpsest.sources.texts import MAX_TEXT

#: Bytes of files that one task reads, at least.
PARTITION_BYTES = 32 << 20
_SCHEMA = "path string, item long, text string, language string, maskMeta string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _files(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    info = store.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class JsonBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_batches"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], schema.names, int(self.options.get("maxBytes", MAX_TEXT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self.options["path"], overwrite, int(self.options.get("maxBytes", MAX_TEXT)))


class BatchReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], most: int):
        self.path, self.names, self.most = path, names, most

    def partitions(self) -> list[Files]:
        store, folder = _store(self.path)
        out, size = [Files([])], 0
        for f in _files(store, folder):
            if f.size > self.most:
                raise ValueError(f"{f.path}: a batch of {f.size} bytes")
            if size >= PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as stream:
                items = json.loads(stream.read())
            if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
                raise ValueError(f"{path}: not an array of objects")
            for number, item in enumerate(items):
                known = {"path": path, "item": number}
                yield tuple(known.get(name, _spelt(item.get(name))) for name in self.names)


def _spelt(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class BatchWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, most: int = MAX_TEXT):
        self.path, self.overwrite, self.most = path, overwrite, most
        self.parts = f"_writing-{uuid.uuid4().hex}"
        store, folder = _store(path)
        store.create_dir(f"{folder}/{self.parts}", recursive=True)

    def write(self, rows: Iterator[Any]) -> Written:
        store, folder = _store(self.path)
        paths, out, size = [], None, 0
        try:
            for row in rows:
                item = json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode()
                if out is not None and size + len(item) + 3 > self.most:
                    out.write(b"]")
                    out.close()
                    out = None
                if out is None:
                    if store.get_file_info(f"{folder}/{self.parts}").type != fs.FileType.Directory:
                        raise RuntimeError("the job has ended")
                    paths.append(f"{folder}/{self.parts}/batch-{uuid.uuid4().hex}.json")
                    out, size = store.open_output_stream(paths[-1]), 0
                out.write((b",\n" if size else b"[") + item)
                size += len(item) + (2 if size else 1)
            if out is not None:
                out.write(b"]")
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        before = [f.path for f in _files(store, folder)] if self.overwrite else []
        for path in (p for m in messages if m is not None for p in m.paths):
            store.move(path, f"{folder}/{path.rsplit('/', 1)[1]}")
        for path in before:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        if store.get_file_info(f"{folder}/{self.parts}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.parts}")
