"""A data source named ``keyloom``: binary dictionaries as a table of entries.

Register it with ``spark.dataSource.register(TrieSource)``; then ``spark.read.format("keyloom").load(folder)`` reads a
file a task, and ``df.write.format("keyloom").mode("append").save(folder)`` writes a file for each dictionary of a task.
Repartition by ``dict_id`` before writing, so that a dictionary is whole. Folders are local paths or URIs of any file
system that Arrow knows (file, hdfs, s3, gs); all workers must reach them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyloom.schema import COLUMNS, ENTRY
from keyloom.sources.trie import _FIELD, pack, unpack

SUFFIX = ".trp"


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def _files(path: str) -> list[str]:
    """The dictionaries in a folder, or the file itself."""
    system, name = _system(path)
    here = system.get_file_info(name)
    if here.type == fs.FileType.File:
        return [name]
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(name, allow_not_found=True)) if x.path.endswith(SUFFIX))


class TrieReader(DataSourceReader):
    def __init__(self, path: str, verify: bool):
        self.path, self.verify = path, verify

    def partitions(self) -> list[InputPartition]:
        return [Part(p) for p in _files(self.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        with _system(self.path)[0].open_input_stream(partition.path) as file:
            content = file.read()
        name = os.path.basename(partition.path).removesuffix(SUFFIX)
        for i, (key, tag, v) in enumerate(unpack(content, self.verify)):
            yield (name, key.decode(), i, tag, *(v if c == _FIELD.get(tag) else None for c in COLUMNS))


class TrieWriter(DataSourceWriter):
    """Files get their names when the job commits, so a task that is repeated leaves nothing behind that is read."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        items: dict[str, dict[bytes, tuple[int, object, int]]] = {}
        for row in rows:
            mine, key = items.setdefault(row.dict_id, {}), row.key.encode()
            if key not in mine or mine[key][2] <= row.seq:
                mine[key] = (row.tag, row[_FIELD[row.tag]] if row.tag in _FIELD else None, row.seq)
                if row.tag not in _FIELD and row.tag != 0:
                    raise ValueError("arrays and nested dictionaries don't fit the format")
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        names = []
        for name, mine in items.items():
            if os.path.basename(name) != name or name in ("", ".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            temporary = f"{name}{SUFFIX}.{uuid.uuid4().hex}"
            with system.open_output_stream(f"{folder}/{temporary}") as file:
                file.write(pack({k: v[:2] for k, v in mine.items()}))
            names.append(temporary)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.names]
        targets = [n.rpartition(".")[0] for n in names]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("a dictionary was split between tasks; repartition by dict_id")
        system, folder = _system(self.path)
        if self.overwrite:
            for old in _files(self.path):
                system.delete_file(old)
        for name, target in zip(names, targets):
            system.move(f"{folder}/{name}", f"{folder}/{target}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _system(self.path)
        for message in messages:
            for name in message.names if message else ():
                if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{folder}/{name}")


class TrieSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyloom"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return TrieReader(self.options["path"], self.options.get("verify", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TrieWriter(self.options["path"], overwrite)
