"""Spark data sources: `notes`, Markdown files as a table or a stream, and `results`, a JSON file for each row that is written.

    spark.dataSource.register(files.Notes)
    spark.read.format("notes").option("depth", 1).load(folder)

A path may be one of any file system that Arrow knows by its URI."""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NOTES = "place long, file string, name string, doc string, error string"
#: Bytes of files that a task reads about, and the most files of a task.
TASK, FILES = 32 << 20, 4096
#: Bytes of texts that a batch on the way to Spark holds about.
BATCH = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _below(system: fs.FileSystem, folder: str, depth: int | None) -> list[fs.FileInfo]:
    """Files of a folder, at most depth levels down where that is stated: 1 is the folder itself, 0 nothing."""
    if depth is None:
        return [f for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]
    found, level = [], [folder]
    for _ in range(depth):
        inside = [f for x in level for f in system.get_file_info(fs.FileSelector(x))]
        found += [f for f in inside if f.type == fs.FileType.File]
        level = [f.path for f in inside if f.type == fs.FileType.Directory]
    return found


def listed(paths: list[str], depth: int | None = None) -> list[tuple[str, int, int]]:
    """(file, bytes, time in nanoseconds) of paths, in their order: files by whatever name, and the .md files of folders by name.

    A path that doesn't exist is an error; a file that two paths lead to is there twice."""
    out = []
    for path in paths:
        system, inside = opened(path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"path not found: {path}")
        found = [info]
        if info.type == fs.FileType.Directory:
            found = sorted((f for f in _below(system, inside, depth) if f.base_name.endswith(".md") and f.base_name != ".md"), key=lambda f: f.path)
        scheme = path[: path.index("://") + 3] if "://" in path else ""
        out += [(f"{scheme}{f.path}", f.size or 0, f.mtime_ns or 0) for f in found]
    return out


@dataclass
class Files(InputPartition):
    """A task's files, the first of which has the number first."""

    first: int
    files: list[str]


def dealt(files: list[tuple[str, int, int]], first: int = 0) -> list[Files]:
    """Files in order, cut where a task has enough of them or of their bytes."""
    parts, held, size = [], [], 0
    for file, n, _ in files:
        if held and (size + n > TASK or len(held) >= FILES):
            parts.append(Files(first, held))
            first, held, size = first + len(held), [], 0
        held.append(file)
        size += n
    return [*parts, Files(first, held)] if held else parts


def texts(part: Files | None) -> Iterator[pa.RecordBatch]:
    """NOTES of a task's files; one that isn't UTF-8 has an error and no text, and so has one that is gone."""
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in NOTES.split(", ")])

    for i, file in enumerate(part.files if part else ()):
        system, inside = opened(file)
        doc, error = None, None
        try:
            with system.open_input_stream(inside) as f:
                doc = f.read().decode("utf-8")
        except UnicodeDecodeError:
            error = "not UTF-8"
        except FileNotFoundError:
            error = "path not found"
        rows.append((part.first + i, file, posixpath.splitext(posixpath.basename(inside))[0], doc, error))
        size += len(doc or "")
        if size > BATCH:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class Notes(DataSource):
    """Notes of files and folders: load(path), or the option `paths` with a JSON list of them; `depth` limits folders.

    Rows are NOTES: place is a file's number in order. As a stream it takes `log`, a folder that holds which files each
    batch had, so that a query that starts again reads the same ones; a file that has changed is read again."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return NOTES

    def _given(self) -> tuple[list[str], int | None]:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]] if "path" in self.options else []
        if not paths:
            raise ValueError("notes need a path")
        depth = self.options.get("depth")
        if depth is not None and int(depth) < 0:
            raise ValueError("depth is at least 0")
        return paths, None if depth is None else int(depth)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._given())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if "log" not in self.options:
            raise ValueError("a stream of notes needs a folder for its log")
        return _Stream(*self._given(), self.options["log"])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], depth: int | None):
        self.paths, self.depth = paths, depth

    def partitions(self) -> list[Files]:
        return dealt(listed(self.paths, self.depth)) or [Files(0, [])]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return texts(partition)


class _Stream(DataSourceStreamReader):
    """Offsets count the log's entries, each a JSON list of the files that were new or changed when it was made."""

    def __init__(self, paths: list[str], depth: int | None, log: str):
        self.paths, self.depth, self.log = paths, depth, log
        self.entries, self.seen = 0, {}

    def initialOffset(self) -> dict:
        return {"entries": 0, "files": 0}

    def _entry(self, n: int) -> str:
        return f"{opened(self.log)[1].rstrip('/')}/{n:012d}.json"

    def _read(self, n: int) -> list[list] | None:
        try:
            with opened(self.log)[0].open_input_stream(self._entry(n)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def latestOffset(self) -> dict:
        while (entry := self._read(self.entries + 1)) is not None:
            self.entries += 1
            self.seen |= {file: (size, time) for file, size, time in entry}
        fresh = [f for f in dict.fromkeys(listed(self.paths, self.depth)) if self.seen.get(f[0]) != f[1:]]
        if fresh:
            system, folder = opened(self.log)
            system.create_dir(folder, recursive=True)
            part = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(json.dumps(fresh).encode())
            system.move(part, self._entry(self.entries + 1))  # an entry is there as a whole or not at all
            self.entries += 1
            self.seen |= {file: (size, time) for file, size, time in fresh}
        return {"entries": self.entries, "files": len(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [tuple(f) for n in range(start["entries"] + 1, end["entries"] + 1) for f in self._read(n)]
        return dealt(files, start["files"])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return texts(partition)

    def commit(self, end: dict) -> None:
        """Nothing: entries stay, as they tell what has been read."""


# ---------------------------------------------------------------- results

#: What a result's file is named after.
NAMED = ("task", "system", "corpus", "config")


def result_name(*parts: str) -> str:
    """The name of a result's file; separators of paths become underscores."""
    return "-".join(p.replace("/", "_").replace("\\", "_") for p in parts) + ".json"


def plain(x):
    """A cell as JSON has it: NaN and infinities are null, times ISO text."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in sorted(x.items())}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return None if isinstance(x, float) and not math.isfinite(x) else x


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they lie, and their names."""

    files: list[tuple[str, str]]


class Results(DataSource):
    """A JSON file for each row, named after its task, system, corpus and config.

    Files are written aside and get their names when all tasks are done; a job that fails leaves none. Two rows of one name
    are an error. Appending replaces files of the same name; overwriting takes other results away."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("results need a path")
        missing = [c for c in NAMED if c not in schema.names]
        if missing:
            raise ValueError(f"results need columns: {', '.join(missing)}")
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.aside = path, overwrite, f"_aside-{uuid.uuid4().hex}"

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        system, folder = opened(self.path)
        return system, folder.rstrip("/"), f"{folder.rstrip('/')}/{self.aside}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, aside = self._folders()
        task, files = TaskContext.get(), []
        for row in iterator:
            if not files:
                system.create_dir(aside, recursive=True)
            if any(row[c] is None for c in NAMED):
                raise ValueError(f"a result has no {next(c for c in NAMED if row[c] is None)}")
            file = f"{aside}/{task.taskAttemptId()}-{len(files)}"
            with system.open_output_stream(file) as f:
                f.write((json.dumps(plain(row), indent=2, ensure_ascii=False) + "\n").encode())
            files.append((file, result_name(*(row[c] for c in NAMED))))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, aside = self._folders()
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if twice := sorted(n for n, times in Counter(names).items() if times > 1):
            raise ValueError(f"results of one name: {', '.join(twice)}")
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".json")] if self.overwrite else []
        for file, name in files:
            system.move(file, f"{folder}/{name}")
        for path in old:
            if posixpath.basename(path) not in names:
                system.delete_file(path)
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        system, _, aside = self._folders()
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)
