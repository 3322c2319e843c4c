"""Repository trees as a Spark data source, in batch and as a stream of newly arrived files.

``spark.dataSource.register(TreeSource)``, then ``spark.read.format("repo_tree").load(root)`` or ``spark.readStream...``.
A folder below the root is a repository, hidden files included; rows are repo, file_path, size_bytes, modified_ms, content.

The stream's offset is the mark of the last file taken: its time of change, then its path. A batch has the files after
the mark of the one before, so each version of a file is read once, and a restart from a checkpoint goes on where it was.
A file is taken when its time lies ``settle_ms`` back, so that files still being written in that moment fall into one
order; a file that is put there with an older time than the mark is not seen. A batch may be of any size, as its files
are cut into partitions of bounded size.

Options: keep_git (false) reads git's own configuration and hooks as well; settle_ms (2000); chunk_bytes (16 MB), the
files of one partition.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sievebase.rules import vocabulary as vocab
from sievebase.sources.trees import walk

SCHEMA = "repo string, file_path string, size_bytes long, modified_ms long, content string"
CHUNK_BYTES = 16 * 1024 * 1024


class Listed(NamedTuple):
    modified_ms: int
    path: str
    size: int


class Files(InputPartition):
    def __init__(self, files: list[Listed]):
        self.files = files


def _wanted(path: str, keep_git: bool) -> bool:
    """Whether the walk rules keep a file, by its path below the repository."""
    low = path.lower()
    if "/.git/" in f"/{low}":
        return keep_git and (low.endswith(".git/config") or "/.git/hooks/" in f"/{low}")
    name = low.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return not (low.endswith((".min.js", ".min.css")) or (dot >= 0 and name[dot:] in vocab.SKIPPED_EXTENSIONS))


class _Tree:
    """The files below a root and how they are read."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        if "://" not in self.root and not self.root.startswith("file:"):
            self.root = f"file://{self.root}"
        self.keep_git = options.get("keep_git", "false").lower() == "true"
        self.settle_ms = int(options.get("settle_ms", 2000))
        self.chunk_bytes = int(options.get("chunk_bytes", CHUNK_BYTES))

    def listed(self) -> list[Listed]:
        """All kept files in order of their marks; paths are below the root."""
        system_path, infos = walk(self.root, True, self.keep_git)
        found = []
        for info in infos:
            below = info.path[len(system_path.rstrip("/")) + 1 :]
            _, _, inside = below.partition("/")
            if inside and _wanted(inside, self.keep_git):
                found.append(Listed((info.mtime_ns or 0) // 1_000_000, below, info.size))
        return sorted(found)

    def partitions(self, files: list[Listed]) -> list[Files]:
        parts, held, size = [], [], 0
        for file in files:
            held.append(file)
            size += file.size
            if size >= self.chunk_bytes:
                parts.append(Files(held))
                held, size = [], 0
        return [*parts, Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["repo", "file_path", "size_bytes", "modified_ms", "content"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for file in partition.files:
            system, path = fs.FileSystem.from_uri(self.root)
            try:
                with system.open_input_stream(f"{path.rstrip('/')}/{file.path}") as stream:
                    text = bytes(stream.read()).decode("utf-8", "replace")
            except FileNotFoundError:  # gone since it was listed
                continue
            repo, _, inside = file.path.partition("/")
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((repo, inside, file.size, file.modified_ms, text), types)], names=names)


class _Batch(DataSourceReader):
    def __init__(self, tree: _Tree):
        self.tree = tree

    def partitions(self) -> list[Files]:
        return self.tree.partitions(self.tree.listed())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, tree: _Tree):
        self.tree = tree
        self.mark: tuple[int, str] = (-1, "")

    @staticmethod
    def _mark(offset: dict) -> tuple[int, str]:
        return offset["modified_ms"], offset["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified_ms": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        settled = time.time_ns() // 1_000_000 - self.tree.settle_ms
        self.mark = max([self.mark, *(f[:2] for f in self.tree.listed() if f.modified_ms <= settled)])
        return {"modified_ms": self.mark[0], "path": self.mark[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = self._mark(start), self._mark(end)
        self.mark = max(self.mark, high)
        return self.tree.partitions([f for f in self.tree.listed() if low < f[:2] <= high])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches but the mark."""


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(_Tree(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(_Tree(self.options))
