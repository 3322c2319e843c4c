"""Reading source trees, hidden files included.

Spark's own file readers leave out names that begin with a dot, and those are
files the checks ask for: environment and ignore files, workflows and git's own
configuration. Listing and reading therefore run as tasks over a table of
folders and a table of paths.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebase.rules.vocabulary import SKIPPED_DIRECTORIES
from sievebase.sources.corpus import skip_reason

LISTED = "repo string, root string, path string, is_dir boolean, size_bytes long"
READ_CHUNK_BYTES = 16 * 1024 * 1024


def walk(folder: str, deep: bool, keep_git: bool) -> tuple[str, Iterator]:
    """The folder's path in its file system, and its entries; those of whole subtrees without their folders if ``deep``.
    Links are not followed, skipped folders not entered."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    local = isinstance(system, fs.LocalFileSystem)
    skipped = set(SKIPPED_DIRECTORIES) - ({".git"} if keep_git else set())

    def entries() -> Iterator:
        stack = [base]
        while stack:
            here = stack.pop()
            for info in system.get_file_info(fs.FileSelector(here, allow_not_found=True)):
                if local and os.path.islink(info.path):
                    continue
                is_dir = info.type == fs.FileType.Directory
                name = os.path.basename(info.path)
                in_git = os.path.basename(here.rstrip("/")) == ".git"
                if is_dir and (name.lower() in skipped or (in_git and name != "hooks")):
                    continue
                if is_dir and deep:
                    stack.append(info.path)
                    continue
                yield info

    return base, entries()


def _list(repo: str, root: str, folder: str, deep: bool, keep_git: bool) -> Iterator[tuple]:
    """Entries of a folder as rows; whole subtrees if ``deep``."""
    base, entries = walk(folder, deep, keep_git)
    for info in entries:
        is_dir = info.size is None
        yield repo, root, folder[: len(folder) - len(base)] + info.path, is_dir, 0 if is_dir else info.size


def _expand(rows: DataFrame, deep: bool, keep_git: bool) -> DataFrame:
    def task(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for row in chunk.itertuples(index=False):
                if not row.is_dir:
                    yield pd.DataFrame([tuple(row)], columns=chunk.columns)
                    continue
                found = list(_list(row.repo, row.root, row.path, deep, keep_git))
                if found:
                    yield pd.DataFrame(found, columns=chunk.columns)

    return rows.repartition("path").mapInPandas(task, LISTED)


def list_trees(roots: DataFrame, levels: int = 2, keep_git: bool = False) -> DataFrame:
    """Files under each root: repo, root, path and size.

    ``roots`` has repo and root, an address such as ``file:///x`` or ``hdfs://h/x``.
    The first levels are listed folder by folder, each spread over all tasks, so
    that a large repository is walked by many of them.
    """
    rows = roots.select("repo", "root", F.col("root").alias("path"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size_bytes"))
    for _ in range(levels):
        rows = _expand(rows, False, keep_git)
    return _expand(rows, True, keep_git).filter(~F.col("is_dir"))


def read_trees(roots: DataFrame, keep_git: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Files as repo, file_path, size_bytes and content.

    Names, and sizes if ``max_bytes`` is given, are tested on the listing, so skipped files are never opened.
    With ``keep_git`` git's own files are read too; text is decoded as UTF-8 with
    replacement.
    """
    relative = F.substring(F.col("path"), F.length(F.rtrim("root", F.lit("/"))) + 2, F.length("path"))
    listed = list_trees(roots, keep_git=keep_git).select("repo", relative.alias("file_path"), "path", "size_bytes")
    reason = skip_reason(F.col("file_path"), F.col("size_bytes"), max_bytes)
    git_file = F.lit(keep_git) & F.col("file_path").rlike(r"(^|/)\.git/(config|hooks/[^/]+)$")
    wanted = listed.filter(reason.isNull() | git_file)

    def task(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for chunk in chunks:
            part, held = [], 0
            for row in chunk.itertuples(index=False):
                system, path = fs.FileSystem.from_uri(row.path)
                with system.open_input_stream(path) as stream:
                    data = stream.read()
                part.append((row.repo, row.file_path, row.size_bytes, bytes(data).decode("utf-8", "replace")))
                held += len(data)
                if held >= READ_CHUNK_BYTES:
                    yield pd.DataFrame(part, columns=["repo", "file_path", "size_bytes", "content"])
                    part, held = [], 0
            if part:
                yield pd.DataFrame(part, columns=["repo", "file_path", "size_bytes", "content"])

    return wanted.repartition("path").mapInPandas(task, "repo string, file_path string, size_bytes long, content string")
