"""``codetree``: a source tree as a table, in batch and as a stream.

``spark.dataSource.register(CodeTree)`` and then
``spark.read.format("codetree").option("path", folder).load()`` give one row
for each file: scan_id, file_path, language, source_code, modified. Hidden
names such as ``__init__.py`` are read too, which Spark's own file sources
leave out.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader

from codelake.parse.scan import EXTRA_ENDINGS, LANGUAGE_OF

SCHEMA = "scan_id string, file_path string, language string, source_code string, modified double"
# Fixed names of folders that are not walked.
SKIP = ("node_modules", ".git", "__pycache__", ".dart_tool", "build", "dist", ".next", ".venv", "venv", "env", ".eggs", "*.egg-info")
FILES_A_TASK = 64


def ending_of(name: str) -> str:
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def listing(root: str, skip: tuple[str, ...] = SKIP) -> list[str]:
    """Files with a known ending below a folder, sorted; folders and files that meet a skip glob are left out."""
    if not os.path.isdir(root):
        if os.path.isfile(root):
            return [root]
        raise FileNotFoundError(root)
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not any(fnmatch.fnmatch(d, g) for g in skip))
        out += [os.path.join(folder, n) for n in names if (ending_of(n) in LANGUAGE_OF or ending_of(n) in EXTRA_ENDINGS) and not any(fnmatch.fnmatch(n, g) for g in skip)]
    return sorted(out)


def inside(path: str, root: str) -> bool:
    """Whether a path lies in a folder, links resolved."""
    p, r = os.path.realpath(path), os.path.realpath(root)
    return p == r or p.startswith(r.rstrip(os.sep) + os.sep)


def folders(prefix: str, root: str, top: int = 20) -> list[str]:
    """Folders below ``root`` that start with a prefix, for completion; none outside it and no hidden ones."""
    base, part = os.path.split(prefix)
    if not inside(base or root, root) or not os.path.isdir(base or root):
        return []
    names = sorted(n for n in os.listdir(base or root) if n.lower().startswith(part.lower()) and not n.startswith("."))
    return [p for n in names if os.path.isdir(p := os.path.join(base or root, n))][:top]


def read_file(scan_id: str, path: str) -> tuple | None:
    """One row for a file; bytes that aren't UTF-8 are replaced, and a file that can't be read has no row."""
    try:
        with open(path, "rb") as f:
            text = f.read().decode("utf-8", "replace")
        return scan_id, path, LANGUAGE_OF.get(ending_of(path)), text, os.path.getmtime(path)
    except OSError:
        return None


class CodeTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CodeTreeReader:
        return (PushingReader if self.options.get("pushFilters") == "true" else CodeTreeReader)(self.options)

    def simpleStreamReader(self, schema) -> CodeTreeStream:
        return CodeTreeStream(self.options)


class Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CodeTreeReader(DataSourceReader):
    """Lists on the driver and reads in tasks of FILES_A_TASK files."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.scan_id = options.get("scanId", os.path.basename(os.path.normpath(self.root)))
        self.skip = tuple(options["skipDirs"].split(",")) if "skipDirs" in options else SKIP
        self.only: str | None = None

    def partitions(self) -> list[Chunk]:
        paths = [p for p in listing(self.root, self.skip) if self.only is None or LANGUAGE_OF.get(ending_of(p)) == self.only]
        return [Chunk(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for p in partition.paths:
            row = read_file(self.scan_id, p)
            if row is not None:
                yield row


class PushingReader(CodeTreeReader):
    """Takes part in filter pushdown, which spark.sql.python.filterPushdown.enabled has to allow."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("language",):
                self.only = f.value
            yield f


class CodeTreeStream(SimpleDataSourceStreamReader):
    """Files changed since the last offset, which is the latest time of change seen."""

    def __init__(self, options: dict):
        self.reader = CodeTreeReader(options)

    def initialOffset(self) -> dict:
        return {"modified": 0.0}

    def _rows(self, low: float, high: float) -> list[tuple]:
        got = (read_file(self.reader.scan_id, p) for p in listing(self.reader.root, self.reader.skip))
        return [r for r in got if r is not None and low < r[4] <= high]

    def read(self, start: dict):
        found = self._rows(start["modified"], float("inf"))
        return iter(found), {"modified": max([r[4] for r in found], default=start["modified"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["modified"], end["modified"]))
