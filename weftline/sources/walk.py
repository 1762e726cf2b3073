"""A source tree as a data source of Spark: folders are listed and files read in the tasks.

    register(spark)
    spark.read.format("source_tree").option("root", "/work/project").load()
    spark.readStream.format("source_tree").option("root", "/work/project").load()   # files by their time of change

The root is a path that driver and executors share, as a mounted volume. Options: ``ignores``
(patterns, as ingest.ignored has them, by line feeds), ``contents`` (false leaves them null),
``splits`` (so many parts at least, where the tree has so many folders) and ``max_depth``.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from .ingest import SKIPPED_DIRECTORIES

SCHEMA = "path string, mtime bigint, size bigint, content string"
#: A file may be written to while its time is this many milliseconds back; a stream takes it up later.
SETTLED = 1000


def is_ignored(path: str, patterns: tuple[str, ...]) -> bool:
    """``ingest.ignored`` of one path."""

    def one(p: str) -> bool:
        below = lambda d: path == d or path.startswith(d + "/")
        if p.startswith("**/"):
            name = p[3:-3] if p.endswith("/**") and len(p) > 5 else p[3:]
            return f"/{name}/" in path or (below(name) if name != p[3:] else path == name or path.endswith("/" + name))
        if p.endswith("/**"):
            return below(p[:-3])
        if p.startswith("*."):
            return path.endswith(p[1:])
        return path == p if "*" in p else below(p)

    return any(one(p.replace("\\", "/")) for p in patterns)


@dataclass
class Subtree(InputPartition):
    """A folder below the root, with all below it or its own files alone; changed after ``after`` and up to ``until``."""

    folder: str
    deep: bool
    after: int | None = None
    until: int | None = None

    def __post_init__(self):
        super().__init__(self.folder)


@dataclass
class Tree:
    root: str
    ignores: tuple[str, ...] = ()
    contents: bool = True
    splits: int = 32
    max_depth: int = 50
    starts: list[str] = field(default_factory=list)
    paths: list[frozenset[str]] = field(default_factory=list)
    after: int | None = None

    def entries(self, folder: str) -> tuple[list[str], list[str]]:
        """(folders, files) of a folder, sorted.

        A folder within the root is walked by itself, so no link leads to it. A link out of the root is followed
        unless the way to it has been through its folder already, so that cycles end whatever part they are met in.
        """
        folders, files = [], []
        parts = folder.split("/") if folder else []
        way = [os.path.realpath(os.path.join(self.root, *parts[:k])) for k in range(len(parts) + 1)]
        within = lambda real: real == way[0] or real.startswith(way[0] + os.sep)
        for e in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_dir():
                    to = os.path.realpath(e.path)
                    again = to in way or within(to) and (e.is_symlink() or not within(way[-1]))
                    if not again and not e.name.startswith(".") and e.name not in SKIPPED_DIRECTORIES and not is_ignored(path, self.ignores):
                        folders.append(path)
                elif e.is_file() and not is_ignored(path, self.ignores):
                    files.append(path)
            except OSError:  # it went meanwhile, or the link leads nowhere
                continue
        return folders, files

    def may_hold(self, folder: str) -> bool:
        """Whether a file below ``folder`` may have a path that is asked for."""
        inside = folder + "/" if folder else ""
        return all(s.startswith(inside) or inside.startswith(s) for s in self.starts) and all(any(p.startswith(inside) for p in of) for of in self.paths)

    def subtrees(self) -> list[Subtree]:
        """The tree in parts: the folders of one level are opened on the driver until there are ``splits``; all below is listed by tasks."""
        level, own, depth = [""], [], 0
        while level and len(level) < self.splits and depth < self.max_depth:
            below = []
            for folder in level:
                own.append(Subtree(folder, False))
                below += self.entries(folder)[0]
            level, depth = below, depth + 1
        return [s for s in (*own, *(Subtree(f, True) for f in level)) if self.may_hold(s.folder)]

    def walk(self, part: Subtree) -> Iterator[tuple]:
        """The rows of a part."""
        after = max((x for x in (part.after, self.after) if x is not None), default=None)
        waiting = [part.folder]
        while waiting:
            folder = waiting.pop()
            if not self.may_hold(folder):
                continue
            try:
                folders, files = self.entries(folder)
            except OSError:
                continue
            for path in files:
                if not all(path.startswith(s) for s in self.starts) or not all(path in of for of in self.paths):
                    continue
                at = os.path.join(self.root, path)
                try:
                    stat = os.stat(at)
                    mtime = stat.st_mtime_ns // 1_000_000
                    if (after is not None and mtime <= after) or (part.until is not None and mtime > part.until):
                        continue
                    content = None
                    if self.contents:
                        with open(at, encoding="utf-8", errors="replace", newline="") as f:
                            content = f.read()
                except OSError:
                    continue
                yield path, mtime, stat.st_size, content
            if part.deep and folder.count("/") + 1 < self.max_depth:
                waiting += reversed(folders)


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Paths and their beginnings leave out whole folders, times of change leave out reads."""
        for f in filters:
            match f:
                case StringStartsWith(("path",), value):
                    self.tree.starts.append(value)
                case EqualTo(("path",), value):
                    self.tree.paths.append(frozenset([value]))
                case In(("path",), values):
                    self.tree.paths.append(frozenset(values))
                case GreaterThan(("mtime",), value):
                    self.tree.after = max(value, self.tree.after if self.tree.after is not None else value)
                case GreaterThanOrEqual(("mtime",), value):
                    self.tree.after = max(value - 1, self.tree.after if self.tree.after is not None else value - 1)
                case _:
                    yield f

    def partitions(self) -> list[Subtree]:
        return self.tree.subtrees() or [Subtree("", False, after=1 << 62)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return self.tree.walk(partition)


class TreeStreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files that changed after the last one, up to SETTLED before now."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"mtime": int(time.time() * 1000) - SETTLED}

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        return [Subtree(s.folder, s.deep, start["mtime"], end["mtime"]) for s in self.tree.subtrees()]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return self.tree.walk(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def _tree(self) -> Tree:
        o = self.options
        ignores = tuple(p for p in (o.get("ignores") or "").split("\n") if p)
        return Tree(o["root"], ignores, (o.get("contents") or "true") != "false", int(o.get("splits") or 32), int(o.get("max_depth") or 50))

    def reader(self, schema) -> TreeReader:
        return TreeReader(self._tree())

    def streamReader(self, schema) -> TreeStreamReader:  # noqa: N802
        return TreeStreamReader(self._tree())


def register(spark: SparkSession) -> None:
    """Makes the format ``source_tree`` known to a session, with filters going to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
