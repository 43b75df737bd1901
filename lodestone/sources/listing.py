"""Directory scan: names and sizes only, contents are read later by the tasks."""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import paths
from ..session import materialize


@dataclass
class Rules:
    ignore_dirs: list[str] = field(default_factory=lambda: list(paths.IGNORE_DIRS))
    ignore_patterns: list[str] = field(default_factory=lambda: list(paths.IGNORE_PATTERNS))
    markers: list[str] = field(default_factory=lambda: list(paths.MARKERS))
    index_hidden: bool = False
    text: list[str] = field(default_factory=lambda: list(paths.TEXT_EXTENSIONS))
    media: list[str] = field(default_factory=lambda: list(paths.MEDIA_EXTENSIONS))
    default_mb: int = paths.DEFAULT_MB
    mb_by_type: dict[str, int] = field(default_factory=lambda: dict(paths.MB_BY_TYPE))


def match(pattern: str, name: str, literal_if_malformed: bool) -> bool:
    rx = paths.glob_regex(pattern)
    return re.match(rx, name, re.S) is not None if rx is not None else literal_if_malformed and pattern == name


def extension(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at >= 0 else ""


def _gitignored(relative: str, is_dir: bool, rules: list[paths.GitignoreRule]) -> bool:
    name = relative.rpartition("/")[2]
    return any(match(r.pattern, relative if r.anchored else name, False) for r in rules if is_dir or not r.dir_only)


def classify(relative: str, rules: Rules, ignored: list[paths.GitignoreRule]) -> str:
    name = relative.rpartition("/")[2]
    if _gitignored(relative, False, ignored) or any(match(p, name, False) for p in rules.ignore_patterns):
        return "none"
    ext = extension(name)
    return "text" if ext in [e.lower() for e in rules.text] else "media" if ext in [e.lower() for e in rules.media] else "none"


def size_limit(name: str, rules: Rules) -> int:
    return rules.mb_by_type.get(extension(name)[1:], rules.default_mb) * 1024 * 1024


Row = tuple[str, str, int | None, int | None, str]


def _folder(folder: str, root: str, rules: Rules, ignored: list[paths.GitignoreRule]) -> tuple[list[Row], list[str]]:
    """(rows of the files of one folder, its folders that aren't pruned), in lexical order."""
    rows: list[Row] = []
    below: list[str] = []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [(folder, "none", None, None, "unreadable")], []
    for e in entries:
        relative = os.path.relpath(e.path, root).replace(os.sep, "/")
        if e.is_dir(follow_symlinks=False):
            pruned = (e.name.startswith(".") and not rules.index_hidden) or any(match(p, e.name, True) for p in rules.ignore_dirs)
            if not pruned and not any(os.path.lexists(os.path.join(e.path, m)) for m in rules.markers) and not _gitignored(relative, True, ignored):
                below.append(e.path)
        elif (kind := classify(relative, rules, ignored)) == "none":
            rows.append((e.path, kind, None, None, "filtered"))
        else:
            try:
                st = os.stat(e.path)
            except OSError:
                rows.append((e.path, kind, None, None, "unreadable"))
                continue
            limit = size_limit(e.name, rules)
            if stat.S_ISDIR(st.st_mode):
                rows.append((e.path, "none", None, None, "filtered"))
            else:
                rows.append((e.path, kind, st.st_size, int(st.st_mtime), "too_large" if 0 < limit < st.st_size else "candidate"))
    return rows, below


def _start(root: str) -> tuple[str, list[paths.GitignoreRule]]:
    if not os.path.exists(root):
        raise FileNotFoundError(f"path does not exist: {root}")
    root = os.path.realpath(root)
    os.scandir(root).close()  # an unreadable root is an error, an unreadable folder below isn't
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return root, paths.GitignoreRule.parse(f.read())
    except OSError:
        return root, []


def _walk(folder: str, root: str, rules: Rules, ignored: list[paths.GitignoreRule]) -> Iterator[Row]:
    rows, below = _folder(folder, root, rules, ignored)
    yield from rows
    for b in below:
        yield from _walk(b, root, rules, ignored)


def scan(root: str, rules: Rules, recursive: bool = True) -> list[Row]:
    """(path, kind, size, modified_at, outcome) of a tree. outcome: 'candidate', 'filtered', 'too_large' or 'unreadable'.
    A directory symlink isn't followed, a file symlink is. A missing or unreadable root is an error."""
    root, ignored = _start(root)
    return list(_walk(root, root, rules, ignored)) if recursive else _folder(root, root, rules, ignored)[0]


LISTING = "path string, kind string, size long, modified_at long, outcome string"


def listing(spark: SparkSession, root: str, rules: Rules, recursive: bool = True, share: int = 2000) -> DataFrame:
    """The same as a DataFrame. Level by level, tasks list the folders that wait: each walks
    below its own until it has listed `share` of them and passes on the rest, so that one deep folder is shared by many tasks.
    What a level finds is written to the shared folder; no names meet in the driver."""
    root, ignored = _start(root)
    if not recursive:
        return spark.createDataFrame(_folder(root, root, rules, ignored)[0], LISTING)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["path", "kind", "size", "modified_at", "outcome"]

    def walk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            mine, listed, out = deque(b.column(0).to_pylist()), 0, []
            while mine and listed < share:
                files, below = _folder(mine.popleft(), root, rules, ignored)
                out += files
                mine.extend(below)
                listed += 1
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            out += [(f, "folder", None, None, "waiting") for f in mine]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    spread = 4 * spark.sparkContext.defaultParallelism
    todo, parts = spark.createDataFrame([(root,)], "path string"), []
    while True:
        level = materialize(todo.repartition(spread).mapInArrow(walk, LISTING), "level")
        parts.append(level.where("outcome <> 'waiting'"))
        todo = level.where("outcome = 'waiting'").select("path")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)
