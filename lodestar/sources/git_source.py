"""Python data sources ``git`` (files of a revision) and ``git_changes`` (files that differ between two).

``git`` is read by subtree: the driver sees folders alone, as many as give enough
partitions, and never a list of files. A folder of very many files is listed by several
tasks, each of which takes its share of the names. Filters on path (=, in, starts
with, ends with) are pushed into the reader, which doesn't list folders that they rule out.
The repository must be readable on the executors. After ``register(spark)``:

    spark.read.format("git").option("rev", "HEAD").load("/a/repository").where("path like 'src/%'")

Edge cases: submodules aren't files; an empty revision gives no rows; a name that isn't UTF-8 has its
odd bytes replaced; a blob that is missing or isn't UTF-8 is left out. With ``strict`` the last three are errors.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

#: Bytes of sources that a task holds before it hands them on.
HELD_BYTES = 32 << 20
#: Rows of a batch.
HELD_ROWS = 1000
#: Bytes of a folder's own listing in git, about 40 a file, for each task that reads files directly in it.
FOLDER_BYTES = 1 << 20


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)
    spark.dataSource.register(GitChanges)


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def zero_ended(repo: str, *args: str) -> Iterator[bytes]:
    """The NUL-ended items that a git command prints, as it prints them."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE) as run:
        rest = b""
        while chunk := run.stdout.read(1 << 16):
            *items, rest = (rest + chunk).split(b"\0")
            yield from items
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, ["git", *args])


def entries(repo: str, *args: str) -> Iterator[tuple[str, str, bytes]]:
    """type, object id, name of what git ls-tree lists."""
    for item in zero_ended(repo, "ls-tree", "-z", *args):
        head, name = item.split(b"\t", 1)
        _, kind, oid = head.decode().split()
        yield kind, oid, name


def blobs(repo: str, rev: str, wanted: Iterable[tuple[str, str]], strict: bool) -> Iterator[tuple[str, str, str]]:
    """path, oid, text of (path, oid), read by one git process, one blob at a time."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for path, oid in wanted:
            run.stdin.write(f"{oid}\n".encode())
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) != 3:
                if strict:
                    raise FileNotFoundError(f"{rev}:{path}: {b' '.join(head).decode()}")
                continue
            data = run.stdout.read(int(head[2]))
            run.stdout.read(1)
            try:
                yield path, oid, data.decode()
            except UnicodeDecodeError:
                if strict:
                    raise
        run.stdin.close()


def normal(path: str) -> str:
    return re.sub(r"^(\./)+", "", path.replace("\\", "/")).strip("/")


@dataclass(frozen=True)
class Piece(InputPartition):
    """What one task lists: a folder with all below it, or a share of the files directly in it."""

    tree: str
    prefix: str
    deep: bool
    part: int = 0
    parts: int = 1


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.rev = os.path.abspath(options["path"]), options.get("rev", "HEAD")
        self.endings = tuple(x for x in options.get("endings", ".ts,.tsx,.cs").split(",") if x)
        self.scope = [normal(x) for x in json.loads(options.get("scope", "[]"))]
        self.contents, self.strict = (options.get(k, d).lower() == "true" for k, d in (("contents", "true"), ("strict", "false")))
        self.pieces = int(options.get("pieces", "256"))
        self.equal: list[frozenset[str]] = []
        self.starts: list[str] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes those on path that it can apply itself, and returns the others."""
        for f in filters:
            if getattr(f, "attribute", None) != ("path",):
                yield f
            elif isinstance(f, EqualTo):
                self.equal.append(frozenset([f.value]))
            elif isinstance(f, In):
                self.equal.append(frozenset(f.value))
            elif isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith):
                self.ends.append(f.value)
            elif not isinstance(f, IsNotNull):  # no path is null
                yield f

    def passes(self, path: str) -> bool:
        if self.endings and not path.endswith(self.endings):
            return False
        own = normal(path) if self.scope else path
        scoped = not self.scope or any(own == s or own.startswith(f"{s}/") for s in self.scope)
        return scoped and all(path in e for e in self.equal) and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))

    def reaches(self, prefix: str) -> bool:
        """Whether a file below the folder prefix (with its slash) can pass."""
        if any(not any(p is not None and p.startswith(prefix) for p in e) for e in self.equal):
            return False
        if any(not (prefix.startswith(s) or s.startswith(prefix)) for s in self.starts):
            return False
        folder = prefix.replace("\\", "/")
        if not self.scope or folder.startswith("./"):
            return True
        return any(folder.startswith(f"{s}/") or f"{s}/".startswith(folder) for s in self.scope)

    def partitions(self) -> list[Piece]:
        root = git(self.repo, "rev-parse", f"{self.rev}^{{tree}}").decode().strip()
        waiting, found = deque([(root, "")]), []
        while waiting and len(waiting) + len(found) < self.pieces:
            tree, prefix = waiting.popleft()
            below = ((oid, f"{prefix}{self.text(name)}/") for kind, oid, name in entries(self.repo, "-d", tree) if kind == "tree")
            waiting.extend(x for x in below if self.reaches(x[1]))
            parts = 1 + int(git(self.repo, "cat-file", "-s", tree)) // FOLDER_BYTES
            found += [Piece(tree, prefix, False, i, parts) for i in range(parts)]
        return found + [Piece(tree, prefix, True) for tree, prefix in waiting]

    def text(self, name: bytes) -> str:
        return name.decode("utf-8", "strict" if self.strict else "replace")

    def listed(self, piece: Piece) -> Iterator[tuple[str, str]]:
        for kind, oid, name in entries(self.repo, *(["-r"] if piece.deep else []), piece.tree):
            if kind == "blob" and (piece.parts == 1 or zlib.crc32(name) % piece.parts == piece.part):
                path = piece.prefix + self.text(name)
                if self.passes(path):
                    yield path, oid

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        listed = self.listed(partition)
        rows = blobs(self.repo, self.rev, listed, self.strict) if self.contents else ((path, oid, None) for path, oid in listed)
        held, size = [], 0
        for row in rows:
            held.append((self.rev, *row))
            size += len(row[2] or "")
            if size > HELD_BYTES or len(held) == HELD_ROWS:
                yield self.batch(held)
                held, size = [], 0
        yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["rev", "path", "oid", "source"])


class GitSource(DataSource):
    """rev, path, oid, source of the files of a revision. Options: path (the repository, or load()'s argument), rev (HEAD),
    endings (of names, by commas; empty: any), scope (a JSON list of files and folders; none: all), contents (false: source
    is null and no blob is read), strict, pieces (how many partitions to look for folders for)."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return "rev string, path string, oid string, source string"

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


class ChangesReader(DataSourceReader):
    """In one task, as git looks for renames over the whole difference; rows stream through it."""

    KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}

    def __init__(self, options: dict) -> None:
        self.repo, self.base, self.head = os.path.abspath(options["path"]), options["base"], options["head"]

    def partitions(self) -> list[InputPartition]:
        git(self.repo, "rev-parse", f"{self.base}^{{tree}}")
        git(self.repo, "rev-parse", f"{self.head}^{{tree}}")
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        items = (x.decode("utf-8", "replace") for x in zero_ended(self.repo, "diff", "--name-status", "--find-renames", "-z", self.base, self.head))
        for code in items:
            first = next(items)
            if code[:1] in "RC":
                yield next(items), self.KINDS[code[:1]], first
            elif code[:1] in self.KINDS:
                yield first, self.KINDS[code[:1]], None


class GitChanges(DataSource):
    """path, kind (added, modified, deleted, renamed, copied), from_path. Options: path (the repository), base, head."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "path string, kind string, from_path string"

    def reader(self, schema) -> ChangesReader:
        return ChangesReader(self.options)
