"""A media folder as a data source: ``spark.read.format("media_folder")``, and as a stream of polls.

The driver looks at folders only until there is enough work for all tasks, and deals out subtrees, and shares of the names
of folders that hold many files; tasks ask for size and time. A folder of a million files, or one at the end of a long path,
is read by several tasks.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumiquarry.sources.media import HEIC, JPEG, PASSED_OVER, RAW, VIDEO

SCHEMA = "path string, kind string, size_bytes long, mtime double"
ENDINGS = {e: kind for kind, endings in (("jpeg", JPEG), ("heic", HEIC), ("raw", RAW), ("video", VIDEO)) for e in endings}


@dataclass
class Share(InputPartition):
    """A folder: with all below it, or every ``of``-th of its own names, by hash, that is ``k``."""

    folder: str
    deep: bool
    k: int = 0
    of: int = 1
    poll: int = 0


def named(entries: Iterator[os.DirEntry], passed_over: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """The folders to go into, and the media files, of a folder's entries."""
    folders, files = [], []
    for e in entries:
        try:
            if e.is_dir():
                if e.name not in passed_over and not e.is_symlink():
                    folders.append(e.path)
            elif os.path.splitext(e.name)[1].lower() in ENDINGS:
                files.append(e.path)
        except OSError:
            continue
    return folders, files


def looked(folder: str, passed_over: tuple[str, ...]) -> tuple[list[str], list[str]]:
    try:
        with os.scandir(folder) as entries:
            return named(entries, passed_over)
    except OSError:  # one that cannot be read, or went meanwhile, has nothing
        return [], []


def shares(root: str, parts: int, each: int, passed_over: tuple[str, ...]) -> list[Share]:
    """Work for at least ``parts`` tasks where there is as much, no share of a folder's own names with over ``each`` of them, as far as they were looked at."""
    out: list[Share] = []
    level = [root]
    while level and len(out) + len(level) < 4 * parts:
        below = []
        for folder in level:
            folders, files = looked(folder, passed_over)
            below += folders
            n = -(-len(files) // each)
            out += [Share(folder, False, k, n) for k in range(n)]
        level = below
    return out + [Share(folder, True) for folder in level]


def walked(share: Share, passed_over: tuple[str, ...]) -> Iterator[tuple]:
    """The share's rows, in the schema of the source."""
    todo = [share.folder]
    while todo:
        folders, files = looked(todo.pop(), passed_over)
        if share.deep:
            todo += folders
        for path in files:
            if share.of > 1 and zlib.crc32(os.fsencode(os.path.basename(path))) % share.of != share.k:
                continue
            try:
                s = os.stat(path)
            except OSError:
                continue
            if os.path.isfile(path):
                yield path, ENDINGS[os.path.splitext(path)[1].lower()], s.st_size, s.st_mtime


class MediaFolder(DataSource):
    """Options: path; parts, tasks wanted (8); each, names of a folder to a task (10000); state_folder, the library's own folder, passed over.

    Reading gives (path, kind, size_bytes, mtime) of the media files below the path, whatever their names begin with. A
    stream gives all of them again at each poll, with its number: (poll, path, kind, size, mtime), which ``watch.debounced``
    takes; a poll is a batch and its offset, and a batch that is run again sees the folder as it is by then. ``every`` (60)
    is the least number of seconds between two polls.
    """

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(self.options)


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.root, self.parts, self.each = options["path"], int(options.get("parts", 8)), int(options.get("each", 10_000))
        self.every = float(options.get("every", 60))
        self.passed_over = (*PASSED_OVER, options.get("state_folder", ".lumiquarry"))


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Share]:
        return shares(self.root, self.parts, self.each, self.passed_over) or [Share(self.root, False)]

    def read(self, partition: Share) -> Iterator[tuple]:
        return walked(partition, self.passed_over)


class PollReader(_Folder, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.poll, self.last = -1, 0.0

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        now = time.monotonic()
        if self.poll < 0 or now - self.last >= self.every:
            self.poll, self.last = self.poll + 1, now
        return {"poll": self.poll}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self.poll = max(self.poll, end["poll"])  # after a restart, polls go on from the last one
        found = shares(self.root, self.parts, self.each, self.passed_over) or [Share(self.root, False)]
        return [Share(s.folder, s.deep, s.k, s.of, end["poll"]) for s in found]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, kind, size, mtime in walked(partition, self.passed_over):
            yield partition.poll, path, kind, size, mtime

    def commit(self, end: dict) -> None:
        self.poll = max(self.poll, end["poll"])


POLLS = "poll long, path string, kind string, size long, mtime double"


def registered(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(MediaFolder)
