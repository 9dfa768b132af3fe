"""A source of records from growing files: JSON lines, and feeds as whole files.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tidemark_tail").option("path", folder).load()
    spark.read.format("tidemark_tail").option("path", folder).option("records", "feed").load()

Rows are (file, place, record, problem).  A record is a line, or an item or entry of a feed; what
is no JSON, or a feed without items, is kept aside with ``problem`` saying why, and stops nothing.

The offset of a stream is how many bytes of each file have been seen.  A line belongs to the
range of bytes that holds its line feed, so a line that is still being written waits for its end
and none is read twice, wherever a micro-batch cuts.  A file that has become shorter is another
file and starts anew.  A feed is read again, whole, when its size changes.  Ranges are cut at
``splitBytes``, so a large file is not one task's.

Files are opened by tasks through pyarrow, which knows local and shared folders and the common
object stores by their URI; for a store that only Spark reads, use Spark's own text source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, place long, record string, problem string"
_ITEM = re.compile(rb"<(item|entry)[\s>].*?</\1\s*>", re.S | re.I)
_STEP = 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``last`` says that nothing will follow."""

    file: str
    start: int
    end: int
    last: bool


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, at = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path.removeprefix(at).split("/"))
    return store, sorted((f for f in found if f.type == fs.FileType.File and not hidden(f)), key=lambda f: f.path)


def _line_start(file, at: int) -> int:
    """Where the line that holds byte ``at`` begins."""
    while at > 0:
        low = max(0, at - _STEP)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines(file, start: int, end: int, last: bool) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines whose line feed lies in [start, end); at the last range of a
    file that is whole, also the line after the last line feed."""
    place = _line_start(file, start)
    file.seek(place)
    rest = b""
    read = place
    while read < end:
        rest += (piece := file.read(min(_STEP, end - read)))
        if not piece:
            break
        read += len(piece)
        *whole, rest = rest.split(b"\n")
        for line in whole:
            yield place, line
            place += len(line) + 1
    if last and rest:
        yield place, rest


def _record(place: int, line: bytes) -> tuple[int, str | None, str | None] | None:
    if not line.strip():
        return None
    try:
        text = line.decode()
        json.loads(text)
        return place, text, None
    except (UnicodeDecodeError, json.JSONDecodeError) as why:
        return place, line.decode(errors="replace"), f"{type(why).__name__}: {why}"


class _Reading:
    """What batch and stream reading have in common."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.feed = options.get("records", "lines") == "feed"
        self.split = int(options.get("splitBytes", 64 << 20))

    def ranges(self, file: str, start: int, end: int, last: bool) -> list[Range]:
        if self.feed:
            return [Range(file, 0, end, True)]
        cuts = [*range(start, end, self.split), end]
        return [Range(file, a, b, last and b == end) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # no file, no range
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        name = partition.file.rsplit("/", 1)[-1]
        with store.open_input_file(partition.file) as file:
            if self.feed:
                body = file.read(partition.end)
                items = list(_ITEM.finditer(body))
                for item in items:
                    yield name, item.start(), item.group().decode(errors="replace"), None
                if not items:
                    yield name, 0, body.decode(errors="replace"), "no items"
                return
            for place, line in lines(file, partition.start, partition.end, partition.last):
                found = _record(place, line)
                if found:
                    yield name, *found


class TailReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for f in _files(self.path)[1] if f.size for r in self.ranges(f.path, 0, f.size, True)]


class TailStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.path: f.size for f in _files(self.path)[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, size in sorted(end.items()):
            seen = start.get(file, 0)
            if size and size != seen:
                out += self.ranges(file, 0 if size < seen else seen, size, False)
        return out

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)
