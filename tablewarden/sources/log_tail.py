"""Logs that are still being written, as a stream of their whole lines.

Spark's file source takes a file once, as it is when it is seen; what is appended later is lost. Here the
stream's offset tells for each file how many bytes have been read, always up to the end of a line: a line whose
break has not come yet waits for it, wherever a write was cut. So nothing is lost or doubled when a log grows,
also in the middle of a line or of a character.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tablewarden_log_tail"
#: Bytes of a file that one task reads, and that are looked at together for its last line break.
SPLIT, BLOCK = 64 << 20, 1 << 20


class Stretch(InputPartition):
    """Lines of a file that begin at `start` or later and before `end`; none goes past `stop`."""

    def __init__(self, file: str, first: int, start: int, end: int, stop: int):
        self.file, self.first, self.start, self.end, self.stop = file, first, start, end, stop


class LogTail(DataSource):
    """Option `path`: a folder, or any location that Arrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string, file string, at long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of the last whole line

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file the end of its last whole line."""
        system, folder = self._folder()
        ends = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            if self.seen.get(info.base_name, (-1, 0))[0] != info.size:
                self.seen[info.base_name] = (info.size, self._last_break(system, info.path, info.size))
            if end := self.seen[info.base_name][1]:
                ends[info.base_name] = end
        return ends

    def _last_break(self, system: fs.FileSystem, path: str, size: int) -> int:
        with system.open_input_file(path) as file:
            end = size
            while end:
                start = max(0, end - BLOCK)
                at = file.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            if stop < first:  # the file was begun anew
                first = 0
            for at in range(first, stop, self.split):
                found.append(Stretch(file, first, at, min(at + self.split, stop), stop))
        return found

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, folder = self._folder()
        with system.open_input_file(f"{folder.rstrip('/')}/{partition.file}") as raw:
            at = partition.start
            if at > partition.first:
                at = self._next_line(raw, at - 1, partition.stop)  # a line that began before belongs to the task before
            rest = b""
            while at - len(rest) < partition.end:
                block = raw.read_at(min(BLOCK, partition.stop - at), at) if at < partition.stop else b""
                begin = at - len(rest)
                *lines, rest = (rest + block).split(b"\n")
                at += len(block)
                for line in lines:
                    if begin >= partition.end:
                        return
                    text = line.removesuffix(b"\r")
                    if text:
                        yield text.decode("utf-8", "replace"), partition.file, begin
                    begin += len(line) + 1
                if not block:
                    return

    @staticmethod
    def _next_line(raw, at: int, stop: int) -> int:
        while at < stop:
            block = raw.read_at(min(BLOCK, stop - at), at)
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return stop


def tail_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream of (line, file, at) of the logs in a folder, as they grow; blank lines are left out, either ending will do.

    ``at`` is the line's first byte. A file that has become shorter is taken to be begun anew. The offset holds one
    number for each file, so finished logs should be moved away. The folder is read by Arrow's file systems, on
    the driver and in tasks; where only Spark can read it, use :func:`run_log.stream_lines`.
    """
    spark.dataSource.register(LogTail)
    return spark.readStream.format(NAME).options(path=path, **options).load()


# Python workers get this code with the job; nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
