"""A streaming source of the lines of text files, a fixed number of lines at a time.

Spark's own file source counts files, not lines. Here an offset is a file and a byte in it, behind the last line taken;
a batch's end is found by reading its lines once on the driver, its lines by a task. Offsets are Spark's to keep, so a query
that starts again goes on behind the last batch it had finished.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Piece(InputPartition):
    """Bytes of a file, from the begin of a line to the end of one."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class LineReader(DataSourceStreamReader):
    """Lines of all files of a folder, by file name. The first line of a file is a header; blank lines aren't counted or read."""

    def __init__(self, folder: str, rows: int):
        self.folder, self.rows = folder, rows
        self.at: dict | None = None

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return sorted((f.path, f.size) for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_")))

    def _open(self, file: str):
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        return files.open_input_file(file)

    def _lines(self, file: str, begin: int, end: int, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
        """Place and bytes of each line that begins in a range; only as much is read as lines are taken."""
        with self._open(file) as f:
            f.seek(begin)
            rest, at, left = b"", begin, end - begin
            while left > 0 and (data := f.read(min(step, left))):
                left -= len(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    yield at, line
                    at += len(line) + 1
            if rest:
                yield at, rest

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        """Behind the next lines, as many as a batch has."""
        at = self.at = self.at or self.initialOffset()
        left = self.rows
        for file, size in self._files():
            if file < at["file"]:
                continue
            begin = at["byte"] if file == at["file"] else 0
            for place, line in self._lines(file, begin, size):
                if not left:
                    self.at = {"file": file, "byte": place}
                    return self.at
                left -= bool(place and line.strip())
            at = {"file": file, "byte": size}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = end  # also the first that a query which starts again asks for
        found = []
        for file, size in self._files():
            if start["file"] <= file <= end["file"]:
                begin, until = start["byte"] if file == start["file"] else 0, end["byte"] if file == end["file"] else size
                if begin < until:
                    found.append(Piece(file, begin, until))
        return found

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        for place, line in self._lines(partition.file, partition.begin, partition.end):
            if place and line.strip():
                yield partition.file, place, line.decode("utf-8", "replace")


class LocationLines(DataSource):
    """spark.readStream.format("location_lines") with options path (a folder) and rows (lines of a batch, 50).

    Files must be whole when they appear, and new ones must come later by name than those before.
    """

    @classmethod
    def name(cls) -> str:
        return "location_lines"

    def schema(self) -> str:
        return "file string, place bigint, line string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("rows", 50)))
