"""A sink for files of one ``{day, entries}`` object each, one file a day, as a Spark data source with a two-phase commit.

Tasks write whole files below a staging folder, under names of their own; the driver moves them into place when all
tasks are done, and drops the staging folder if one failed, so that a failed write leaves what was there before. Rows
``shard, typed, more`` (JSON texts) of a day must lie together in one partition, in the order that the file shall have; an entry
is written as it comes, so a task holds none but the current one. Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .entries import whole

FORMAT = "chronolith_day_files"


def file_name(day: str) -> str:
    """The file of a day; characters that a name can't have are escaped."""
    return quote(day, safe=" !#$&'()*+,;=@[]^`{|}~") + ".json"


def day_of(name: str) -> str:
    """The day of a file."""
    return unquote(name.removesuffix(".json"))


@dataclass
class Written(WriterCommitMessage):
    #: Temporary and final name of each file.
    files: list[tuple[str, str]] = field(default_factory=list)


class DayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "shard string, typed string, more string"

    def writer(self, schema, overwrite: bool) -> DayFileWriter:
        return DayFileWriter(self.options["path"])


class DayFileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f".writing-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.path)
        return system, base.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        system, base = self._open()
        system.create_dir(f"{base}/{self.staging}", recursive=True)
        message, out, current, seen = Written(), None, None, set()
        for shard, typed, more in rows:
            entry = whole(typed, more)
            if out is None or shard != current:
                if out is not None:
                    out.write(b"\n  ]\n}\n")
                    out.close()
                if shard in seen:
                    raise ValueError(f"rows of {shard} do not lie together")
                seen.add(shard)
                temporary = f"{self.staging}/{uuid.uuid4().hex}"
                message.files.append((temporary, file_name(shard)))
                out, current = system.open_output_stream(f"{base}/{temporary}"), shard
                out.write(f'{{\n  "day": {json.dumps(shard, ensure_ascii=False)},\n  "entries": [\n    {entry}'.encode())
            else:
                out.write(f",\n    {entry}".encode())
        if out is not None:
            out.write(b"\n  ]\n}\n")
            out.close()
        return message

    def commit(self, messages: list) -> None:
        system, base = self._open()
        moves = [m for message in messages if message for m in message.files]
        names = [final for _, final in moves]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("rows of a day lie in more than one partition")
        for temporary, final in moves:
            system.move(f"{base}/{temporary}", f"{base}/{final}")
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        system, base = self._open()
        if system.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.staging}")


def write(rows: DataFrame, path: str) -> None:
    """Replace the files of the days that ``rows`` hold; others stay."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(DayFiles)
    rows.select("shard", "typed", "more").write.format(FORMAT).mode("append").option("path", path).save()
