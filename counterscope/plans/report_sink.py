"""Text reports written by many tasks and published at once.

Each task writes its own part of the ordered lines under a name that no other attempt has and reports it to the
driver. Only then the driver drops what failed attempts left and gives the folder its final name, in one step: a report
is there as a whole, each line once, or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from counterscope.session import ship
from counterscope.sources.files import listed, opened

NAME = "report"


@dataclass
class Part(WriterCommitMessage):
    file: str
    lines: int


class ReportWriter(DataSourceWriter):
    """Parts are written beside the report and take its place when the job has ended well."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.folder = f"{self.path}.writing-{uuid.uuid4().hex}"
        if not overwrite and self._exists():
            raise FileExistsError(f"there is a report at {self.path}")

    def _exists(self) -> bool:
        files, at = opened(self.path)
        return files.get_file_info(at).type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Part:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.txt"
        files, at = opened(self.folder)
        files.create_dir(at, recursive=True)
        lines = 0
        with files.open_output_stream(f"{at}/{name}") as out:
            for row in iterator:
                out.write(row.line.encode() + b"\n")
                lines += 1
        return Part(name, lines)

    def commit(self, messages: list[Part | None]) -> None:
        files, at = opened(self.folder)
        target = opened(self.path)[1]
        files.create_dir(at, recursive=True)
        whole = {m.file for m in messages if m and m.lines}
        for info in listed(self.folder):
            if info.base_name not in whole:
                files.delete_file(f"{at}/{info.base_name}")
        old = f"{at}-old" if self.overwrite and self._exists() else None
        if old:
            files.move(target, old)
        files.move(at, target)
        if old:
            files.delete_dir(old)

    def abort(self, messages: list[Part | None]) -> None:
        files, at = opened(self.folder)
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class Report(DataSource):
    """Option: ``path``, the folder a report is published as."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publish the lines of a report (query_rank, line_no, line) in their order; ``append`` refuses to replace one."""
    spark = lines.sparkSession
    ship(spark)
    spark.dataSource.register(Report)
    lines.orderBy("query_rank", "line_no").select("line").write.format(NAME).mode(mode).save(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a published report; ``place`` numbers them within ``part``, and parts are in the order of their names."""
    parts = spark.read.option("wholetext", True).text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part")
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    return parts.select(name, F.posexplode(lines).alias("place", "line"))
