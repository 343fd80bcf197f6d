"""A paged service as a data source: a partition per page, from a folder of saved answers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veldspar.session import shared_folder


class PagedJson(DataSource):
    """``path``: folder with page-N.json, each an array of objects; columns of the given schema."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "repo string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], schema.fieldNames())


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("page-*.json"))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        for row in json.loads(Path(partition.value).read_text()):
            yield tuple(row.get(n) for n in self.names)


def read_saved(rows: DataFrame, page_rows: int) -> DataFrame:
    """``rows`` saved as pages of a service's answers in the shared folder, and read back through the source.

    ``rows`` stand for a listing (of repositories), which is small.
    """
    spark = rows.sparkSession
    folder = Path(f"{shared_folder(spark).removeprefix('file:')}/pages-{uuid.uuid4().hex}")
    folder.mkdir(parents=True)
    page: list[dict] = []
    number = 0
    for r in rows.toLocalIterator():
        page.append(r.asDict())
        if len(page) == page_rows:
            (folder / f"page-{number:06d}.json").write_text(json.dumps(page))
            page, number = [], number + 1
    if page:
        (folder / f"page-{number:06d}.json").write_text(json.dumps(page))
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").schema(rows.schema).load(str(folder))
