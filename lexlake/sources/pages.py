"""A data source for saved pages of a paginated JSON API: one partition per chain of pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, docket_number string, case_name string, date_filed string, court_id string, page string"


class FirstPage(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SavedPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.starts = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.most = int(options.get("maxrows", "0"))

    def partitions(self) -> list[InputPartition]:
        return [FirstPage(p) for p in self.starts]

    def read(self, partition: FirstPage) -> Iterator[tuple]:
        from pyarrow import fs

        path, seen, n = partition.path, set(), 0
        while path and path not in seen:
            seen.add(path)
            system, at = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
            with system.open_input_stream(at) as f:
                page = json.loads(f.read())
            for r in page.get("results") or ():
                yield tuple(None if r.get(k) is None else str(r[k]) for k in ("id", "docket_number", "case_name", "date_filed", "court_id")) + (path,)
                n += 1
                if self.most and n >= self.most:
                    return
            path = page.get("next")


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").option("path", "first1.json,first2.json")``; "next" of a page is the path of the following one."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SavedPagesReader(self.options)
