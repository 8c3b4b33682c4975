"""A growing list of API pages, saved crawl by crawl, as a table and as a stream.

``<path>/<crawl>/<n>.json`` is page n of a crawl, newest items first (by id); crawls are named in the order of their time, and one counts once it holds ``_SUCCESS``. A crawl may
hold the whole list, or only the pages down to what was known. Each item is read once: an offset is the last crawl and the newest id so far, so a batch needs only the
pages of later crawls above that id. The driver finds the last such page by halving, with a few pages read; a partition is a page, or a run of pages where they are many.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lexlake.operators.numbering import with_position

SCHEMA = "id bigint, docket_number string, case_name string, date_filed string, court_id string, opinion_ids array<bigint>, crawl string, page int"
DONE = "_SUCCESS"
NOTHING = {"crawl": "", "newest": -1}
#: A crawl of up to this many pages is read page by page. Of more, as many pages are read at once as make this many runs, but not over LONGEST_RUN.
RUNS, LONGEST_RUN = 128, 128


def number_of(x: object) -> int | None:
    """A whole number, of a number, a record with an id, or an address that ends in one."""
    if isinstance(x, dict):
        return number_of(x.get("id"))
    if type(x) is int and x >= 0:
        return x
    m = re.search(r"(\d+)/?$", str(x)) if x is not None and not isinstance(x, bool | float) else None
    return int(m[1]) if m else None


@functools.lru_cache(10_000)
def named(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()


def normalised(raw: dict) -> dict:
    """An item with keys in small letters and underscores, its id, and the ids of its opinions, whichever way the endpoint writes them."""
    item = {named(k): v for k, v in raw.items()}
    item["id"] = number_of(item.get("id") if item.get("id") is not None else item.get("cluster_id"))
    parts = item["opinions"] if item.get("opinions") is not None else item.get("sub_opinions")
    item["opinion_ids"] = [n for n in map(number_of, parts or ()) if n is not None]
    return item


class Feed:
    """Crawls and pages of a folder, in any store that pyarrow reaches. Items without an id have no place in the order and are left out."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs = fs
        self.system, self.root = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")

    def names(self, path: str) -> list[str]:
        return [f.base_name for f in self.system.get_file_info(self.fs.FileSelector(path, allow_not_found=True))]

    def crawls(self) -> list[str]:
        return sorted(c for c in self.names(self.root) if self.system.get_file_info(f"{self.root}/{c}/{DONE}").type != self.fs.FileType.NotFound)

    def pages(self, crawl: str) -> int:
        return max((int(m[1]) for n in self.names(f"{self.root}/{crawl}") if (m := re.fullmatch(r"(\d+)\.json", n))), default=0)

    def items(self, crawl: str, page: int) -> list[dict]:
        with self.system.open_input_stream(f"{self.root}/{crawl}/{page}.json") as f:
            return [x for x in map(normalised, json.loads(f.read()).get("results") or ()) if x["id"] is not None]

    @functools.cached_property
    def tops(self) -> dict[str, int]:
        return {}

    def top(self, crawl: str) -> int:
        """The newest id of a crawl, -1 if it is empty. Crawls do not change once they count."""
        if crawl not in self.tops:
            first = next((x for k in range(1, self.pages(crawl) + 1) if (x := self.items(crawl, k))), [])
            self.tops[crawl] = max((x["id"] for x in first), default=-1)
        return self.tops[crawl]

    def newer(self, crawl: str, known: int) -> int:
        """The last page that holds an id above ``known``, 0 if none does."""
        low, high = 0, self.pages(crawl)  # up to low there are such ids, after high there are none
        while low < high:
            middle = page = (low + high + 1) // 2
            while page <= high and not (found := self.items(crawl, page)):
                page += 1
            if page <= high and max(x["id"] for x in found) > known:
                low = page
            else:
                high = middle - 1
        return low


@dataclass
class Pages(InputPartition):
    crawl: str
    first: int
    last: int
    known: int


class FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    @functools.cached_property
    def feed(self) -> Feed:
        return Feed(self.path)

    def __getstate__(self) -> dict:
        return {"path": self.path}

    def initialOffset(self) -> dict:
        return dict(NOTHING)

    def latestOffset(self) -> dict:
        crawls = self.feed.crawls()
        return {"crawl": crawls[-1], "newest": max(map(self.feed.top, crawls))} if crawls else dict(NOTHING)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known, out = start["newest"], []
        for crawl in self.feed.crawls():
            if start["crawl"] < crawl <= end["crawl"]:
                pages = self.feed.newer(crawl, known)
                run = min(-(-pages // RUNS), LONGEST_RUN) or 1
                out += [Pages(crawl, k, min(k + run - 1, pages), known) for k in range(1, pages + 1, run)]
                known = max(known, self.feed.top(crawl))
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        before, rows = partition.first - 1, []
        while before and not (rows := self.feed.items(partition.crawl, before)):
            before -= 1
        for page in range(partition.first, partition.last + 1):
            last = min((x["id"] for x in rows), default=None)  # items that moved down a page while the crawl went on stand on two
            rows = (own := self.feed.items(partition.crawl, page)) or rows
            for x in own:
                if x["id"] > partition.known and (last is None or x["id"] < last):
                    last = x["id"]
                    yield (x["id"], *(None if x.get(k) is None else str(x[k]) for k in ("docket_number", "case_name", "date_filed", "court_id")), x["opinion_ids"], partition.crawl, page)

    def commit(self, end: dict) -> None:
        """Nothing to release: a crawl stays until someone deletes it. All but the last may go once they are read."""


class FeedTable(DataSourceReader):
    def __init__(self, options: dict):
        self.stream = FeedStream(options)

    def partitions(self) -> list[InputPartition]:
        return self.stream.partitions(dict(NOTHING), self.stream.latestOffset())

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return self.stream.read(partition) if partition else iter(())  # a table of no partitions is read as one that is None


class PageFeed(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("page_feed").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "page_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedTable(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


def save_pages(rows: DataFrame, item: Column, path: str, crawl: str, size: int = 500) -> None:
    """Save a table with a column id as a crawl, ``item`` being the record of a row. Places come from one range sort; a task writes its pages under temporary names and
    renames them, so one that runs again writes the same; ``_SUCCESS`` comes last."""
    placed = with_position(rows.select("id", item.alias("item")), F.desc("id"))
    page = F.ceil(F.col("pos") / size).cast("int").alias("page")
    pages = placed.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("x"))  # at most ``size`` rows each
    files = pages.select("page", F.to_json(F.struct(F.transform("x", lambda r: r["item"]).alias("results"))).alias("text"))
    Feed(path).system.create_dir(f"{Feed(path).root}/{crawl}", recursive=True)

    def write(part: Iterator) -> None:
        import uuid

        feed = Feed(path)
        for r in part:
            name = f"{feed.root}/{crawl}/{r.page}.json"
            aside = f"{name}.{uuid.uuid4().hex}"
            with feed.system.open_output_stream(aside) as f:
                f.write(r.text.encode())
            feed.system.move(aside, name)

    files.foreachPartition(write)
    with Feed(path).system.open_output_stream(f"{Feed(path).root}/{crawl}/{DONE}"):
        pass
