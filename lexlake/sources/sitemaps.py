"""Sitemaps: addresses of opinions, judges, tags and statutes cut into files, and a sink that writes them as XML with a commit.

The sink is a Python data source. Each task writes its files under a staging folder of the job; only when all tasks have ended does the driver move the files of
those that count to their names, and the index, which names them all, comes last. A job that fails deletes its staging folder, so it leaves no file. Files are reached by
pyarrow's file systems, in any store that these know.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lexlake.functions import scalars as S
from lexlake.operators.numbering import with_position

# Addresses in a file, the namespace, and the names of files.
SIZE = 25_000
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
INDEX = "sitemap.xml"
STATIC = ("/", "/about/", "/how-we-differ/", "/privacy/", "/support/", "/request-state/")
STATIC_STATE = ("/opinions/", "/current-judges/", "/tag/", "/compare/judges/")


def sitemap_urls(opinions: DataFrame, judges: DataFrame, tags: DataFrame, statutes: DataFrame, host: str, size: int = SIZE) -> DataFrame:
    """file, pos, loc, lastmod of all addresses of a host: opinions (court_id, case_number, id) in that order, judges (slug, created), different tag and statute slugs, and the
    fixed pages. One range sort gives every row its place; places in a kind are that less the kind's first. Opinions are cut into files of ``size``, and so are other kinds
    where they are longer."""
    none = F.lit(None).cast("date").alias("lastmod")
    kind = lambda name, rows, path, *order, lastmod=none: rows.select(F.lit(name).alias("kind"), *[o.alias(f"o{k}") for k, o in enumerate(order)], F.concat(F.lit(host), path).alias("loc"), lastmod.alias("lastmod"))
    nothing, empty = F.lit(0).cast("long"), F.lit("")
    slugs = lambda df, c: df.select(F.col(c).alias("slug")).where("slug <> ''").distinct()
    page = lambda word: F.concat(F.lit(f"/{word}/"), F.col("slug"), F.lit("/"))
    fixed = opinions.sparkSession.createDataFrame([(k, p) for k, p in enumerate((*STATIC, *STATIC_STATE))], "k BIGINT, path STRING")
    rows = kind("opinions", opinions, F.concat(F.lit("/opinion/"), S.quote_path(F.col("case_number")), F.lit("/")), F.col("court_id").cast("long"), F.col("case_number"), F.col("id").cast("long"))
    rows = rows.unionByName(kind("judges", judges.where("slug <> ''"), page("judge"), nothing, F.col("slug"), nothing, lastmod=F.col("created").cast("date")))
    for name, df in (("tags", slugs(tags, "slug")), ("statutes", slugs(statutes, "slug"))):
        rows = rows.unionByName(kind(name, df, page(name[:-1]), F.lit(1).cast("long"), F.col("slug"), nothing))
    rows = rows.unionByName(kind("static", fixed, F.col("path"), F.col("k"), empty, nothing))
    first_tag = opinions.sparkSession.range(1).select(F.lit("tags").alias("kind"), nothing.alias("o0"), empty.alias("o1"), nothing.alias("o2"), F.lit(f"{host}/tag/").alias("loc"), none)
    placed = with_position(rows.unionByName(first_tag), "kind", "o0", "o1", "o2", "loc")
    counts = placed.groupBy("kind").agg(F.min("pos").alias("first"))  # a row for each kind
    own = placed.join(F.broadcast(counts), "kind").withColumn("pos", F.col("pos") - F.col("first"))
    chunk = F.floor(F.col("pos") / size).cast("long")
    name = F.concat(F.lit("sitemap-"), F.col("kind"), F.when((F.col("kind") == "opinions") | (chunk > 0), F.concat(F.lit("-"), chunk + 1)).otherwise(""), F.lit(".xml"))
    return own.select(name.alias("file"), (F.col("pos") - chunk * size).alias("pos"), "loc", "lastmod")


def write_sitemaps(urls: DataFrame, path: str, host: str) -> None:
    """Write the files and the index; what ``path`` held under such names before is replaced."""
    spark = urls.sparkSession
    spark.dataSource.register(SitemapXml)
    urls.select("file", "pos", "loc", F.col("lastmod").cast("string").alias("lastmod")).repartition("file").sortWithinPartitions("file", "pos").write.format("sitemap_xml").mode("overwrite").option("path", path).option("host", host).save()


def read_sitemaps(spark, path: str) -> DataFrame:
    """file, loc, lastmod of the files in a folder."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc STRING, lastmod STRING").load(f"{path}/sitemap-*.xml")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "loc", "lastmod")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # staged, final name


class SitemapWriter(DataSourceWriter):
    def __init__(self, path: str, host: str):
        self.path, self.host, self.staging = path, host, f"_staging-{uuid.uuid4().hex}"

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if ":" in self.path.split("/")[0] else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        system, at = self.store()
        system.create_dir(f"{at}/{self.staging}", recursive=True)
        files, out, name = [], None, None
        try:
            for row in iterator:
                if row.file != name:
                    if out:
                        self.end(out)
                    name, staged = row.file, f"{self.staging}/{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{at}/{staged}")
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">\n'.encode())
                    files.append((staged, name))
                when = f"<lastmod>{escape(row.lastmod)}</lastmod>" if row.lastmod else ""
                out.write(f"  <url><loc>{escape(row.loc)}</loc>{when}</url>\n".encode())
            if out:
                self.end(out)
                out = None
        finally:
            if out:
                out.close()
        return Written(files)

    @staticmethod
    def end(out) -> None:
        out.write(b"</urlset>\n")
        out.close()

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = self.store()
        moved = sorted((name, staged) for m in messages if m for staged, name in m.files)
        before = {posixpath.basename(f.path) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if posixpath.basename(f.path).startswith("sitemap")}
        for name, staged in moved:
            system.move(f"{at}/{staged}", f"{at}/{name}")
        system.create_dir(at, recursive=True)
        lines = [f"  <sitemap><loc>{escape(self.host)}/{escape(name)}</loc></sitemap>\n" for name, _ in moved]
        draft = f"{at}/{self.staging}-index"
        with system.open_output_stream(draft) as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{NAMESPACE}">\n{"".join(lines)}</sitemapindex>\n'.encode())
        system.move(draft, f"{at}/{INDEX}")
        for name in before - {n for n, _ in moved} - {INDEX}:
            system.delete_file(f"{at}/{name}")
        self.clear(system, at)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*self.store())

    def clear(self, system, at: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{at}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/{self.staging}")


class SitemapXml(DataSource):
    """``df.write.format("sitemap_xml")`` with rows (file, pos, loc, lastmod), sorted by file and pos in their partitions, each file in one partition."""

    @classmethod
    def name(cls) -> str:
        return "sitemap_xml"

    def schema(self) -> str:
        return "file STRING, pos BIGINT, loc STRING, lastmod STRING"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SitemapWriter(self.options["path"].rstrip("/"), self.options.get("host", ""))
