"""A stored inverted index with positions: words and phrases are answered from the folders of their tokens alone.

A posting row holds, for one token and one range of BLOCK keys, the keys of the texts that have the token and its places in each of them, all ascending
(Parquet's second format stores such numbers as packed differences). Rows stand in folders by bucket of the token, range-sorted by (bucket, token, block), so
that a token of a third of all texts is spread over many files, and row groups of other tokens are skipped. Tokens are runs of letters, digits and
underscores in lower case; places count tokens, so a phrase matches whatever stands between its words. Keys are integers; rows with a null
key or text have no postings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators.search import WORD_BREAK, query_terms

#: Keys of a block, and folders of an index.
BLOCK, BUCKETS = 1_024, 64


def tokens(text: Column) -> Column:
    """The words of a text in order, repeats included."""
    return F.filter(F.split(F.lower(S.text_or_blank(text)), WORD_BREAK), lambda w: w != "")


def gathered(docs: DataFrame) -> DataFrame:
    """token, block, p (key, at): for each Arrow batch of ``docs`` (key, words) a row for each token and block of keys, with the token's places in each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy()
            if not sizes.sum():
                continue
            coded = lists.flatten().dictionary_encode()
            code, text = coded.indices.to_numpy(), np.repeat(np.arange(len(key)), sizes)
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((place, key[text], code))
            code, text, place = code[order], text[order], place[order].astype(np.int32)
            keys = key[text]
            once = np.r_[True, (code[1:] != code[:-1]) | (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])]  # a key may stand in several rows
            code, keys, place = code[once], keys[once], place[once]
            block = keys // BLOCK
            new_row = np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]
            new_key = new_row | np.r_[True, keys[1:] != keys[:-1]]
            starts = np.flatnonzero(new_key)
            at = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)].astype(np.int32)), pa.array(place))
            entries = pa.StructArray.from_arrays([pa.array(keys[starts]), at], ["key", "at"])
            rows = np.flatnonzero(new_row)
            edges = np.r_[np.searchsorted(starts, rows), len(starts)].astype(np.int32)
            words = coded.dictionary.take(pa.array(code[rows]))
            yield pa.RecordBatch.from_arrays([words, pa.array(block[rows]), pa.ListArray.from_arrays(pa.array(edges), entries)], ["token", "block", "p"])

    return docs.select("key", "words").mapInArrow(run, "token string, block long, p array<struct<key:long,at:array<int>>>")


def postings(docs: DataFrame, text: str = "text", key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """bucket, token, block, n, keys, places: a row for each token and block of keys. Places are gathered before the shuffle, where a text's words stand
    together, and so are texts of one block that stand together; what is shuffled is a row for each different word of a batch and block."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), tokens(F.col(text)).alias("words"))
    listed = gathered(rows).groupBy("token", "block").agg(F.flatten(F.collect_list("p")).alias("p"))
    # a key that stands in several rows of the table has its places together
    keys = F.array_sort(F.array_distinct("p.key"))
    several = F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_sort(F.array_distinct(F.flatten(F.filter("p", lambda e: e["key"] == k)["at"]))).alias("at")))
    listed = listed.withColumn("p", F.when(F.size(keys) == F.size("p"), F.sort_array("p")).otherwise(several))
    return listed.select(F.pmod(F.crc32("token"), F.lit(buckets)).cast("int").alias("bucket"), "token", "block", F.size("p").alias("n"), F.col("p.key").alias("keys"), F.col("p.at").alias("places"))


class WordIndex:
    """An index in a folder; ``write`` makes one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def write(cls, docs: DataFrame, path: str, text: str = "text", key: str = "id", buckets: int = BUCKETS) -> WordIndex:
        rows, order = postings(docs, text, key, buckets), ("bucket", "token", "block")
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").options(compression="zstd", **{"parquet.writer.version": "v2"}).parquet(path)
        return cls(docs.sparkSession, path, buckets)

    def lists(self, words: set[str]) -> DataFrame:
        """The postings of some tokens: other folders are not opened."""
        rows = self.spark.read.schema("token STRING, block BIGINT, n INT, keys ARRAY<BIGINT>, places ARRAY<ARRAY<INT>>, bucket INT").parquet(self.path)
        return rows.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % self.buckets for w in words})) & F.col("token").isin(sorted(words)))

    def asked(self, wanted: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
        """The words of each query with their places in it, and the lists of them all. Queries come from the caller, so their number is small."""
        table = self.spark.createDataFrame([(q, k, w, len(ws)) for q, ws in wanted.items() for k, w in enumerate(ws)], "query STRING, shift INT, token STRING, needed INT")
        return F.broadcast(table), self.lists({w for ws in wanted.values() for w in ws})

    def texts_with_all(self, queries: list[str], cap: int | None = None) -> DataFrame:
        """query, key, capped: the texts with every term of a query; with ``cap`` the first of them by key, and whether there are more. Lists of a block meet, so
        blocks without one of the words end there."""
        table, lists = self.asked({q: sorted({w.lower() for w in query_terms(q)}) for q in queries if query_terms(q)})
        met = lists.join(table, "token").groupBy("query", "needed", "block").agg(F.collect_list("keys").alias("all")).where(F.size("all") == F.col("needed"))
        common = F.aggregate(F.slice("all", F.lit(2), F.col("needed")), F.get("all", F.lit(0)), F.array_intersect)
        found = met.select("query", F.explode(common).alias("key"))
        if cap is None:
            return found.withColumn("capped", F.lit(False))
        w = Window.partitionBy("query").orderBy("key")
        first = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap + 1)
        return first.withColumn("capped", F.max("n").over(Window.partitionBy("query")) > cap).where(F.col("n") <= cap).drop("n")

    def texts_with_phrase(self, phrases: list[str]) -> DataFrame:
        """query, key, times: the texts in which the words of a phrase follow each other, and how often they do: places less the word's shift, met word by word."""
        split = {p: [w for w in re.split(r"\W+", p.lower()) if w] for p in phrases}
        table, lists = self.asked({p: ws for p, ws in split.items() if ws})
        blocks = lists.join(table, "token")
        # only blocks that have all words of a phrase go on
        full = blocks.groupBy("query", "needed", "block").agg(F.count_distinct("shift").alias("n")).where("n = needed").select("query", "block")
        rows = blocks.join(full, ["query", "block"], "left_semi").select("query", "needed", "shift", F.explode(F.arrays_zip("keys", "places")).alias("e"))
        starts = F.transform("e.places", lambda p: p - F.col("shift"))
        met = rows.select("query", "needed", F.col("e.keys").alias("key"), starts.alias("starts")).groupBy("query", "needed", "key").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("needed"))
        times = F.size(F.aggregate(F.slice("all", F.lit(2), F.col("needed")), F.get("all", F.lit(0)), F.array_intersect))
        return met.select("query", "key", times.alias("times")).where("times > 0")

    def literally(self, found: DataFrame, docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
        """Those of the texts found (query, key) in which the phrase stands letter for letter, with nothing else between its words: only these texts are read through."""
        own = docs.select(F.col(key).cast("long").alias("key"), F.lower(F.col(text)).alias("low"))
        whole = F.concat(F.lit(r"(?U)\b\Q"), F.lower("query"), F.lit(r"\E\b"))
        return found.join(own, "key").where(F.contains("low", F.lower("query")) & F.regexp_like("low", whole)).drop("low")

    def phrase_counts(self, phrases: list[str], docs: DataFrame | None = None, text: str = "text", key: str = "id") -> DataFrame:
        """tag, n: the texts with each phrase; 0 where there is none. With ``docs`` phrases count letter for letter."""
        every, found = self.spark.createDataFrame([(p,) for p in phrases], "tag STRING"), self.texts_with_phrase(phrases)
        n = (found if docs is None else self.literally(found, docs, text, key)).groupBy(F.col("query").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
        return every.join(n, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
