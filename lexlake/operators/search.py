"""Search: routing, words, phrases, snippets, and exact vector similarity."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.functions import vectors as V

# Words that a query does not require, the shortest word, operator characters, the snippet window.
STOP_WORDS = frozenset("a about an are as at be by com de en for from how i in is it la of on or that the this to was what when where who will with und www".split())
LEAST_TOKEN = 3
OPERATORS = r'[+\-><()~*@"]'
SNIPPET_BACK, SNIPPET_LENGTH = 80, 240
CLOUD_SIZES = ("xs", "sm", "md", "lg", "xl")
WORD_BREAK = r"[^\p{L}\p{N}_]+"


def query_terms(q: str) -> list[str]:
    """Words of a query that must all occur."""
    return [w for w in re.sub(OPERATORS, " ", q).split() if len(w) >= LEAST_TOKEN and w.lower() not in STOP_WORDS]


def boolean_expression(q: str) -> str:
    return " ".join(f"+{w}" for w in query_terms(q))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(S.text_or_blank(text)), WORD_BREAK), lambda w: w != ""))


def match_all(docs: DataFrame, q: str, text: str = "text", key: str = "id", cap: int | None = None) -> DataFrame:
    """Documents with every term as a whole word, and whether there are more than ``cap``. Candidates come by key."""
    terms = [w.lower() for w in query_terms(q)]
    if not terms:
        return docs.limit(0).withColumn("capped", F.lit(False))
    # cheap containment first, whole words on what is left
    rough = docs
    for t in terms:
        rough = rough.where(F.contains(F.lower(F.col(text)), F.lit(t)))
    hits = rough.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(words(F.col(text)), t)))
    if cap is None:
        return hits.withColumn("capped", F.lit(False))
    first = hits.orderBy(key).limit(cap + 1)
    return first.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("capped", F.col("n") > cap).orderBy(key).limit(cap).drop("n")


def inverted_index(docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """token, key: for many queries over one corpus, written once and bucketed by token."""
    return docs.select(F.explode(words(F.col(text))).alias("token"), key)


def match_index(index: DataFrame, q: str, key: str = "id") -> DataFrame:
    terms = sorted({w.lower() for w in query_terms(q)})
    return index.where(F.col("token").isin(*terms)).groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(terms)).select(key)


def phrase_counts(docs: DataFrame, phrases: tuple[str, ...], text: str = "text") -> DataFrame:
    """Documents with each phrase as whole words; one pass over the texts."""
    low = F.lower(F.col(text))
    found = [F.count(F.when(F.contains(low, F.lit(p.lower())) & F.regexp_like(low, F.lit(rf"(?U)\b\Q{p.lower()}\E\b")), 1)) for p in phrases]
    row = docs.agg(F.array(*found).alias("n"))
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, phrases)).alias("tag"), F.col("n"))).alias("x")).select(F.col("x.tag").alias("tag"), F.col("x.n").alias("n"))


def tag_cloud(counts: DataFrame) -> DataFrame:
    """Tags that occur, in five sizes between the smallest and the largest count."""
    some = counts.where("n > 0")
    span = some.agg(F.min("n").alias("lo"), F.greatest(F.max("n") - F.min("n"), F.lit(1)).alias("span"))
    slot = F.least(F.floor((F.col("n") - F.col("lo")) / F.col("span") * len(CLOUD_SIZES)).cast("int"), F.lit(len(CLOUD_SIZES) - 1))
    return some.crossJoin(F.broadcast(span)).select("tag", "n", F.get(F.array(*map(F.lit, CLOUD_SIZES)), slot).alias("size"), F.row_number().over(Window.orderBy(F.desc("n"), F.lower("tag"))).alias("pos"))


def snippet(text: Column, q: str) -> Column:
    """The passage around the first match, marked; null without one."""
    at = F.instr(F.lower(text), F.lit(q.lower()))
    cut = F.substring(text, F.greatest(F.lit(1), at - SNIPPET_BACK), F.lit(SNIPPET_LENGTH))
    marked = S.highlight(S.html_escape(S.collapse(cut)), q)
    return F.when(at > 0, F.concat(F.lit("&hellip; "), marked, F.lit(" &hellip;")))


def substring_match(docs: DataFrame, q: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows where a column contains the query, without regard to case; "%" and "_" are plain characters."""
    test = None
    for c in columns:
        one = F.contains(F.lower(F.col(c)), F.lit(q.lower()))
        test = one if test is None else test | one
    return docs.where(test)


@dataclass(frozen=True)
class Route:
    kind: str  # cite, statute, docket, words or substring
    value: str


def route(q: str, known_cites: DataFrame | None = None, statutes: DataFrame | None = None, least_query: int = 4) -> Route:
    """How a query is answered. A known cite or statute wins; then what looks like a docket; then words; then substrings."""
    q = q.strip()
    if known_cites is not None and known_cites.where(F.lower("reporter_cite") == q.lower()).limit(1).count():
        return Route("cite", q)
    if statutes is not None and statutes.where(F.lower("reference_slug") == q.lower()).limit(1).count():
        return Route("statute", q.lower())
    if len(q) <= 24 and " " not in q and ("-" in q or re.match(r"[A-Za-z]\d", q)):
        return Route("docket", q)
    return Route("words" if len(q) >= least_query and query_terms(q) else "substring", q)


def search(opinions: DataFrame, q: str, cutoff: Column | None = None, disposition: str | None = None, page: int = 1, size: int = 50, cap: int = 200, statutes: DataFrame | None = None) -> DataFrame:
    """One page of results with snippets, newest first: one plan for the branch that the route picks. An over-broad word query
    is marked as capped, and then neither the date window nor snippets apply."""
    way = route(q, opinions, statutes)
    if way.kind == "cite":
        hits = opinions.where(F.lower("reporter_cite") == q.lower()).withColumn("capped", F.lit(False))
    elif way.kind == "statute":
        ids = statutes.where(F.lower("reference_slug") == way.value).select("opinion_id").distinct()
        hits = opinions.join(ids, opinions.id == ids.opinion_id, "left_semi").withColumn("capped", F.lit(False))
    elif way.kind == "docket":
        hits = substring_match(opinions, q, ("case_number",)).withColumn("capped", F.lit(False))
    elif way.kind == "words":
        hits = match_all(opinions, q, "raw_text", "id", cap)
    else:
        hits = substring_match(opinions, q, ("raw_text", "title", "case_number")).withColumn("capped", F.lit(False))
    if cutoff is not None:
        hits = hits.where(F.col("capped") | (F.col("release_date") >= cutoff))
    if disposition:
        hits = hits.where(S.disposition_bucket(F.col("disposition")) == disposition)
    paged = hits.orderBy(F.desc_nulls_last("release_date"), "id").offset((page - 1) * size).limit(size)
    return paged.select("id", "title", "release_date", "capped", F.when(~F.col("capped"), snippet(F.col("raw_text"), q)).alias("snippet"))


# --- vectors -----------------------------------------------------------------------------------------------------------------

def nearest(items: DataFrame, query: list[float], k: int = 10, key: str = "id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The k items nearest to a query by cosine distance: a scan and a top-k, no shuffle of the items."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in map(float, query)) ** 0.5
    return items.select(key, F.round(1 - V.cosine(F.col(vector), q, norm_b=F.lit(length)), digits).alias("distance")).orderBy("distance", key).limit(k)


def similar_items(items: DataFrame, source: DataFrame, k: int = 5, days: int | None = 3 * 365, key: str = "id", vector: str = "embedding", date: str | None = "release_date", digits: int = 6) -> DataFrame:
    """The k items most like the one in ``source``, itself left out, within some days on either side (all if its date is null). ``source`` is one row."""
    s = source.limit(1).select(F.col(key).alias("source_id"), F.col(vector).alias("sv"), V.norm(F.col(vector)).alias("sn"), *([F.col(date).alias("sd")] if date else []))
    rows = items.crossJoin(F.broadcast(s)).where(F.col(key) != F.col("source_id"))
    if date and days is not None:
        rows = rows.where(F.col("sd").isNull() | F.col(date).between(F.date_sub("sd", days), F.date_add("sd", days)))
    return rows.select("source_id", key, F.round(1 - V.cosine(F.col(vector), F.col("sv"), norm_b=F.col("sn")), digits).alias("distance")).orderBy("distance", key).limit(k).withColumn("similarity_pct", S.similarity_percent(F.col("distance")))


def tag_suggestions(items: DataFrame, tags: DataFrame, review: float = 0.25, auto: float = 0.40, most: int = 5, key: str = "id", vector: str = "embedding", done: DataFrame | None = None, digits: int = 6, most_tags: int = 1_000) -> DataFrame:
    """Tags (slug, embedding) for items: similarity above ``review``, the best few, applied at ``auto``. Items in ``done`` are left out. The tags are a
    dimension of checked size; its rows go into every task."""
    if not 0 < review <= auto <= 1:
        raise ValueError("0 < review <= auto <= 1 does not hold")
    if tags.limit(most_tags + 1).count() > most_tags:
        raise ValueError(f"more than {most_tags} tags")
    rows = items if done is None else items.join(done.select(key), key, "left_anti")
    t = tags.select(F.col("slug").alias("tag_slug"), F.col("embedding").alias("tv"), V.norm(F.col("embedding")).alias("tn"))
    scored = rows.withColumn("own", V.norm(F.col(vector))).crossJoin(F.broadcast(t)).withColumn("exact", V.cosine(F.col(vector), F.col("tv"), F.col("own"), F.col("tn"))).where(F.col("exact") > review)
    scored = scored.withColumn("confidence", F.round("exact", digits))
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "tag_slug")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select(key, "tag_slug", "confidence", F.when(F.col("exact") >= auto, "auto_applied").otherwise("pending").alias("status"), "pos")


def centroids(items: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each group."""
    long = items.select(group, F.posexplode(V.doubles(F.col(vector))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def stale_vectors(stored: DataFrame, opinions: DataFrame) -> DataFrame:
    """Stored rows whose (opinion_id, court_id, release_date) is no opinion with a vector any more."""
    own = opinions.where("embedding IS NOT NULL").select(F.col("id").alias("opinion_id"), "court_id", "release_date")
    return stored.join(own, ["opinion_id", "court_id", "release_date"], "left_anti")


def year_bounds(opinions: DataFrame) -> DataFrame:
    """First and last year of each court's opinions with a vector, and how many these are."""
    year = F.year("release_date")
    return opinions.where("embedding IS NOT NULL").groupBy("court_id").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(F.lit(1)).alias("n"))


def sync_vectors(opinions: DataFrame, path: str) -> None:
    """The slim vector table, partitioned by court and year. Partitions with an opinion are written anew; one whose opinions are all gone would stay
    as it is, so the folders of such (court, year) pairs are deleted: their number, not their rows, goes through the driver."""
    spark = opinions.sparkSession
    rows = opinions.where("embedding IS NOT NULL").select("court_id", F.year("release_date").alias("year"), "release_date", F.col("id").alias("opinion_id"), "embedding")
    rows.repartition("court_id", "year").sortWithinPartitions("release_date", "opinion_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("court_id", "year").parquet(path)
    stored = spark.read.parquet(path).select("court_id", "year").distinct()
    gone = stored.join(rows.select("court_id", "year").distinct(), ["court_id", "year"], "left_anti")
    for r in gone.toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/court_id={r.court_id}/year={r.year}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
