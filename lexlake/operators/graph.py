"""The citation graph: resolution of citations, edges, treatment, clusters of citing passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators.numbering import with_position
from lexlake.operators.stored import fresh_dir, store

# Phrases that tell how a court treats what it cites, strongest first. Read without regard to case.
TREATMENTS = (
    ("OVERRULED", r"\bwe\s+(?:hereby\s+|now\s+|today\s+|therefore\s+)?overrule(?:s|d)?\b|\b(?:is|are|was|were)\s+(?:hereby\s+)?overruled\b|\bhereby\s+overrul(?:e|ed)\b|\bno\s+longer\s+good\s+law\b"),
    ("DISTINGUISHED", r"\bdistinguishable\b(?!\s+between\b)|\bwe\s+(?:must\s+|now\s+|therefore\s+|thus\s+|further\s+|again\s+|also\s+)?distinguish(?:es|ed)?\b(?!\s+between\b)"),
    ("CRITICIZED", r"\bdeclin(?:e|ed|es|ing)\s+to\s+follow\b|\bcriticiz(?:e|ed|es|ing)\b|\bwe\s+(?:are\s+)?not\s+persuaded\s+by\b"),
    ("FOLLOWED", r"\bwe\s+(?:follow|adhere\s+to|reaffirm|again\s+hold|are\s+bound\s+by)\b|\bin\s+accordance\s+with\s+our\s+(?:holding|decision)\b"),
    ("EXPLAINED", r"\bas\s+(?:we\s+)?explained\s+in\b|\bwe\s+(?:explained|clarified)\b"),
)


def treatment(context: Column) -> Column:
    out = None
    for name, pattern in TREATMENTS:
        test = F.regexp_like(context, F.lit(f"(?i){pattern}"))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("CITED")


def cite_map(opinions: DataFrame, parallel: DataFrame | None = None) -> DataFrame:
    """cite -> opinion: own cites first, then parallel ones, then dockets that only one opinion has. Where a cite is not
    unique the oldest opinion, then the smallest id, keeps it."""
    own = opinions.where("reporter_cite <> ''").select(F.col("reporter_cite").alias("cite"), F.col("id").alias("opinion_id"), "release_date", F.lit(0).alias("prio"))
    spelled = opinions.groupBy("case_number").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("opinion_id"), F.min("release_date").alias("release_date"))
    case = S.canonical_case_number(F.when(F.col("n") > 0, F.col("case_number")))  # n is there so that no filter of cites goes below: each spelling is read once, not each opinion
    docket = spelled.withColumn("cite", case).where("cite <> ''").groupBy("cite").agg(F.sum("n").alias("n"), F.min("opinion_id").alias("opinion_id"), F.min("release_date").alias("release_date")).where("n = 1")
    every = own.unionByName(docket.select("cite", "opinion_id", "release_date", F.lit(2).alias("prio")))
    if parallel is not None:
        dated = parallel.join(opinions.select(F.col("id").alias("opinion_id"), "release_date"), "opinion_id")
        every = every.unionByName(dated.select("cite", "opinion_id", "release_date", F.lit(1).alias("prio")))
    return every.groupBy("cite").agg(F.min_by("opinion_id", F.struct("prio", "release_date", "opinion_id")).alias("opinion_id"))


def resolve_edges(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """citing_id, cited_id (null outside the corpus), cite, context, treatment: no self edges, one edge for each target that resolves and one
    for each cite that does not."""
    rows = found.join(mapping.withColumnRenamed("opinion_id", "cited_id"), "cite", "left").where("cited_id IS NULL OR cited_id <> citing_id")
    key = F.coalesce(F.col("cited_id").cast("string"), F.concat(F.lit("?"), F.col("cite")))
    best = F.min_by(F.struct("cite", "context", "cited_id"), F.struct("cite", "context"))
    return rows.groupBy("citing_id", key.alias("target")).agg(best.alias("b")).select("citing_id", "b.cited_id", "b.cite", "b.context", treatment(F.col("b.context")).alias("treatment"))


def citing_pairs(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """citing_id, cited_id: the different pairs of ``resolve_edges`` that resolve, without what the citing opinion says. Only cites that are found are looked up; they are stored
    once, and so are the pairs, which are asked more than once."""
    spark = found.sparkSession
    asked = store(mapping.join(found.select("cite").distinct(), "cite", "left_semi"), fresh_dir(spark, "asked-cites"))
    rows = found.select("citing_id", "cite").distinct().join(asked.select("cite", F.col("opinion_id").alias("cited_id")), "cite").where("cited_id <> citing_id")
    return store(rows.select("citing_id", "cited_id").distinct(), fresh_dir(spark, "citing-pairs"))


def most_cited(pairs: DataFrame) -> int | None:
    """The opinion that most opinions cite, of ``citing_pairs``; of equal ones that with the smallest id."""
    top = pairs.groupBy("cited_id").agg(F.count(F.lit(1)).alias("citing_count")).orderBy(F.desc("citing_count"), "cited_id").first()
    return top.cited_id if top else None


def replace_extracted(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after re-extraction: extracted edges of the opinions seen again go, all others stay."""
    seen = fresh.select("citing_id").distinct()
    return edges.where("source <> 'extracted'").unionByName(edges.where("source = 'extracted'").join(seen, "citing_id", "left_anti")).unionByName(fresh)


def bulk_edges(pairs: DataFrame, clusters: DataFrame, existing: DataFrame, citing_states: tuple[str, ...] = ("MN", "AZ")) -> DataFrame:
    """Edges between clusters as edges between opinions: both ends in the corpus, the citing one in a state, pairs that exist left out."""
    a = clusters.where(F.col("state_code").isin(*citing_states)).select(F.col("cluster_id").alias("citing_cluster_id"), F.col("opinion_id").alias("citing_id"))
    b = clusters.select(F.col("cluster_id").alias("cited_cluster_id"), F.col("opinion_id").alias("cited_id"))
    rows = pairs.join(a, "citing_cluster_id").join(b, "cited_cluster_id").select("citing_id", "cited_id").where("citing_id <> cited_id").distinct()
    return rows.join(existing.select("citing_id", "cited_id"), ["citing_id", "cited_id"], "left_anti")


def prefer_extracted(edges: DataFrame) -> DataFrame:
    """One edge for each pair, extracted before bulk; edges that point outside all stay."""
    w = Window.partitionBy("citing_id", "cited_id").orderBy(F.when(F.col("source") == "extracted", 0).otherwise(1), "cite")
    known = edges.where("cited_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return known.unionByName(edges.where("cited_id IS NULL"))


def cited_by(edges: DataFrame) -> DataFrame:
    """Edges and different citing opinions of each cited opinion."""
    return edges.where("cited_id IS NOT NULL").groupBy("cited_id").agg(F.count(F.lit(1)).alias("edge_count"), F.count_distinct("citing_id").alias("citing_count"))


def cited_by_page(edges: DataFrame, opinions: DataFrame, cited_id: int, page: int = 1, size: int = 50) -> DataFrame:
    """One page of the opinions that cite an opinion, newest first."""
    ids = edges.where(F.col("cited_id") == cited_id).select("citing_id").distinct()
    rows = opinions.join(ids, opinions.id == ids.citing_id, "left_semi").select("id", "title", "release_date")
    return rows.orderBy(F.desc("release_date"), "id").offset((page - 1) * size).limit(size)


def treatment_mix(edges: DataFrame) -> DataFrame:
    return edges.groupBy("treatment").agg(F.count(F.lit(1)).alias("n"))


def top_cited(edges: DataFrame, opinions: DataFrame, limit: int = 10) -> DataFrame:
    top = cited_by(edges).orderBy(F.desc("citing_count"), "cited_id").limit(limit)
    return top.join(opinions.select(F.col("id").alias("cited_id"), "title"), "cited_id").select("cited_id", "title", "citing_count", "edge_count")


BLOCK = 2048  # rows that are read in order, or compared, in one piece


def first_like(vectors: np.ndarray, seeds: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector the first seed that is at least ``threshold`` similar, or -1."""
    out = np.full(len(vectors), -1)
    for k in range(0, len(vectors) if len(seeds) else 0, 256):
        like = vectors[k : k + 256] @ seeds.T >= threshold
        out[k : k + 256] = np.where(like.any(axis=1), like.argmax(axis=1), -1)
    return out


def greedy_clusters(passages: DataFrame, threshold: float = 0.88, block: int = BLOCK) -> DataFrame:
    """Labels of the passages that cite one opinion (edge_id, cited_id, release_date, text_offset, quote, vector).

    Passages come newest first; each joins the first cluster whose first member is at least ``threshold`` similar, or
    starts one. The lead is the longest quote, the first on a tie. Passages without a vector are clusters of their own,
    and leads if they have a quote.

    Passages are numbered in that order and cut into blocks. In each round the first passages that are still without a
    cluster, at most ``block`` of an opinion, are read in order; all later ones are then compared with the clusters that
    these have started, block by block, and those like none go on. An earlier cluster comes first, as all passages of a round
    have been compared with all clusters before it. An opinion with n clusters takes at least n / ``block`` rounds."""
    spark = passages.sparkSession
    last, unlike = F.lit(2**63 - 1), F.col("cluster_label").isNull()
    age = F.coalesce(-F.unix_micros(F.col("release_date").cast("timestamp")), last)
    rows = passages.select(
        "edge_id", "cited_id", F.coalesce(F.col("cited_id").cast("string"), F.lit("")).alias("opinion"), age.alias("age"), F.coalesce(F.col("text_offset").cast("long"), last).alias("place"),
        F.length(F.coalesce("quote", F.lit(""))).alias("quoted"), F.when(F.size("vector") > 0, F.col("vector").cast("array<double>")).alias("vector"),
    )
    rows = with_position(rows, "opinion", "age", "place", "edge_id").withColumn("block", F.expr(f"(pos - 1) div {block}")).drop("age", "place")
    rows = store(rows, fresh_dir(spark, "passages"))

    def units(column: pd.Series) -> np.ndarray:
        v = np.stack(column.to_list()).astype(float)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(length == 0, 1, length)

    def read_in_order(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("pos")
        vectors, base = units(g["vector"]), int(g["base"].iloc[0])
        seeds, starts, labels = np.empty_like(vectors), [], []
        for k, v in enumerate(vectors):
            like = seeds[: len(starts)] @ v >= threshold
            found = int(like.argmax()) if like.any() else len(starts)
            if found == len(starts):
                seeds[found] = v
                starts.append(k)
            labels.append(base + found)
        begun = set(starts)
        return pd.DataFrame({"opinion": g["opinion"], "pos": g["pos"], "cluster_label": labels, "seed": [v if k in begun else None for k, v in enumerate(vectors)]})

    def compare(group: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        s = seeds.sort_values("cluster_label")
        at = first_like(units(group["vector"]), np.stack(s["seed"].to_list()), threshold) if len(group) else np.empty(0, int)
        labels = pd.Series(s["cluster_label"].to_numpy()[at] if len(at) else at, index=group.index, dtype="Int32").mask(at < 0)
        return group[["opinion", "block", "pos"]].assign(cluster_label=labels)

    kept, counted, k = fresh_dir(spark, "clusters"), [F.count(F.lit(1)).alias("n")], 0
    left, base = rows.where("vector IS NOT NULL"), spark.createDataFrame([], "opinion string, base int")
    while True:
        until = F.sum("n").over(Window.partitionBy("opinion").orderBy("block"))
        blocks = left.groupBy("opinion", "block").agg(*counted).withColumn("until", until).withColumn("first", (F.col("until") <= block) | (F.col("until") == F.col("n")))
        blocks = store(blocks.join(base, "opinion", "left").fillna(0, "base"), fresh_dir(spark, "blocks"))
        front = left.join(blocks.where("first").select("opinion", "block", "base"), ["opinion", "block"]).select("opinion", "pos", "base", "vector")
        labelled = store(front.groupBy("opinion").applyInPandas(read_in_order, "opinion string, pos long, cluster_label int, seed array<double>"), f"{kept}/front/round={k}")
        later = blocks.where("NOT first")
        if later.isEmpty():
            break
        span = later.groupBy("opinion").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        seeds = labelled.where("seed IS NOT NULL").join(span, "opinion").repartition("pos").select("opinion", F.explode(F.sequence("low", "high")).alias("block"), "cluster_label", "seed")
        rest = left.join(later.select("opinion", "block"), ["opinion", "block"], "left_semi").select("opinion", "block", "pos", "vector")
        compared = store(rest.groupBy("opinion", "block").cogroup(seeds.groupBy("opinion", "block")).applyInPandas(compare, "opinion string, block long, pos long, cluster_label int"), f"{kept}/rest/round={k}")
        if compared.where(unlike).isEmpty():
            break
        base = labelled.groupBy("opinion").agg((F.max("cluster_label") + 1).alias("base"))
        left, k = rows.join(compared.where(unlike).select("pos"), "pos", "left_semi"), k + 1

    read = lambda part: spark.read.schema("opinion string, pos long, cluster_label int").parquet(f"{kept}/{part}").select("opinion", "pos", "cluster_label")
    found = read("front")
    if k or not later.isEmpty():
        found = found.unionByName(read("rest").where(~unlike))
    in_clusters = rows.select("pos", "edge_id", "cited_id", "quoted").join(found, "pos")
    lead = in_clusters.groupBy("opinion", "cluster_label").agg(F.min_by("pos", F.struct(-F.col("quoted"), "pos")).alias("pos")).select("pos", F.lit(True).alias("lead"))
    in_clusters = in_clusters.join(lead, "pos", "left").select("edge_id", "cited_id", "cluster_label", F.coalesce("lead", F.lit(False)).alias("is_cluster_lead"))

    alone = rows.where("vector IS NULL").select("opinion", "block", "pos", "edge_id", "cited_id", "quoted")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("opinion").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clusters = found.groupBy("opinion").agg((F.max("cluster_label") + 1).alias("clusters"))
    offsets = alone.groupBy("opinion", "block").agg(*counted).withColumn("before", before).join(clusters, "opinion", "left").select("opinion", "block", (F.coalesce("clusters", F.lit(0)) + F.col("before")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("opinion", "block").orderBy("pos")) - 1
    alone = alone.withColumn("place", place).join(offsets, ["opinion", "block"]).select("edge_id", "cited_id", (F.col("offset") + F.col("place")).cast("int").alias("cluster_label"), (F.col("quoted") > 0).alias("is_cluster_lead"))
    return in_clusters.unionByName(alone)


def cited_how(passages: DataFrame, clusters: DataFrame, limit: int = 10) -> DataFrame:
    """Leads with a quote, the number of passages like each, largest clusters first, then newest; ``limit`` for each opinion. Passages without
    a label count as one group."""
    size = clusters.groupBy("cited_id", "cluster_label").agg(F.count(F.lit(1)).alias("size"))
    lead = clusters.where("is_cluster_lead").join(passages.select("edge_id", "quote", "release_date"), "edge_id").where("quote <> ''")
    rows = lead.join(size.withColumnsRenamed({"cited_id": "c", "cluster_label": "l"}), (F.col("cited_id") == F.col("c")) & F.col("cluster_label").eqNullSafe(F.col("l")))
    w = Window.partitionBy("cited_id").orderBy(F.desc("size"), F.desc("release_date"), "edge_id")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("cited_id", "edge_id", "quote", F.greatest(F.col("size") - 1, F.lit(0)).alias("similar_count"), "pos")
