"""Merges of whole records: the closure of a merge plan, and every table that names the merged rows rewritten by it.

A plan is a mapping (loser, survivor). Rows are range-sorted by loser, and each task first follows the chains inside its range. Then only losers that another row still
names go on: they end at one survivor by pointer jumping, where each round doubles the steps that every row has gone, so a chain of n such rows takes log2(n) rounds. All
other rows look up their end once. A round joins rows that are unique by key, so a survivor that most rows name is split by adaptive execution. Rounds are
stored in the shared folder; the one before is deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators.stored import discard, fresh_dir, store

# The fields of an opinion, and those of a judge, that a survivor takes from its losers where its own are empty.
OPINION_FIELDS = (
    "reporter_cite", "external_id", "disposition", "disposition_bucket", "html_content", "source_url", "holding_summary", "holding_source_paras", "holding_review_status", "holding_reviewed_by",
    "holding_reviewed_at", "holding_extracted_at", "holding_model", "reviewed_by", "reviewed_at", "review_notes", "pdf_file",
)
JUDGE_FIELDS = ("bio_url", "bio_summary", "photo_url", "external_id", "source_id", "appointment_date", "is_currently_seated", "court_id", "status", "role")
NOTHING = ("", "UNKNOWN", "false", "[]")


def closure(plan: DataFrame) -> DataFrame:
    """loser, survivor: each loser with the last survivor that it leads to.

    A loser of several survivors follows the smallest; rows that name themselves or nothing are left out. Where rows lead to each
    other in a circle, the smallest of the circle survives."""
    spark, paths = plan.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(fresh_dir(spark, "merge-closure"))
        return store(df, paths[-1])

    first = plan.where("loser <> survivor").repartitionByRange("loser").groupBy("loser").agg(F.min("survivor").alias("at"))
    rows = store(shortened(first), fresh_dir(spark, "merge-plan"))
    named = rows.select(F.col("at").alias("loser")).distinct()
    inner = kept(rows.join(named, "loser", "left_semi"))
    rounds = math.ceil(math.log2(inner.count() + 1)) + 1
    for k in range(rounds + 1):
        hop = inner.join(inner.select(F.col("at").alias("loser")).distinct(), "loser", "left_semi").select(F.col("loser").alias("mid"), F.col("at").alias("last"), F.col("least").alias("low"))
        if hop.isEmpty():
            ends = inner.select(F.col("loser").alias("mid"), F.col("at").alias("last"))
            break
        joined = inner.join(hop, F.col("at") == F.col("mid"), "left")
        if k == rounds:  # what still leads on leads in a circle: every row of it has seen all of it
            ends = joined.select(F.col("loser").alias("mid"), F.coalesce("low", "at").alias("last"))
            break
        inner = kept(joined.select("loser", F.coalesce("last", "at").alias("at"), F.least("least", F.coalesce("low", "least")).alias("least")))
        discard(spark, paths.pop(0))
    whole = rows.join(ends, F.col("at") == F.col("mid"), "left").select("loser", F.coalesce("last", "at").alias("survivor")).where("loser <> survivor")
    return store(whole, fresh_dir(spark, "merge-ends"))  # every table that names the rows reads it


def shortened(rows: DataFrame) -> DataFrame:
    """loser, at, least: rows (loser, at; unique by loser) that lead to the first row outside of their partition, and the smallest loser on the way, themselves
    included. What leads into a circle inside of a partition stays as it is. A partition is held in whole, 24 bytes a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        loser, own = (c.to_numpy() for c in pa.Table.from_batches(held).sort_by("loser").columns)
        at, least = own.copy(), loser.copy()
        place = lambda ids: np.minimum(np.searchsorted(loser, ids), len(loser) - 1)
        for _ in range(len(loser).bit_length() + 1):
            next_ = place(at)
            inside = loser[next_] == at
            if not inside.any():
                break
            at, least = np.where(inside, at[next_], at), np.where(inside, np.minimum(least, least[next_]), least)
        else:  # more steps than rows: these lead into a circle
            at, least = np.where(inside, own, at), np.where(inside, loser, least)
        for k in range(0, len(loser), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (loser, at, least)], ["loser", "at", "least"])

    longs = rows.select(F.col("loser").cast("long"), F.col("at").cast("long"))
    return longs.mapInArrow(run, "loser long, at long, least long")


def discovered_pairs(opinions: DataFrame) -> DataFrame:
    """loser, survivor: an opinion whose docket is not in its canonical spelling, and the first of its court that has that spelling, with one date and
    captions that agree (a missing caption agrees with any). The canonical row always survives, since its address can be reached."""
    rows = opinions.select("id", "court_id", "release_date", "title", "case_number", S.canonical_case_number(F.col("case_number")).alias("canonical"))
    own = rows.groupBy("court_id", "release_date", F.col("case_number").alias("canonical")).agg(F.min_by(F.struct("id", "title"), "id").alias("s"))
    pairs = rows.where("canonical <> case_number").join(own, ["court_id", "release_date", "canonical"])
    return gated(pairs.select(F.col("id").alias("loser"), F.col("s.id").alias("survivor"), "title", F.col("s.title").alias("its_title"))).select("loser", "survivor")


def gated(pairs: DataFrame) -> DataFrame:
    return pairs.where(S.captions_compatible(F.col("title"), F.col("its_title")))


def reviewed_pairs(pairs: DataFrame, opinions: DataFrame, trust_titles: bool = False) -> DataFrame:
    """Those of the given pairs (loser, survivor) whose rows exist, in one court and on one date, and whose captions agree (unless that was looked at)."""
    side = lambda name, t: opinions.select(F.col("id").alias(name), F.col("court_id").alias(f"{t}court"), F.col("release_date").alias(f"{t}date"), F.col("title").alias(f"{t}title"))
    rows = pairs.select("loser", "survivor").join(side("loser", ""), "loser").join(side("survivor", "its_"), "survivor").where("court = its_court AND date = its_date")
    return (rows if trust_titles else gated(rows)).select("loser", "survivor")


def filled(c: str | Column) -> Column:
    """Whether a field says anything."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return ~text.isin(*NOTHING)


def carried(rows: DataFrame, plan: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """The rows that stay, with empty fields taken from their losers: of several that have a field, the smallest loser's. Only losers are shuffled and aggregated."""
    fields = tuple(f for f in fields if f in rows.columns)
    lost = rows.select(key, *fields).join(plan.select(F.col("loser").alias(key), "survivor"), key)
    best = lost.groupBy(F.col("survivor").alias(key)).agg(*[F.min_by(F.when(filled(f), F.col(f)), F.when(filled(f), F.col(key))).alias(f"#{f}") for f in fields])
    stay = rows.join(plan.select(F.col("loser").alias(key)), key, "left_anti").join(best, key, "left")
    return stay.select(*[F.when(filled(c), F.col(c)).otherwise(F.coalesce(F.col(f"#{c}"), F.col(c))).alias(c) if c in fields else F.col(c) for c in rows.columns])


def parted(rows: DataFrame, plan: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay as they are, and rows of losers with ``#from`` and the survivor's key."""
    p = plan.select(F.col("loser").alias(key), "survivor")
    own = rows.join(p.select(key), key, "left_anti")
    moved = rows.join(p, key).withColumn("#from", F.col(key)).withColumn(key, F.col("survivor")).drop("survivor")
    return own, moved


def moved_unless_any(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """What is derived from a text (statutes, holdings): a survivor keeps its own, else takes those of its smallest loser that has any."""
    own, moved = parted(rows, plan, key)
    fresh = moved.join(own.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min("#from").alias("#from"))
    return own.unionByName(fresh.join(first, [key, "#from"], "left_semi").drop("#from"))


def moved_unless_same(rows: DataFrame, plan: DataFrame, key: str, unique: tuple[str, ...]) -> DataFrame:
    """What is unique by row and ``unique`` (votes, parallel cites, tags): a survivor's own rows win, then those of the smallest loser."""
    own, moved = parted(rows, plan, key)
    same = [key, *unique]
    fresh = moved.join(own.select(*same), same, "left_anti")
    rest = [F.col(c) for c in rows.columns if c not in same]
    one = F.row_number().over(Window.partitionBy(*same).orderBy("#from", *rest))
    return own.unionByName(fresh.withColumn("#n", one).where("`#n` = 1").select(*rows.columns))


def moved_all(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    own, moved = parted(rows, plan, key)
    return own.unionByName(moved.select(*rows.columns))


def moved_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Citations (citing_id, cited_id, cite, source, ...) between the rows that stay.

    A citation that would lead to itself goes. One that moves at its citing end goes where that row has one with equal cited_id, cite and source; one
    that moves at its cited end, where there is one with equal citing_id, cited_id and source. Citations that do not move win, then the smallest ids. Rows that no
    loser is in are not shuffled for that; of those that move, only the first of equal citing_id, cited_id, cite and source goes on, found before the shuffle."""
    a, b = (plan.select(F.col("loser").alias(c), F.col("survivor").alias(f"#{c}")) for c in ("citing_id", "cited_id"))
    rows = edges.join(a, "citing_id", "left").join(b, "cited_id", "left")
    out, into = F.col("#citing_id").isNotNull(), F.col("#cited_id").isNotNull()
    own = rows.where(~(out | into)).select(*edges.columns)
    moved = rows.where(out | into).withColumns({"#out": out, "#into": into, "#a": F.col("citing_id"), "#b": F.col("cited_id")})
    moved = moved.withColumns({"citing_id": F.coalesce("#citing_id", "citing_id"), "cited_id": F.coalesce("#cited_id", "cited_id")}).where("cited_id IS NULL OR cited_id <> citing_id")
    same = ("citing_id", "cited_id", "cite", "source")
    rest = [c for c in edges.columns if c not in same]
    moved = moved.groupBy(*same).agg(F.min(F.struct("#a", "#b", *rest, "#out", "#into")).alias("r")).select(*same, *[F.col("r").getField(c).alias(c) for c in ("#a", "#b", *rest, "#out", "#into")])
    near = own.join(moved.select("citing_id").distinct(), "citing_id", "left_semi").withColumns({c: F.lit(False) for c in ("#out", "#into")} | {"#a": F.col("citing_id"), "#b": F.col("cited_id")})
    columns = [*edges.columns, "#out", "#into", "#a", "#b"]
    both = near.select(*columns).unionByName(moved.select(*columns))
    order = [F.col("#out") | F.col("#into"), "#a", "#b", *[F.col(c) for c in edges.columns if c not in ("citing_id", "cited_id")]]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = both.withColumns({"#x": place("citing_id", "cited_id", "cite", "source"), "#y": place("citing_id", "cited_id", "source")})
    gone = (F.col("#out") & (F.col("#x") > 1)) | (F.col("#into") & (F.col("#y") > 1))
    return own.unionByName(ranked.where((F.col("#out") | F.col("#into")) & ~gone).select(*edges.columns))


#: How each table that names an opinion moves: its key's column is opinion_id.
CHILDREN = {
    "votes": lambda rows, plan: moved_unless_same(rows, plan, "opinion_id", ("judge_id",)),
    "statutes": lambda rows, plan: moved_unless_any(rows, plan, "opinion_id"),
    "holdings": lambda rows, plan: moved_unless_any(rows, plan, "opinion_id"),
    "parallel_cites": lambda rows, plan: moved_unless_same(rows, plan, "opinion_id", ("cite",)),
    "tag_suggestions": lambda rows, plan: moved_unless_same(rows, plan, "opinion_id", ("tag_id",)),
    "tags": lambda rows, plan: moved_unless_same(rows, plan, "opinion_id", ("tag_id",)),
    "parse_logs": lambda rows, plan: moved_all(rows, plan, "opinion_id"),
    "vectors": lambda rows, plan: rows.join(plan.select(F.col("loser").alias("opinion_id")), "opinion_id", "left_anti"),
    "edges": moved_edges,
}


def merge_opinions(tables: dict[str, DataFrame], plan: DataFrame) -> dict[str, DataFrame]:
    """``opinions`` and the tables of CHILDREN that are given, after the merges of ``plan``."""
    whole = closure(plan)
    return {name: carried(df, whole, OPINION_FIELDS) if name == "opinions" else CHILDREN[name](df, whole) for name, df in tables.items()}


def merge_judges(judges: DataFrame, votes: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judges and votes after the merges of ``plan``: fields carried, and one vote for each opinion and judge, the strongest. Only votes on opinions that a loser
    voted on are aggregated; all others pass as they are."""
    whole = closure(plan)
    p = whole.select(F.col("loser").alias("judge_id"), "survivor")
    touched = votes.join(p, "judge_id").select("opinion_id").distinct()
    mixed = votes.join(touched, "opinion_id", "left_semi").join(p, "judge_id", "left").withColumn("judge_id", F.coalesce("survivor", "judge_id"))
    one = mixed.groupBy("opinion_id", "judge_id").agg(F.max_by("vote_type", F.struct(S.vote_rank(F.col("vote_type")), "vote_type")).alias("vote_type"))
    return carried(judges, whole, JUDGE_FIELDS), votes.join(touched, "opinion_id", "left_anti").select("opinion_id", "judge_id", "vote_type").unionByName(one)
