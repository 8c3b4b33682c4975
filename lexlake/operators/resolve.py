"""Entity resolution. Merges are mappings (loser -> survivor) that joins apply; nothing is updated row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S


def rename_plan(opinions: DataFrame) -> DataFrame:
    """Dockets that change: renamed, or skipped because the court has the new number already, or several rows want it."""
    rows = opinions.select("id", "court_id", "case_number", S.canonical_case_number(F.col("case_number")).alias("canonical"))
    want = rows.where("canonical <> trim(case_number)")
    held = rows.select("court_id", F.col("case_number").alias("canonical")).distinct().withColumn("taken", F.lit(True))
    counted = want.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("court_id", "canonical")))
    return counted.join(held, ["court_id", "canonical"], "left").select("id", "court_id", "case_number", "canonical", F.when(F.col("taken"), "collision").when(F.col("n") > 1, "internal").otherwise("rename").alias("action"))


def lookup_variants(docket: Column) -> Column:
    """Spellings to look for, in order."""
    canon = S.canonical_case_number(docket)
    with_no = F.when(~F.startswith(F.lower(F.ltrim(docket)), F.lit("no.")), F.array(F.concat(F.lit("No. "), docket), F.concat(F.lit("No. "), canon))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(docket, canon), with_no))


def docket_lookup(requests: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """The opinion that each requested docket (request_id, docket, want_level, want_date) stands for: the wanted date, else the
    newest of the wanted level with the largest id, else the highest court, newest, smallest id. Opinions are brought to one for each
    docket, docket and level, and docket, level and date first, and each request meets one row of each, so many requests for a docket of many opinions do not multiply."""
    op = opinions.select("id", "court_id", "case_number", "release_date").join(courts.select(F.col("id").alias("court_id"), F.col("level")), "court_id")
    by_date = op.groupBy("case_number", "level", "release_date").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    variants = requests.select("docket").distinct().select("docket", F.explode(lookup_variants(F.col("docket"))).alias("case_number"))
    hits = variants.join(by_date, "case_number").select("docket", "level", "release_date", "least", "most")
    rank = F.when(F.col("level") == "SUPREME", 0).when(F.col("level") == "APPEALS", 1).otherwise(9)
    day = F.coalesce(-F.unix_date("release_date"), F.lit(2**31 - 1))  # newest first, no date last
    first = lambda *order: F.min(F.struct(*order, "release_date")).alias("r")
    any_level = hits.groupBy("docket").agg(first(rank.alias("k"), day.alias("day"), F.col("least").alias("id"))).select(F.col("docket").alias("#docket"), F.struct("r.id", "r.release_date").alias("by_court"))
    level = hits.groupBy("docket", F.lower("level").alias("#level")).agg(first(day.alias("day"), (-F.col("most")).alias("id")))
    level = level.where("`#level` <> ''").select(F.col("docket").alias("#docket"), "#level", F.struct((-F.col("r.id")).alias("id"), "r.release_date").alias("by_level"))
    dates = hits.where("release_date IS NOT NULL").select("docket", F.explode(F.array_distinct(F.array(F.lit(""), F.lower("level")))).alias("#level"), "release_date", "least")
    dates = dates.groupBy(F.col("docket").alias("#docket"), "#level", F.col("release_date").alias("#date")).agg(F.min("least").alias("by_date"))
    asked = requests.select("request_id", "docket", "want_date", S.text_or_blank(F.lower(F.trim("want_level"))).alias("wanted"))
    rows = asked.join(any_level, F.col("docket") == F.col("#docket")).drop("#docket")
    rows = rows.join(level, (F.col("docket") == F.col("#docket")) & (F.col("wanted") == F.col("#level")), "left").drop("#docket", "#level")
    rows = rows.join(dates, (F.col("docket") == F.col("#docket")) & (F.col("wanted") == F.col("#level")) & (F.col("want_date") == F.col("#date")), "left")
    best = F.when(F.col("by_date").isNotNull(), F.struct(F.col("by_date").alias("id"), F.col("want_date").alias("release_date"))).otherwise(F.coalesce("by_level", "by_court"))
    return rows.select("request_id", "docket", best.alias("b")).select("request_id", "docket", F.col("b.id").alias("opinion_id"), "b.release_date")


def metadata_score() -> Column:
    """How much a judge's row tells; weights are fixed values."""
    has = lambda c: F.trim(S.text_or_blank(F.col(c))) != ""
    terms = [(has("bio_summary"), 4), (F.col("is_currently_seated"), 4), (has("photo_url"), 2), (has("bio_url"), 1), (F.col("appointment_date").isNotNull(), 1), (has("external_id"), 1),
             (F.col("court_id").isNotNull(), 1), (has("status") & (F.col("status") != "UNKNOWN"), 1), (has("role") & (F.col("role") != "UNKNOWN"), 1)]
    return sum((F.when(F.coalesce(t, F.lit(False)), w).otherwise(0) for t, w in terms), F.lit(0))


def judge_merge_plan(judges: DataFrame, votes: DataFrame) -> DataFrame:
    """loser, survivor, why: rows with one name, and bare surnames that can only be one full name of the state. The survivor has the best
    metadata, then most votes, then the smallest id. ``judges`` has the score in column ``score``."""
    n = votes.groupBy(F.col("judge_id").alias("id")).agg(F.count(F.lit(1)).alias("votes"))
    rows = judges.join(n, "id", "left").select("id", "state_code", "score", F.coalesce("votes", F.lit(0)).alias("votes"), S.name_key(F.col("full_name")).alias("key"), F.lower(S.surname(F.col("full_name"))).alias("surname"))
    rows = rows.withColumn("bare", F.col("key") == F.col("surname"))
    best = F.max_by("id", F.struct("score", "votes", -F.col("id")))
    same = rows.groupBy("state_code", "key").agg(best.alias("survivor"), F.count(F.lit(1)).alias("n"))
    exact = rows.join(same.where("n > 1"), ["state_code", "key"]).where("id <> survivor").select(F.col("id").alias("loser"), "survivor", F.lit("name").alias("why"))
    full = rows.where("NOT bare").groupBy("state_code", "surname").agg(F.count_distinct("key").alias("names"), best.alias("survivor"))
    # a bare row that is itself a duplicate follows its own survivor first
    shadow = rows.where("bare").join(full.where("names = 1"), ["state_code", "surname"]).join(exact.select(F.col("loser").alias("id")), "id", "left_anti").select(F.col("id").alias("loser"), "survivor", F.lit("surname").alias("why"))
    return exact.unionByName(shadow)


def hyphen_plan(judges: DataFrame) -> DataFrame:
    """loser, survivor: surnames that differ only in a hyphen; the hyphened row stays; pairs whose first names conflict are left out."""
    rows = judges.select("id", "state_code", S.name_key(F.col("full_name")).alias("key"), F.lower(S.surname(F.col("full_name"))).alias("surname"))
    rows = rows.withColumns({"flat": F.replace("surname", F.lit("-"), F.lit("")), "first": F.split("key", " ")[0], "bare": F.col("key") == F.col("surname")})
    a, b = rows.where("surname <> flat").alias("a"), rows.where("surname = flat").alias("b")
    pairs = a.join(b, (F.col("a.state_code") == F.col("b.state_code")) & (F.col("a.flat") == F.col("b.flat")))
    ok = F.col("a.bare") | F.col("b.bare") | (F.col("a.first") == F.col("b.first"))
    return pairs.where(ok).groupBy(F.col("b.id").alias("loser")).agg(F.min("a.id").alias("survivor"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def merge_votes(votes: DataFrame, plan: DataFrame) -> DataFrame:
    """Votes of the survivors: one for each opinion and judge, the strongest."""
    rows = votes.join(plan.select(F.col("loser").alias("judge_id"), "survivor"), "judge_id", "left").withColumn("judge_id", F.coalesce("survivor", "judge_id"))
    return rows.groupBy("opinion_id", "judge_id").agg(F.max_by("vote_type", F.struct(S.vote_rank(F.col("vote_type")), "vote_type")).alias("vote_type"))


def carry_forward(judges: DataFrame, plan: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Survivors with empty fields filled from their losers (the smallest loser that has the field); losers are gone."""
    lost = judges.join(plan, judges.id == plan.loser)
    filled = lost.groupBy("survivor").agg(*[F.min_by(F.when(S.text_or_blank(F.col(f).cast("string")) != "", F.col(f)), F.when(S.text_or_blank(F.col(f).cast("string")) != "", F.col("loser"))).alias(f"new_{f}") for f in fields])
    rows = judges.join(plan.select(F.col("loser").alias("id")), "id", "left_anti").join(filled, F.col("id") == F.col("survivor"), "left")
    return rows.withColumns({f: F.when(S.text_or_blank(F.col(f).cast("string")) == "", F.coalesce(F.col(f"new_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}).drop("survivor", *[f"new_{f}" for f in fields])


def unique_surnames(judges: DataFrame) -> DataFrame:
    """state_code, surname, judge_id for surnames that one judge of the state has."""
    rows = judges.select("state_code", F.lower(S.surname(F.col("full_name"))).alias("surname"), "id")
    return rows.where("surname <> ''").groupBy("state_code", "surname").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("judge_id")).where("n = 1").drop("n")


# What a name in a byline votes, and what wins when it stands in several places.
BYLINE_VOTES = (("author_last", "MAJORITY_AUTHOR", 4), ("dissenter_last", "DISSENT_AUTHOR", 3), ("concurrer_last", "CONCURRENCE_AUTHOR", 2), ("panel_last", "MAJORITY_JOIN", 1))


def byline_votes(bylines: DataFrame, judges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Votes that bylines (opinion_id, state_code, author_last, panel_last, dissenter_last, concurrer_last) give: surnames must be
    unique in the state; a separate writer is not of the panel; a join that exists is raised to a writer's vote, any
    other vote that exists stays."""
    parts = []
    for column, vote, strength in BYLINE_VOTES:
        each = F.array(column) if column == "author_last" else F.col(column)
        parts.append(bylines.select("opinion_id", "state_code", F.explode(each).alias("name")).where("name <> ''").select("opinion_id", "state_code", F.lower("name").alias("surname"), F.lit(vote).alias("vote_type"), F.lit(strength).alias("strength")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = rows.join(unique_surnames(judges), ["state_code", "surname"]).groupBy("opinion_id", "judge_id").agg(F.max_by("vote_type", "strength").alias("vote_type"))
    if existing is None:
        return found
    both = existing.select("opinion_id", "judge_id", F.col("vote_type").alias("old")).join(found, ["opinion_id", "judge_id"], "full")
    raised = (F.col("old") == "MAJORITY_JOIN") & F.col("vote_type").isNotNull()
    return both.select("opinion_id", "judge_id", F.when(raised | F.col("old").isNull(), F.col("vote_type")).otherwise(F.col("old")).alias("vote_type"))


def opinion_merge_plan(opinions: DataFrame) -> DataFrame:
    """loser, survivor: rows of one court and canonical docket with one date whose captions agree. The survivor has the longer text, then the smaller id."""
    rows = opinions.select("id", "court_id", "release_date", "title", "size", S.canonical_case_number(F.col("case_number")).alias("docket"))
    rows = rows.where("docket <> ''")
    best = rows.groupBy("court_id", "docket", "release_date").agg(F.max_by(F.struct("id", "title"), F.struct("size", -F.col("id"))).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = rows.join(best, ["court_id", "docket", "release_date"]).where("id <> s.id")
    return pairs.where(S.captions_compatible(F.col("title"), F.col("s.title"))).select(F.col("id").alias("loser"), F.col("s.id").alias("survivor"))


def repoint_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Edges of the survivors: no self edges, one for each pair and source."""
    a, b = (plan.select(F.col("loser").alias(c), F.col("survivor").alias(f"new_{c}")) for c in ("citing_id", "cited_id"))
    rows = edges.join(a, "citing_id", "left").join(b, "cited_id", "left")
    rows = rows.select(F.coalesce("new_citing_id", "citing_id").alias("citing_id"), F.coalesce("new_cited_id", "cited_id").alias("cited_id"), "cite", "source", "context")
    return rows.where("cited_id IS NULL OR cited_id <> citing_id").groupBy("citing_id", "cited_id", "source", F.when(F.col("cited_id").isNull(), F.col("cite")).alias("outside")).agg(F.min("cite").alias("cite"), F.min("context").alias("context")).drop("outside")


def merge_children(rows: DataFrame, plan: DataFrame, key: str, only_if_empty: bool, unique: tuple[str, ...] = ()) -> DataFrame:
    """Child rows (citations, tags, statutes, holdings) moved to the survivors; with ``only_if_empty`` a survivor's own rows win over its losers'."""
    p = plan.select(F.col("loser").alias(key), "survivor")
    moved = rows.join(p, key, "left").withColumns({"own": F.col("survivor").isNull(), key: F.coalesce("survivor", key)}).drop("survivor")
    if only_if_empty:
        moved = moved.withColumn("any_own", F.max("own").over(Window.partitionBy(key))).where("own OR NOT any_own").drop("any_own")
    moved = moved.drop("own")
    if not unique:
        return moved
    rest = [c for c in moved.columns if c not in (key, *unique)]
    if not rest:
        return moved.distinct()
    best = moved.groupBy(key, *unique).agg(F.min(F.struct(*rest)).alias("x"))  # of rows that fall together the smallest
    return best.select(key, *unique, *[F.col(f"x.{c}") for c in rest]).select(*moved.columns)


def rehome(opinions: DataFrame, courts: DataFrame, default_court: Column, division: Column) -> DataFrame:
    """Opinions moved to the court of their division, where the docket tells it."""
    c = courts.select(F.col("state_code").alias("to_state"), F.col("level").alias("to_level"), F.col("division").alias("to_division"), F.col("id").alias("to_court"))
    rows = opinions.withColumn("want", division).join(c, (F.col("want") == F.col("to_division")) & (F.col("state_code") == F.col("to_state")) & (F.col("level") == F.col("to_level")), "left")
    return rows.withColumn("court_id", F.coalesce("to_court", default_court)).drop("want", "to_state", "to_level", "to_division", "to_court")


def majority_division(votes: DataFrame, opinions: DataFrame) -> DataFrame:
    """The division in which each judge voted most; the first on a tie."""
    div = S.appeals_division(F.col("case_number"))
    rows = votes.join(opinions.select(F.col("id").alias("opinion_id"), div.alias("division")), "opinion_id").where("division IS NOT NULL")
    by = rows.groupBy("judge_id").agg(F.sum(F.when(F.col("division") == "1", 1).otherwise(0)).alias("first"), F.sum(F.when(F.col("division") == "2", 1).otherwise(0)).alias("second"))
    return by.select("judge_id", F.when(F.col("first") >= F.col("second"), "1").otherwise("2").alias("division"))


def reporter_cites(opinions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Empty cites filled from cluster_id -> reporter_cite; the last row (largest ``seq``) of a cluster wins."""
    last = mapping.groupBy("cluster_id").agg(F.max_by("reporter_cite", "seq").alias("new_cite"))
    return opinions.join(last, "cluster_id", "left").withColumn("reporter_cite", F.when(S.text_or_blank(F.col("reporter_cite")) == "", F.coalesce("new_cite", F.lit(""))).otherwise(F.col("reporter_cite"))).drop("new_cite")


SKIPPED_REPORTERS = ("LEXIS", "WL", "Adv. Rep.", "A.L.R.")  # fixed values


def parallel_cites(rows: DataFrame, opinions: DataFrame, existing: DataFrame, keep_all: bool = False) -> DataFrame:
    """New (opinion, cite) pairs, at most 64 characters, without the reporters that do not help."""
    skip = F.exists(F.array(*map(F.lit, SKIPPED_REPORTERS)), lambda r: F.contains(F.col("cite"), r))
    fresh = rows if keep_all else rows.where(~skip)
    fresh = fresh.where((F.trim("cite") != "") & (F.length("cite") <= 64)).join(opinions.select("cluster_id", F.col("id").alias("opinion_id")), "cluster_id")
    return fresh.groupBy("opinion_id", "cite").agg(F.min("reporter").alias("reporter")).join(existing.select("opinion_id", "cite"), ["opinion_id", "cite"], "left_anti")


def roster_diff(judges: DataFrame, roster: DataFrame, key: str = "source_id") -> DataFrame:
    """What a scraped roster means for the judges on file: new, changed, same or gone."""
    j, r = judges.select(F.col(key).alias("k"), F.col("full_name").alias("old_name"), F.col("is_currently_seated").alias("seated")), roster.select(F.col(key).alias("k"), F.col("full_name").alias("new_name"))
    rows = j.where("k <> ''").join(r, "k", "full")
    action = F.when(F.col("old_name").isNull(), "new").when(F.col("new_name").isNull(), F.when(F.col("seated"), "gone").otherwise("same")).when((F.col("old_name") == F.col("new_name")) & F.col("seated"), "same").otherwise("changed")
    return rows.select(F.col("k").alias(key), "old_name", "new_name", action.alias("action"))


def reconcile_roster(judges: DataFrame, roster: DataFrame) -> DataFrame:
    """Stubs against a roster by surname: no match is kept, one is merged, several are ambiguous."""
    n = roster.select(F.lower(S.surname(F.col("full_name"))).alias("surname"), F.col("id").alias("to")).groupBy("surname").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("target"))
    rows = judges.withColumn("surname", F.lower(S.surname(F.col("full_name")))).join(n, "surname", "left")
    return rows.select("id", "surname", F.when(F.col("n").isNull(), "keep").when(F.col("n") == 1, "merge").otherwise("ambiguous").alias("action"), F.when(F.col("n") == 1, F.col("target")).alias("target"))
