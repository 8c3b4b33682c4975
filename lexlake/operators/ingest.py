"""Loading of bulk exports and text: chains of semi-joins, best rows of groups, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.schemas import LOAD_PRIORITY, RESTORE_PRIORITY, TEXT_FALLBACK


def fk_cascade(tables: dict[str, DataFrame], court_ids: tuple[str, ...]) -> dict[str, DataFrame]:
    """The part of a relational export that belongs to some courts. Each step keeps the rows whose key a kept table has."""
    keep = lambda name, key, ids: tables[name].join(ids, tables[name][key] == ids[ids.columns[0]], "left_semi")
    key = lambda df, column: df.select(F.col(column).alias("k")).where("k IS NOT NULL").distinct()
    out = {"dockets": tables["dockets"].where(F.col("court_id").isin(*court_ids))}
    out["clusters"] = keep("clusters", "docket_id", key(out["dockets"], "id"))
    out["opinions"] = keep("opinions", "cluster_id", key(out["clusters"], "id"))
    out["panel"] = keep("panel", "opinioncluster_id", key(out["clusters"], "id"))
    judges = key(out["panel"], "person_id")
    at_court = tables["positions"].where(F.col("court_id").isin(*court_ids))
    people = judges.union(key(at_court, "person_id")).distinct()
    out["positions"] = keep("positions", "person_id", people)
    if "joined_by" in tables:
        out["joined_by"] = keep("joined_by", "opinion_id", key(out["opinions"], "id"))
    out["people"] = keep("people", "id", people)
    for name in ("educations", "affiliations", "races"):
        if name in tables:
            out[name] = keep(name, "person_id", people)
    if "schools" in tables and "educations" in out:
        out["schools"] = keep("schools", "id", key(out["educations"], "school_id"))
    if "courts" in tables:
        out["courts"] = tables["courts"]
    return out


def priority(kind: Column, order: tuple[str, ...] = LOAD_PRIORITY) -> Column:
    p = F.array_position(F.array(*map(F.lit, order)), kind)
    return F.when(F.coalesce(p, F.lit(0)) > 0, p - 1).otherwise(99)


def body_text(most: int = 5_000_000) -> Column:
    """Plain text, or else the first of the marked-up texts that is not blank, without its tags."""
    has = lambda c: F.trim(S.text_or_blank(F.col(c))) != ""
    out = F.when(has("plain_text"), F.col("plain_text"))
    for c in TEXT_FALLBACK:
        out = out.when(has(c), S.strip_markup(F.col(c)))
    return F.substring(out.otherwise(""), 1, most)


def best_text(opinions: DataFrame, order: tuple[str, ...] = LOAD_PRIORITY) -> DataFrame:
    """cluster_id, id, type, text: the text that stands for each cluster (best type, first in ``seq``), among texts that are not blank."""
    rows = opinions.select("cluster_id", "id", "type", "seq", body_text().alias("text")).where("text <> ''")
    w = Window.partitionBy("cluster_id").orderBy(priority(F.col("type"), order), "seq", "id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "seq")


def load_opinions(dockets: DataFrame, clusters: DataFrame, courts: DataFrame, existing: DataFrame) -> DataFrame:
    """New opinions: first title that is not blank, a date and a court; a docket number of its own where there is none. Known clusters are left out, and
    known (court, docket, date) where ``existing`` has them; of several clusters with one such key the smallest id comes in."""
    name = F.coalesce(*[S.blank_to_null(F.col(c)) for c in ("case_name", "case_name_full", "case_name_short")])
    rows = clusters.join(dockets.select(F.col("id").alias("docket_id"), "docket_number", F.col("court_id").alias("source_court")), "docket_id")
    rows = rows.join(courts.select(F.col("external_id").alias("source_court"), F.col("id").alias("court_id")), "source_court")
    number = F.coalesce(S.blank_to_null(F.col("docket_number")), F.concat(F.lit("cl-"), F.col("id")))
    rows = rows.select(F.col("id").alias("cluster_id"), "court_id", number.alias("case_number"), name.alias("title"), F.try_to_date("date_filed", "yyyy-MM-dd").alias("release_date"), "disposition", (F.col("precedential_status") == "Published").alias("is_precedential"))
    fresh = rows.where("title IS NOT NULL AND release_date IS NOT NULL").join(existing.select("cluster_id"), "cluster_id", "left_anti")
    key = ["court_id", "case_number", "release_date"]
    if set(key) <= set(existing.columns):
        fresh = fresh.join(existing.select(*key), key, "left_anti")
    rest = [c for c in fresh.columns if c not in key]
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), "cluster_id").alias("x")).select("x.cluster_id", *key, *[F.col(f"x.{c}") for c in rest if c != "cluster_id"]).select(*fresh.columns)


def load_judges(people: DataFrame, positions: DataFrame, courts: DataFrame, primary: tuple[str, ...]) -> DataFrame:
    """Judges with their main court (first of ``primary``, earliest start) and earliest appointment; slugs made unique by -2, -3, ..."""
    rank = priority(F.col("court_id"), primary)
    at = positions.join(courts.select(F.col("external_id").alias("court_id"), F.col("id").alias("own_court")), "court_id").withColumn("start", F.try_to_date("date_start", "yyyy-MM-dd"))
    main = at.groupBy("person_id").agg(F.min_by("own_court", F.struct(rank, F.col("start").isNull(), "start", "own_court")).alias("court_id"), F.min("start").alias("appointment_date"))
    name = S.collapse(F.concat_ws(" ", "name_first", "name_middle", "name_last", "name_suffix"))
    rows = people.join(main, people.id == main.person_id).select(people.id.alias("external_id"), "court_id", "appointment_date", name.alias("full_name")).withColumn("base", S.slugify(F.col("full_name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("external_id"))
    return rows.withColumn("slug", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n))).drop("base")


def sync_judges(loaded: DataFrame, existing: DataFrame) -> DataFrame:
    """What a load does to the judges on file: id (null for a new one), external_id, full_name, court_id, appointment_date, slug, action.

    A person is the judge with their external id, else the one with the slug of their name. Then name, external id and court (if there is one) are set; an appointment
    date on file stays, and so does the slug. Of several persons with one slug the smallest external id takes the judge, unless an id has; the others, and those without
    a judge, are created under the first free of slug, slug-2, slug-3. Persons without a name are left out; where several judges have an external id or a slug, the
    smallest id stands for them. Every step is an equi-join or a group by slug or id."""
    people = loaded.where("trim(full_name) <> ''").select("external_id", F.col("court_id").alias("new_court"), F.col("appointment_date").alias("appointed"), "full_name")
    people = people.withColumn("base", F.coalesce(S.blank_to_null(F.substring(S.slugify(F.col("full_name")), 1, 120)), F.concat(F.lit("judge-"), "external_id")))
    first = lambda key: existing.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min("id").alias(f"by_{key}"))
    ids, slugs = first("external_id"), first("slug")
    people = people.join(ids, people.external_id == ids.k, "left").drop("k")
    claimed = people.where("by_external_id IS NOT NULL").select(F.col("by_external_id").alias("by_slug"))
    free = slugs.join(claimed, "by_slug", "left_anti")
    people = people.join(free, people.base == free.k, "left").drop("k")
    turn = F.row_number().over(Window.partitionBy("base", F.col("by_external_id").isNull()).orderBy("external_id"))
    people = people.withColumn("id", F.coalesce("by_external_id", F.when(turn == 1, F.col("by_slug"))))
    on_file = existing.select("id", F.col("court_id").alias("old_court"), F.col("appointment_date").alias("on_file"), F.col("slug").alias("old_slug"))
    people = people.join(on_file, "id", "left")
    ending = F.try_to_number(F.regexp_extract("slug", r"-([1-9]\d{0,8})$", 1), F.lit("999999999")).cast("long")
    taken = existing.where("slug IS NOT NULL").select(F.explode(F.array(F.struct(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n")), F.struct(F.regexp_replace("slug", r"-\d+$", "").alias("base"), ending.alias("n")))).alias("x")).select("x.*")
    taken = taken.where("n IS NOT NULL").groupBy("base").agg(F.collect_set("n").alias("taken"))  # the judges of one name
    created = people.where("id IS NULL").join(taken, "base", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    turn = F.row_number().over(Window.partitionBy("base").orderBy("external_id")).cast("long")
    created = created.withColumn("turn", turn).withColumn("n", F.element_at(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("taken") + F.col("turn")), "taken"), F.col("turn").cast("int")))
    fresh = created.select("id", "external_id", "full_name", F.col("new_court").alias("court_id"), F.col("appointed").alias("appointment_date"), F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"), F.lit("created").alias("action"))
    known = people.where("id IS NOT NULL").select("id", "external_id", "full_name", F.coalesce("new_court", "old_court").alias("court_id"), F.coalesce("on_file", "appointed").alias("appointment_date"), F.col("old_slug").alias("slug"), F.lit("updated").alias("action"))
    return known.unionByName(fresh)


def load_panel(panel: DataFrame, opinions: DataFrame, judges: DataFrame, existing: DataFrame) -> DataFrame:
    """Votes of panels that are new; the export does not say how, so all join the majority."""
    rows = panel.join(opinions.select(F.col("cluster_id").alias("opinioncluster_id"), F.col("id").alias("opinion_id")), "opinioncluster_id")
    rows = rows.join(judges.select(F.col("external_id").alias("person_id"), F.col("id").alias("judge_id")), "person_id").select("opinion_id", "judge_id").distinct()
    return rows.join(existing.select("opinion_id", "judge_id"), ["opinion_id", "judge_id"], "left_anti").withColumn("vote_type", F.lit("MAJORITY_JOIN"))


def reject_future(rows: DataFrame, ref_date: str, column: str = "date_filed") -> DataFrame:
    """Rows filed later than tomorrow go; a date that is missing or does not read passes."""
    d = F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd")
    return rows.where(F.coalesce(d <= F.date_add(F.lit(ref_date).cast("date"), 1), F.lit(True)))


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Old and new rows with one row for each key: new before old, the latest new one by ``order``; of equal ones that with the larger
    values in the other columns, taken in order. One shuffle by the key."""
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("gen"), F.desc(order), *[F.desc(c) for c in both.columns if c not in (*key, order, "gen") and not c.startswith("map")])
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "gen")


def concat_texts(parts: DataFrame) -> DataFrame:
    """cluster_id and its texts in order, a blank line between. A cluster has few parts."""
    rows = parts.where("trim(text) <> ''").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return rows.select("cluster_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n\n").alias("text"))


def restore_pages(opinions: DataFrame, fetched: DataFrame, low: float = 0.70, high: float = 2.00) -> DataFrame:
    """id, action, text: opinions whose text is replaced by one with page breaks. It must be of similar length; texts that have page breaks stay.
    The fetched text is of the best type, then the longest."""
    w = Window.partitionBy("id").orderBy(priority(F.col("type"), RESTORE_PRIORITY), F.desc(F.length("plain_text")), "seq")
    best = fetched.where("plain_text <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", F.col("plain_text").alias("new"))
    rows = opinions.join(best, "id", "left")
    ratio = F.length("new") / F.nullif(F.length("text"), F.lit(0))
    action = F.when(F.contains("text", F.lit("\f")), "has pages").when(F.col("new").isNull(), "nothing").when(ratio.isNull() | ratio.between(low, high), "restore").otherwise("ratio")
    return rows.withColumn("action", action).select("id", "action", F.when(F.col("action") == "restore", F.col("new")).otherwise(F.col("text")).alias("text"))


def window_honoured(rows: DataFrame, start: str, end: str, slack: int = 3, share: float = 0.8) -> DataFrame:
    """Whether enough of the dated rows lie in the window that was asked for."""
    inside = F.col("iso_date").between(F.date_sub(F.lit(start).cast("date"), slack), F.date_add(F.lit(end).cast("date"), slack))
    return rows.where("iso_date IS NOT NULL").agg(F.count(F.lit(1)).alias("dated"), F.avg(inside.cast("double")).alias("share")).withColumn("honoured", F.coalesce(F.col("share") >= share, F.lit(False)))


def windows(spark, start: str, end: str, days: int) -> DataFrame:
    """Date windows of fixed length, newest first."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(F.lit(days)))).alias("low"))
    return one.select("low", F.least(F.date_add("low", days - 1), F.lit(end).cast("date")).alias("high")).orderBy(F.desc("low"))


def changed_fields(rows: DataFrame, manifest: DataFrame, key: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Rows whose fields differ from the manifest, with the new values. Nulls compare as values."""
    m = manifest.select(*key, *[F.col(f).alias(f"new_{f}") for f in fields])
    differs = None
    for f in fields:
        one = ~F.col(f).eqNullSafe(F.col(f"new_{f}"))
        differs = one if differs is None else differs | one
    return rows.join(m, list(key)).where(differs)


def fill_parsed(opinions: DataFrame, parsed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Empty fields filled from what was parsed (id and fields)."""
    p = parsed.select("id", *[F.col(f).alias(f"p_{f}") for f in fields])
    rows = opinions.join(p, "id", "left")
    return rows.withColumns({f: F.when(S.text_or_blank(F.col(f).cast("string")) == "", F.coalesce(f"p_{f}", f)).otherwise(F.col(f)) for f in fields}).drop(*[f"p_{f}" for f in fields])


def not_logged(opinions: DataFrame, log: DataFrame) -> DataFrame:
    """Opinions whose text a parser of the state has not seen: anti-join on id, state and text hash."""
    rows = opinions.withColumn("raw_text_sha256", F.sha2("raw_text", 256))
    seen = log.select(F.col("opinion_id").alias("id"), F.col("parser_state").alias("state_code"), "raw_text_sha256")
    return rows.join(seen, ["id", "state_code", "raw_text_sha256"], "left_anti")


def backfill_dispositions(opinions: DataFrame, parsed: DataFrame, least: float = 0.0, recompute: bool = False) -> DataFrame:
    """id, disposition, action: empty outcomes filled from parsed ones of enough confidence; with ``recompute`` others are corrected, and cleared where the parser has nothing."""
    p = parsed.select("id", F.when(F.col("confidence") >= least, S.text_or_blank(F.col("disposition"))).otherwise("").alias("new"))
    rows = opinions.select("id", S.text_or_blank(F.col("disposition")).alias("old")).join(p, "id", "left").withColumn("new", S.text_or_blank(F.col("new")))
    action = F.when((F.col("old") == "") & (F.col("new") != ""), "filled")
    if recompute:
        action = action.when((F.col("old") != "") & (F.col("new") == ""), "cleared").when((F.col("old") != F.col("new")), "corrected")
    rows = rows.withColumn("action", action.otherwise("unchanged"))
    return rows.select("id", F.when(F.col("action") == "unchanged", F.col("old")).otherwise(F.col("new")).alias("disposition"), "action")


def sitemap_chunks(opinions: DataFrame, base: str, size: int = 25_000) -> DataFrame:
    """chunk, pos, url of all opinions in (court, case number) order. A range sort gives each partition its place; positions are counted by partition, so
    no task sees all rows."""
    from lexlake.operators.numbering import with_position

    rows = with_position(opinions.select("court_id", "case_number", "id"), "court_id", "case_number", "id")
    url = F.concat(F.lit(base), S.quote_path(F.col("case_number")), F.lit("/"))
    return rows.select(F.floor((F.col("pos") - 1) / size).cast("int").alias("chunk"), "pos", "id", url.alias("url"))


def rate_shards(rows: DataFrame, text: str, shard: str, most: int = 90_000) -> DataFrame:
    """Batches of texts in order within a shard, each of at most ``most`` estimated tokens. Greedy filling is sequential, so a shard of bounded size is the unit."""
    import pandas as pd

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        batch, held, out = 0, 0, []
        for t in group.sort_values("id")["tokens"]:
            if held and held + t > most:
                batch, held = batch + 1, 0
            held += t
            out.append(batch)
        return group.sort_values("id").assign(batch=out)

    sized = rows.select("id", F.col(shard).cast("long").alias("shard"), S.token_estimate(F.col(text)).alias("tokens"))
    return sized.groupBy("shard").applyInPandas(fill, "id long, shard long, tokens int, batch int")
