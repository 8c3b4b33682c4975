"""Schemas of the role tables, as Spark DDL. The empty string means missing in text columns."""

STATE = "code STRING, name STRING, slug STRING, is_live BOOLEAN"
COURT = "id BIGINT, state_code STRING, level STRING, division STRING, name STRING, slug STRING, external_id STRING"
JUDGE = (
    "id BIGINT, state_code STRING, court_id BIGINT, full_name STRING, slug STRING, status STRING, role STRING, is_currently_seated BOOLEAN, appointment_date DATE, "
    "bio_url STRING, bio_summary STRING, photo_url STRING, external_id STRING, cl_absent BOOLEAN, source_id STRING"
)
OPINION = (
    "id BIGINT, court_id BIGINT, case_number STRING, reporter_cite STRING, title STRING, release_date DATE, is_precedential BOOLEAN, disposition STRING, disposition_bucket STRING, raw_text STRING, "
    "external_id STRING, sha256 STRING, review_status STRING, holding_summary STRING, holding_source_paras ARRAY<INT>, embedding_pending BOOLEAN"
)
PANEL_VOTE = "id BIGINT, opinion_id BIGINT, judge_id BIGINT, vote_type STRING"
STATUTE = "chapter STRING, section STRING, subdivision STRING, reference_slug STRING, reference_display STRING, text_offset INT"
CITATION = "reporter_cite STRING, text_offset INT, context STRING, quote STRING"
HOLDING = "text STRING, paragraph INT, signal STRING, collapsed_offset INT"
PARSED = (
    "case_number STRING, case_name STRING, reporter_cite STRING, release_date DATE, is_precedential BOOLEAN, disposition STRING, author STRING, panel ARRAY<STRING>, "
    "statutes_cited ARRAY<STRING>, citations_to ARRAY<STRING>, confidence MAP<STRING,DOUBLE>"
)
BYLINE = "author_last STRING, panel_last ARRAY<STRING>, dissenter_last ARRAY<STRING>, concurrer_last ARRAY<STRING>"

# The votes, their strength when two votes of a judge on an opinion meet, and their bucket.
VOTES = {
    "MAJORITY_AUTHOR": (7, "majority"),
    "CONCURRENCE_AUTHOR": (6, "concurrence"),
    "DISSENT_AUTHOR": (5, "dissent"),
    "MAJORITY_JOIN": (4, "majority"),
    "CONCURRENCE_JOIN": (3, "concurrence"),
    "DISSENT_JOIN": (2, "dissent"),
    "RECUSED": (1, "recused"),
    "NOT_PARTICIPATING": (0, "recused"),
}

# Which text of a cluster stands for the case; two loaders rank the types differently.
LOAD_PRIORITY = ("020lead", "010combined", "080on-the-merits", "060remand", "030concurrence", "040dissent", "050addendum", "070rehearing", "090trial-court-decision")
RESTORE_PRIORITY = ("010combined", "020lead", "030concurrence", "040dissent", "050addendum", "060remittitur", "070rehearing", "080onthemerits", "090onmotiontostrike")
TEXT_FALLBACK = ("html_with_citations", "html_lawbox", "html_columbia", "html_anon_2020", "html", "xml_harvard", "xml_scan")

# Seeds of the dimensions.
STATES = [("MN", "Minnesota", "minnesota", True), ("NH", "New Hampshire", "new-hampshire", True), ("AZ", "Arizona", "arizona", True), ("LA", "Louisiana", "louisiana", True)]
COURT_SEEDS = [
    ("MN", "SUPREME", "", "Minnesota Supreme Court", "minn"), ("MN", "APPEALS", "", "Minnesota Court of Appeals", "minnctapp"),
    ("NH", "SUPREME", "", "New Hampshire Supreme Court", "nh"),
    ("AZ", "SUPREME", "", "Arizona Supreme Court", "ariz"), ("AZ", "APPEALS", "1", "Arizona Court of Appeals, Division One", "arizctapp"),
    ("LA", "SUPREME", "", "Louisiana Supreme Court", "la"), ("LA", "APPEALS", "1", "Louisiana Court of Appeal, First Circuit", "lactapp"),
]
TAG_CLOUD = (
    "unsigned orders", "civil contempt", "ineffective assistance", "search and seizure", "summary judgment", "post-conviction relief", "termination of parental rights",
    "harassment restraining order", "evidentiary hearing", "implied consent", "sentencing departure", "controlled substance", "Fourth Amendment", "Fifth Amendment", "due process",
    "Miranda", "spoliation", "habeas corpus", "abuse of discretion", "preponderance of the evidence",
)


def dimension_seeds(spark):
    """(states, courts) as small tables to upsert by key."""
    courts = [(i + 1, st, level, div, name, ident, ident) for i, (st, level, div, name, ident) in enumerate(COURT_SEEDS)]
    return spark.createDataFrame(STATES, STATE), spark.createDataFrame(courts, COURT)
