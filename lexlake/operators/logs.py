"""Access-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import scalars as S

# The shape of a log line, agents that read live, that collect, that are blocked and that index, and the shapes of pages, first match first.
LINE = r'\[(\d{1,2}/[A-Za-z]{3}/\d{4}):[^\]]*\]\s+"[A-Z]+\s+(\S.*?)\s+HTTP/[0-9.]+"\s+(\d{3})\s+\S+\s+"([^"]*)"'
LIVE_AGENTS = ("chatgpt-user", "claude-user", "claude-web", "perplexity-user")
TRAINING_AGENTS = ("gptbot", "claudebot", "ccbot", "google-extended", "bytespider", "amazonbot", "perplexitybot")
BLOCKED_CRAWLERS = ("semrushbot", "ahrefsbot", "mj12bot", "dotbot", "seznambot", "blexbot", "petalbot", "rogerbot", "exabot", "magpie-crawler")
INDEXERS = (
    "googlebot", "google-extended", "bingbot", "duckduckbot", "gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "anthropic-ai", "claude-web", "perplexitybot", "ccbot", "applebot", "amazonbot", "bytespider",
    "facebookexternalhit", "meta-externalagent", "claude-user", "perplexity-user",
)
PAGE_SHAPES = (
    (r"^/opinion/.*/cited-by/?$", "/opinion/<X>/cited-by/"), (r"^/opinion/.*/pdf/?$", "/opinion/<X>/pdf/"), (r"^/opinion/.", "/opinion/<X>/"), (r"^/judge/.", "/judge/<X>/"),
    (r"^/statute/.", "/statute/<X>/"), (r"^/tag/.", "/tag/<X>/"), (r"^/sitemap", "/sitemap*.xml"),
)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """day, path, status, agent of the lines that read as requests."""
    c = F.col(column)
    return lines.where(F.regexp_like(c, F.lit(LINE))).select(
        F.to_date(F.regexp_extract(c, LINE, 1), "d/MMM/yyyy").alias("day"), F.regexp_extract(c, LINE, 2).alias("path"), F.regexp_extract(c, LINE, 3).cast("int").alias("status"), F.regexp_extract(c, LINE, 4).alias("agent")
    )


def has_token(agent: Column, tokens: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(agent), t))


def crawler_kind(agent: Column) -> Column:
    """blocked, indexer or visitor."""
    own = F.coalesce(agent, F.lit(""))
    return F.when(has_token(own, BLOCKED_CRAWLERS), "blocked").when(has_token(own, INDEXERS), "indexer").otherwise("visitor")


def page_shape(path: Column) -> Column:
    out = None
    for pattern, shape in PAGE_SHAPES:
        test = F.regexp_like(path, F.lit(pattern))
        out = F.when(test, shape) if out is None else out.when(test, shape)
    return out.otherwise(path)


def error_rate(log: DataFrame, most: int = 20, percent: float = 1.0) -> DataFrame:
    """Server errors by page shape, with the rate of all requests and whether it alerts. Fails on a log without requests."""
    bad = F.col("status").between(500, 599)
    total = log.agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(bad, 1)).alias("errors"))
    by = log.where(bad).groupBy(page_shape(F.col("path")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    rate = 100.0 * F.col("errors") / F.col("requests")
    checked = total.withColumn("requests", F.when(F.col("requests") == 0, F.raise_error(F.lit("no line reads as a request"))).otherwise(F.col("requests")))
    return by.crossJoin(F.broadcast(checked)).select("shape", "n", "requests", "errors", F.round(rate, 3).alias("rate"), ((F.col("errors") >= most) | (rate >= percent)).alias("alert"))


def error_report(spark, paths: list[str], lines: int = 50_000, most: int = 20, percent: float = 1.0) -> DataFrame:
    """``error_rate`` of the last lines of some log files. A log that cannot be read, is empty, or has no line that reads as a request is an error, never a good report."""
    from lexlake.sources.tails import tail

    log = parse_lines(tail(spark, paths, lines))
    if log.isEmpty():
        raise ValueError("no line reads as a request")
    return error_rate(log, most, percent)


def live_fetches(log: DataFrame, ref_date: str, days: int = 7) -> DataFrame:
    """Successful fetches of opinions by live agents in the last days, by case number."""
    rows = log.where((F.col("status") == 200) & F.col("day").between(F.date_sub(F.lit(ref_date).cast("date"), days - 1), F.lit(ref_date).cast("date")) & has_token(F.col("agent"), LIVE_AGENTS))
    case = F.trim(S.unquote(F.regexp_extract("path", r"^/opinion/(.+?)/?$", 1)))
    return rows.select(case.alias("case_number")).where("case_number <> ''").groupBy("case_number").agg(F.count(F.lit(1)).alias("hits"))


def agent_profile(log: DataFrame, opinions: DataFrame, courts: DataFrame, ref_date: str, days: int = 7) -> DataFrame:
    """What live agents read, by decade, outcome, court and in all; cases that are not in the corpus are counted apart. Where a case number is not
    unique, the opinion with the oldest date, then the smallest id, stands for it."""
    hits = live_fetches(log, ref_date, days)
    read = opinions.join(hits.select("case_number"), "case_number", "left_semi")  # the cases that were asked for, before anything is aggregated
    one = read.groupBy("case_number").agg(F.min_by(F.struct("court_id", "release_date", "disposition", "id"), F.struct("release_date", "id")).alias("o"))
    rows = hits.join(one, "case_number", "left").select("hits", "o.*").join(courts.select(F.col("id").alias("court_id"), "state_code", "level"), "court_id", "left")
    known = F.col("release_date").isNotNull()
    facts = F.array(
        F.struct(F.lit("matched").alias("facet"), F.when(known, "yes").otherwise("no").alias("value")),
        F.struct(F.lit("state").alias("facet"), F.col("state_code").alias("value")),
        F.struct(F.lit("level").alias("facet"), F.col("level").alias("value")),
        F.struct(F.lit("decade").alias("facet"), S.decade(F.col("release_date")).cast("string").alias("value")),
        F.struct(F.lit("outcome").alias("facet"), S.disposition_bucket(F.col("disposition")).alias("value")),
    )
    return rows.select("hits", known.alias("known"), F.explode(facts).alias("f")).where((F.col("f.facet") == "matched") | F.col("known")).groupBy(F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("cases"))


def agent_traffic(log: DataFrame, top: int = 15) -> DataFrame:
    """Paths that agents ask for most, live and for training."""
    kind = F.when(has_token(F.col("agent"), LIVE_AGENTS), "live").when(has_token(F.col("agent"), TRAINING_AGENTS), "training")
    by = log.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("n"), "kind", "path").limit(top)
