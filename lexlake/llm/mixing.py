"""Soft-membership mixing of sources to target weights, in DataFrame functions only.

The sources ("domains") are the classes of a labelled table. A classifier over words (log ratios beyond their error,
calibrated by a logistic model), fitted on at most ``per_domain`` labelled rows of each domain, gives every document a
posterior over the domains. It uses the ``most_words`` words that tell most.

Nonnegative rates, one per document, are then fitted so that the expected token total of each domain (rate x tokens x
posterior, summed) matches its target: projected-gradient least squares, with momentum. A step moves every rate against its
gradient and sets it to 0 where it would be negative; it needs one aggregate of the table, a few numbers for each domain. Rates are a column
that the steps rewrite; the driver holds the residuals of the totals only, from which any row's rate follows again.

A null text is the empty text, with 0 tokens and the prior as its posterior. Labelled rows with a null id or domain,
or a domain without a target, are left out; an id with two domains counts as the smaller. A domain whose expected share
is under a millionth cannot be reached: it is left out, and the other targets are scaled up. Repeated rows get the same
rate; an empty table, or one without labelled rows, gives every row the rate 1 and equal posteriors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, n_blocks, text_of

#: Steps that are one expression before the rates are stored.
CHAIN = 8
#: Rows that a task of a step reads: some numbers each, so that a step is not all overhead.
STEP_ROWS = 100_000
#: Words, and runs of other characters on their own.
SPLIT = r"\s+|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\s])"


@dataclass
class Mixture:
    """Domains in order, their word weights and priors, the targets in tokens, and the steps that give the rates."""

    domains: list[str]
    vocabulary: list[str]
    seed: int
    weights: list[list[float]]
    mix: list[list[float]] | None = None  # by domain: intercept, and a factor for each evidence
    targets: list[float] | None = None
    reached: list[float] | None = None
    size: float = 0.0  # of a step
    ridge: float = 0.0
    most: float | None = None  # the largest rate
    steps: list[tuple[list[float], float]] = field(default_factory=list)  # a slope for each domain, and the momentum


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def bucket_of(word: Column, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(buckets)).cast("int")


def without_collisions(spark: SparkSession, words: list[str], seeds: int = 32) -> tuple[int, int, dict[str, int]]:
    """A seed and a number of buckets that give each word a bucket of its own, and the buckets."""
    buckets = 65_536
    while words:
        rows = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("word")).select("word", F.array(*[bucket_of(F.col("word"), s, buckets) for s in range(seeds)]).alias("b")).collect()
        for s in range(seeds):
            if len({r.b[s] for r in rows}) == len(words):
                return s, buckets, {r.word: r.b[s] for r in rows}
        buckets *= 2
    return 0, buckets, {}


def constant(values: list[float]) -> Column:
    """An array of doubles that is one literal in the plan."""
    return F.expr(f"cast(split('{','.join(f'{v:.6g}' for v in values)}', ',') as array<double>)")


def summed(weights: list[float]) -> Column:
    """The weights of the words in #w, summed."""
    table = constant(weights)
    return F.aggregate("#w", F.lit(0.0), lambda total, bucket: total + F.get(table, bucket))


def sure_weight(own: Column, rest: Column, n_own: float, n_rest: float, sure: float = 5.0) -> Column:
    """Log ratio of a word's share in a domain to its share in the others where the two differ by ``sure`` standard errors, else 0:
    words that say nothing add nothing, however long a text is."""
    ratio = F.log((own + 0.5) / n_own) - F.log((rest + 0.5) / n_rest)
    pooled = (own + rest) / (n_own + n_rest)
    z = (own / n_own - rest / n_rest) / F.sqrt(pooled * (1 - pooled) * (1 / n_own + 1 / n_rest))
    return F.when(F.abs(z) >= sure, ratio).otherwise(0.0)


def word_weights(different: DataFrame, domains: list[str], most_words: int) -> dict[str, list[float]]:
    """The words that tell most (at most ``most_words``) with their weight for each domain."""
    k = range(len(domains))
    counts = different.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.sum(F.when(F.col("domain") == d, 1.0).otherwise(0.0)).alias(f"c{i}") for i, d in enumerate(domains)])
    counts = materialize(different.sparkSession, counts.where(sum((F.col(f"c{i}") for i in k), F.lit(0.0)) >= 5), "word-counts")
    totals = [float(x or 0.0) for x in counts.agg(*[F.sum(f"c{i}") for i in k]).first()]
    rest = lambda i: sum((F.col(f"c{j}") for j in k if j != i), F.lit(0.0))
    w = counts.select("word", F.array(*[F.round(sure_weight(F.col(f"c{i}"), rest(i), totals[i] + 1, sum(totals) - totals[i] + 1), 4) for i in k]).alias("w"))
    top = F.array_max(F.transform("w", F.abs))
    return {r.word: list(r.w) for r in w.withColumn("top", top).where("top > 0").orderBy(F.desc("top"), "word").limit(most_words).collect()}


def with_evidence(docs: DataFrame, model: Mixture) -> DataFrame:
    """``docs`` with #n (tokens), #u (share of different tokens), #v (log of their number) and, for each domain, #a (weights of all
    tokens over the root of their number) and #m (their mean)."""
    out = docs.withColumn("#all", words_of(text_of())).withColumn("#n", F.size("#all").cast("double"))
    out = out.withColumns({"#u": F.size(F.array_distinct("#all")) / F.greatest("#n", F.lit(1.0)), "#v": F.log1p("#n")})
    known = F.filter("#all", lambda w: w.isin(*model.vocabulary)) if model.vocabulary else F.array().cast("array<string>")
    out = out.withColumn("#w", F.transform(known, lambda w: bucket_of(w, model.seed, len(model.weights[0]))))
    k = range(len(model.weights))
    out = out.withColumns({f"#s{d}": summed(w) for d, w in enumerate(model.weights)}).drop("#w", "#all")
    n = F.greatest("#n", F.lit(1.0))
    return out.withColumns({f"#a{d}": F.col(f"#s{d}") / F.sqrt(n) for d in k} | {f"#m{d}": F.col(f"#s{d}") / n for d in k}).drop(*[f"#s{d}" for d in k])


def evidence_names(k: int) -> list[str]:
    return ["#u", "#v", *[f"#{c}{d}" for c in "am" for d in range(k)]]


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 0.5, steps: int = 400) -> np.ndarray:
    """Weights (k, columns) of a logistic model with a ridge, by accelerated gradient steps; the first column is the intercept."""
    scale = np.r_[1.0, np.maximum(x[:, 1:].std(0), 1e-9)]
    z, target = x / scale, np.eye(k)[y]
    w, ahead = np.zeros((k, z.shape[1])), np.zeros((k, z.shape[1]))
    size = 2.0 / (np.square(z).sum(1).mean() + ridge)
    for t in range(steps):
        logits = z @ ahead.T
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - size * ((p - target).T @ z / len(z) + ridge * np.r_[0.0, np.ones(z.shape[1] - 1)] * ahead / len(z))
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w / scale


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = 3_000, most_words: int = 400) -> Mixture:
    """``labelled``: doc_id, domain. The ids that are broadcast number at most ``per_domain`` for each domain. Half of them weigh the words; on the other half the
    evidence of the words is calibrated."""
    k = len(domains)
    own = labelled.select(F.col("doc_id").cast("long").alias("id"), F.col("domain").cast("string").alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(*domains))
    own = own.groupBy("id").agg(F.min("domain").alias("domain"))
    picked = None
    for d in domains:
        part = own.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(per_domain)
        picked = part if picked is None else picked.unionByName(part)
    shares = {r.domain: r.n for r in own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(F.broadcast(picked), "id")
    texts = texts.groupBy("id", "domain").agg(F.min("text").alias("text"))  # one row of an id, so that the bound holds for rows
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))
    # each text once, and each word once a text: copies and repeated words are no further evidence
    different = texts.where(half == 0).select("domain", F.array_distinct(words_of(F.col("text"))).alias("words"), F.xxhash64("text").alias("h")).groupBy("domain", "h").agg(F.first("words").alias("words"))
    chosen = word_weights(different, domains, most_words)
    seed, buckets, at = without_collisions(docs.sparkSession, sorted(chosen))
    weights = np.zeros((k, buckets))
    for word, bucket in at.items():
        weights[:, bucket] = chosen[word]
    model = Mixture(domains, sorted(chosen), seed, weights.tolist())
    names = evidence_names(k)
    rows = with_evidence(texts.where(half == 1), model).select("domain", *names).collect()  # numbers only
    y = np.array([domains.index(r.domain) for r in rows], int)
    seen = np.bincount(y, minlength=k)
    x = np.array([[1.0, *(r[c] for c in names)] for r in rows]).reshape(len(rows), 1 + len(names))
    w = softmax_fit(x, y, k) if (seen > 0).sum() > 1 else np.zeros((k, 1 + len(names)))
    # the sample is balanced, the table is not
    share = np.array([shares.get(d, 0) + 1 for d in domains], float)
    w[:, 0] += np.log(share / share.sum()) - np.log((seen + 1) / (seen + 1).sum())
    model.mix = w.tolist()
    return model


def with_posteriors(docs: DataFrame, model: Mixture) -> DataFrame:
    """``docs`` with #n (tokens) and #p0, #p1, ... (posteriors); names that no table of documents has."""
    k = range(len(model.domains))
    names = evidence_names(len(k))
    out = with_evidence(docs, model)
    out = out.withColumns({f"#l{d}": sum((F.lit(w) * F.col(c) for w, c in zip(model.mix[d][1:], names)), F.lit(model.mix[d][0])) for d in k})
    top = F.greatest(*[F.col(f"#l{d}") for d in k]) if len(k) > 1 else F.col("#l0")
    out = out.withColumns({f"#e{d}": F.exp(F.col(f"#l{d}") - top) for d in k})
    total = sum((F.col(f"#e{d}") for d in k), F.lit(0.0))
    return out.withColumns({f"#p{d}": F.col(f"#e{d}") / total for d in k}).drop(*names, *[f"#{c}{d}" for c in "le" for d in k])


def moved(y: Column, slopes: list[Column], model: Mixture) -> Column:
    """A gradient step from the rate ``y`` along a document's posteriors, never below 0 and never above the largest rate."""
    slope = sum((F.col(f"#p{d}") * g for d, g in enumerate(slopes)), F.lit(0.0))
    new = F.greatest(F.lit(0.0), y - F.lit(model.size) * (slope + F.lit(model.ridge) * (y - 1.0)))
    return new if model.most is None else F.least(F.lit(float(model.most)), new)


def unmet(model: Mixture, within: float = 0.01) -> dict[str, tuple[float, float]]:
    """Targets that the rates do not reach: domain -> (target, reached), where they are more than ``within`` of the target apart."""
    return {d: (t, r) for d, t, r in zip(model.domains, model.targets or [], model.reached or []) if abs(t - r) > within * max(t, 1.0)}


def rate(model: Mixture) -> Column:
    """The rate of a row with posteriors: all steps of the fit, from 1."""
    if not model.steps:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, [*map(float, g), float(m)])) for g, m in model.steps])
    k = len(model.domains)

    def step(at: Column, s: Column) -> Column:
        new = moved(at["y"], [s[d] for d in range(k)], model)
        return F.struct(new.alias("r"), (new + s[k] * (new - at["r"])).alias("y"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step)["r"]


def fit_rates(slim: DataFrame, model: Mixture, weights: dict[str, float], budget: str = "natural", ridge: float = 0.002, most_steps: int = 200, tolerance: float = 1e-4, most_rate: float | None = None) -> Mixture:
    """Fit the rates on stored (#n, #p...) rows.

    Minimised over rates of 0 or more: half the squared differences of the domain totals from their targets, as shares of all tokens, each
    over the domain's own curvature, plus ``ridge`` times half the mean of (rate - 1) squared by token, which keeps rates near 1. The fit
    ends when no rate has anywhere to go (the root of the mean squared step by token, over the step size, is at most ``tolerance``) or
    after ``most_steps``. ``budget``: "natural" keeps the token total; "largest" lets the domain with the largest weight keep its
    natural total. With ``most_rate`` no row counts for more than that: a target that cannot be reached so is not forced (``unmet`` tells which)."""
    spark, k, n = slim.sparkSession, len(model.domains), F.col("#n")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = slim.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("rows"), *[F.sum(n * F.col(f"#p{d}")).alias(f"t{d}") for d in range(k)], *[F.sum(n * F.col(f"#p{i}") * F.col(f"#p{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    every, have = float(first["n"] or 0.0), np.array([first[f"t{d}"] or 0.0 for d in range(k)])
    model.targets = model.reached = have.tolist()
    if not every:
        return model
    wish = np.array([weights[d] if have[i] > 1e-6 * every else 0.0 for i, d in enumerate(model.domains)])
    if not wish.sum():
        return model
    wish /= wish.sum()
    top = int(wish.argmax())
    target = wish * (every if budget == "natural" else have[top] / wish[top])
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = (first[f"g{i}_{j}"] or 0.0) / every
    curve = 1 / np.maximum(gram.diagonal(), 1e-12)
    model.ridge, model.most, model.size = ridge, most_rate, float(1 / (np.linalg.eigvalsh(np.sqrt(np.outer(curve, curve)) * gram).max() + ridge))
    state = slim.select("#n", *[f"#p{d}" for d in range(k)], F.lit(1.0).alias("#r"), F.lit(1.0).alias("#y"))
    state = materialize(spark, state.coalesce(n_blocks(first["rows"], STEP_ROWS)), "rates")
    now, chain, t = state, 0, 1.0
    at_y = have  # totals at the point that the step starts from
    for _ in range(most_steps):
        slopes = (curve * (at_y - target) / every).tolist()
        new = moved(F.col("#y"), [F.lit(g) for g in slopes], model)
        now = now.withColumn("#new", new)
        row = now.agg(
            *[F.sum(F.col("#new") * n * F.col(f"#p{d}")).alias(f"t{d}") for d in range(k)],
            F.sum(n * F.pow(F.col("#new") - F.col("#y"), 2)).alias("moved"), F.sum(n * (F.col("#y") - F.col("#new")) * (F.col("#new") - F.col("#r"))).alias("against"),
        ).first()
        total, t_next = np.array([row[f"t{d}"] or 0.0 for d in range(k)]), (1 + (1 + 4 * t * t) ** 0.5) / 2
        if row["against"] > 0:  # the momentum leads away: begin anew
            t_next, momentum = 1.0, 0.0
        else:
            momentum = (t - 1) / t_next
        model.steps.append((slopes, momentum))
        at_y, have, t = total + momentum * (total - have), total, t_next
        if (row["moved"] / every) ** 0.5 / model.size <= tolerance:
            break
        now = now.withColumns({"#y": F.col("#new") + F.lit(momentum) * (F.col("#new") - F.col("#r")), "#r": F.col("#new")}).drop("#new")
        chain += 1
        if chain % CHAIN == 0:
            now = materialize(spark, now, "rates")
    model.targets, model.reached = target.tolist(), have.tolist()
    return model


def fitted(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: str = "natural", per_domain: int = 3_000, most_words: int = 400, keep: tuple[str, ...] = (), most_rate: float | None = None) -> tuple[Mixture, DataFrame]:
    """Classifier and rates, and the stored rows that they were fitted on: the columns ``keep`` of ``docs``, #draw, #n, #p0, ..."""
    domains = sorted(weights)
    model = fit_classifier(docs, labelled, domains, per_domain, most_words)
    kept = [F.col(f"`{c}`") for c in keep]
    rows = with_posteriors(docs.select(*kept, draw().alias("#draw"), *[] if "text" in keep else ["text"]), model)
    rows = materialize(docs.sparkSession, rows.select(*kept, "#draw", "#n", *[f"#p{k}" for k in range(len(domains))]), "posteriors")
    return fit_rates(rows, model, weights, budget, most_rate=most_rate), rows


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> Mixture:
    """Classifier and rates. ``weights``: target share of tokens of each domain."""
    return fitted(docs, labelled, weights, **options)[0]


def draw() -> Column:
    """A number in [0, 1) from a hash of the row."""
    return F.pmod(F.xxhash64("doc_id", text_of()), F.lit(1 << 20)) / float(1 << 20)


def copies(drawn: Column) -> Column:
    """The rate, rounded up or down by the row's draw, so that it is met in expectation."""
    return F.floor(F.col("#rate") + drawn).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """doc_id, n_tokens, posteriors (by domain name in order), rate, copies of each row of ``docs``; texts are scored once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, rows = fitted(slim, labelled, weights, keep=("doc_id",), **options)
    rows = rows.withColumn("#rate", rate(model))
    return rows.select("doc_id", F.col("#n").cast("long").alias("n_tokens"), F.array(*[F.col(f"#p{k}") for k in range(len(model.domains))]).alias("posteriors"), F.col("#rate").alias("rate"), copies(F.col("#draw")).alias("copies"))


def resampled(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies say."""
    model, rows = fitted(docs, labelled, weights, keep=tuple(docs.columns), **options)
    rows = rows.withColumn("#rate", rate(model)).withColumn("#copies", copies(F.col("#draw")))
    return rows.where(F.col("#copies") > 0).withColumn("#k", F.explode(F.sequence(F.lit(1), F.col("#copies")))).select(*docs.columns)


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from a table of labels: toxic, low (quality 0) or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean").alias("domain"))
