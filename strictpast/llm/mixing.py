"""Mixing documents to target weights by soft domain membership; DataFrame functions only on the executors.

A classifier learned from a labelled table gives each document a probability for every domain. Documents then get
rates, at least ``floor``, such that the expected tokens of each domain (rate x tokens x probability, summed) match
targets: nonnegative least squares by projected gradient. A pass is one map-side-combined aggregate of the domains'
totals at a few step lengths; a rate is a chain of clipped steps over the row's own probabilities, so no
state is kept per document and nothing but sums comes to the driver.

A null or empty text has no tokens; its probabilities come from its (zero) features, its rate weighs nothing. Repeated
rows get equal rates. Domains without a labelled row take no part; without any, all rates are 1. Targets are
renormalised over the learned domains. An empty table gives an empty result. Extra columns are not read; a null id is
kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import bounded_sample, unwrapped, wrapped, written

#: Step lengths that each pass tries.
STEPS = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    """``rows_per_domain`` bounds the labelled sample that the classifier is fitted on, ``terms`` its term lists."""

    rows_per_domain: int = 2000
    terms: int = 150
    prefix: int = 5
    passes: int = 25
    close: float = 1e-4
    ridge: float = 1e-3
    targets: dict = field(default_factory=lambda: {"high": 0.85, "low": 0.10, "toxic": 0.05})


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null where the labels do not tell."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "high")


def _stems(text: Column, prefix: int) -> Column:
    """Distinct beginnings of the text's words."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]*(\p{L}{1,%d})\p{L}*" % prefix, "$1 "), " "))


def _prepared(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.split(F.btrim("text", F.lit(_BLANKS)), _SPACE).alias("words"))
    words = F.when(F.length(F.element_at("words", 1)) > 0, F.size("words")).otherwise(0)
    return rows.select(
        "id",
        words.cast("long").alias("tokens"),
        F.size(F.array_distinct("words")).alias("kinds"),
        F.length("text").alias("chars"),
        F.regexp_count("text", F.lit(r"[^\p{L}\s.,]")).alias("signs"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("capitals"),
        _stems(F.col("text"), settings.prefix).alias("stems"),
    )


def _features(terms: dict[str, list[str]]) -> list[Column]:
    """The classifier's inputs over ``_prepared`` rows."""
    words, chars = F.greatest(F.lit(1), "tokens").cast("double"), F.greatest(F.lit(1), "chars").cast("double")
    hits = [F.size(F.array_intersect("stems", F.array(*[F.lit(x) for x in terms[d]]))) if terms[d] else F.lit(0) for d in sorted(terms)]
    shape = [F.log1p("tokens"), F.col("kinds") / words, F.log1p(F.col("signs") / words), F.col("capitals") / chars, F.log1p(F.col("chars") / words)]
    return shape + [y for h in hits for y in (F.log1p(h.cast("double")), h / F.sqrt(words))]


@dataclass
class Classifier:
    domains: list[str]
    terms: dict[str, list[str]]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # (domains, features + 1)

    def posteriors(self) -> list[Column]:
        """A probability per domain, as columns over ``_prepared`` rows with an array column ``x`` of features."""
        scores = []
        for row in self.weights:
            score = F.lit(float(row[-1]))
            for i, w in enumerate(row[:-1]):
                score = score + (F.element_at("x", i + 1) - float(self.mean[i])) * float(w / self.spread[i])
            scores.append(score)
        peak = F.greatest(*scores) if len(scores) > 1 else scores[0]
        powers = [F.exp(s - peak) for s in scores]
        return [p / sum(powers[1:], powers[0]) for p in powers]


def softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weighted multinomial logistic regression by Newton steps; the last column is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    n, k, d = len(x), classes, x.shape[1]
    w, weight, hot = np.zeros((k, d)), weight / weight.sum(), np.eye(classes)[y]
    for _ in range(steps):
        s = x @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = ((p - hot) * weight[:, None]).T @ x + ridge * w
        hess = np.zeros((k * d, k * d))
        for a in range(k):
            for b in range(k):
                hess[a * d : (a + 1) * d, b * d : (b + 1) * d] = (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        step = np.linalg.solve(hess + (ridge + 1e-9) * np.eye(k * d), grad.ravel()).reshape(k, d)
        w -= step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_classifier(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """Learn domains from ``labelled`` (id, domain): at most ``rows_per_domain`` rows of each, spread by a hash of the id."""
    named = labelled.where("domain is not null").select(F.col(id_col).alias("id"), "domain")
    counts = {r[0]: r[1] for r in named.groupBy("domain").count().collect()}
    if not counts:
        return None
    chosen = bounded_sample(named, "domain", settings.rows_per_domain).select("id", "domain")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = written(_prepared(source.join(F.broadcast(chosen), "id").select("id", "text"), settings, "id", "text").join(F.broadcast(chosen), "id"), "labelled")
    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return None
    held = sample.select("domain", F.explode("stems").alias("stem")).where("stem <> ''").groupBy("stem").pivot("domain", domains).agg(F.count(F.lit(1))).na.fill(0)
    terms = {}
    for d in domains:
        rest = sum(sizes[o] for o in domains if o != d)
        others = sum([F.col(f"`{o}`") for o in domains if o != d], F.lit(0))
        own = F.col(f"`{d}`")
        ratio = F.log((own + 0.5) / (sizes[d] + 1.0)) - F.log((others + 0.5) / (rest + 1.0))
        gain = own / float(sizes[d]) * ratio
        terms[d] = [r[0] for r in held.where((own >= 3) & (ratio > 1.5)).orderBy(gain.desc(), "stem").limit(settings.terms).collect()] if rest else []
    table = sample.select("domain", F.array(*_features(terms)).alias("x")).collect()  # bounded by rows_per_domain
    x = np.array([r[1] for r in table], float)
    y = np.array([domains.index(r[0]) for r in table])
    weight = np.array([counts[r[0]] / sizes[r[0]] for r in table], float)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    return Classifier(domains, terms, mean, spread, softmax_fit((x - mean) / spread, y, weight, len(domains), settings.ridge))


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def solve_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], floor: float = 0.0, budget: float | None = None, settings: Settings = Settings()) -> tuple[Column, dict]:
    """The rate column over rows (tokens, one probability column per domain) and what it attains.

    ``budget``: expected tokens in all; the smallest that every target allows at ``floor`` where it is None and floor > 0,
    else as many as there are. The direction is the gradient preconditioned by the Gram matrix; a pass tries all of
    ``STEPS`` lengths along it, clipped at the floor, and takes the best, so the misfit never grows.
    """
    k = len(domains)
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    p = [F.col(f"p_{i}") for i in range(k)]
    t = F.col("tokens").cast("double")
    have = np.array([x or 0.0 for x in rows.agg(*[F.sum(t * c) for c in p]).first()])
    if budget is None:
        used = share > 0
        budget = float((have[used] * floor / share[used]).max()) if floor else float(have.sum())
    goal, first = share * max(budget, 1e-9), max(1.0, floor)
    low = F.lit(float(floor))
    moves: list[list[float]] = []

    def along(m: Column) -> Column:
        return sum([p[i] * F.get(m, F.lit(i)) for i in range(1, k)], p[0] * F.get(m, F.lit(0)))

    def walked() -> Column:
        # Moves are data, not code: every pass runs the same compiled plan.
        steps = F.array(*[_numbers(m) for m in moves]) if moves else F.array().cast("array<array<double>>")
        return F.aggregate(steps, F.lit(first), lambda rate, m: F.greatest(low, rate + along(m)))

    start = rows.agg(*[F.sum(t * c) for c in p], *[F.sum(t * p[a] * p[b]) for a in range(k) for b in range(k)]).first()
    sums = np.array([x or 0.0 for x in start])
    got, gram = sums[:k] * first, sums[k:].reshape(k, k)
    gram = gram + 1e-9 * max(np.trace(gram), 1e-9) * np.eye(k)
    step = 0
    for step in range(1, settings.passes + 1):
        short = goal - got
        if np.abs(short).sum() <= settings.close * max(goal.sum(), 1e-9):
            break
        move = np.linalg.solve(gram, short)
        drift = along(_numbers(move))
        tried = [F.greatest(low, F.col("_rate") + F.col("_drift") * length) for length in STEPS]
        found = rows.withColumn("_rate", walked()).withColumn("_drift", drift).agg(*[F.sum(t * c * x) for x in tried for c in p]).first()
        ends = np.array([x or 0.0 for x in found]).reshape(len(STEPS), k)
        best = int(((goal - ends) ** 2).sum(1).argmin())
        if ((goal - ends[best]) ** 2).sum() >= 0.999 * (short**2).sum():
            break
        moves.append([float(x) * STEPS[best] for x in move])
        got = ends[best]
    rate = walked()
    return rate, {"passes": step + 1, "goal": goal.tolist(), "got": got.tolist(), "had": have.tolist()}


def mixing_rates(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings(), floor: float = 0.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """((id, tokens, posteriors: map by domain, rate, copies), report). ``copies`` rounds the rate by a hash of the id."""
    model = fit_classifier(docs, labelled, settings, id_col, text_col)
    ready = _prepared(docs, settings, id_col, text_col)
    domains = model.domains if model else []
    if model:
        ready = ready.select("id", "tokens", F.array(*_features(model.terms)).alias("x"))
    rows = written(ready.select("id", "tokens", *[c.alias(f"p_{i}") for i, c in enumerate(model.posteriors() if model else [])]), "posteriors")
    rate, report = solve_rates(rows, domains, settings.targets, floor, budget, settings) if model else (F.lit(1.0), {})
    names = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"p_{i}"))]) if domains else F.lit(None).cast("map<string,double>")
    out = rows.select(F.col("id").alias(id_col), "tokens", names.alias("posteriors"), rate.cast("double").alias("rate"))
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + F.when(_chance(id_col) < F.col("rate") - whole, 1).otherwise(0)).cast("long")), report


def _chance(id_col: str) -> Column:
    """An even draw in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)


def mixed(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings(), floor: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with all their columns.

    With a floor of 1 every document stays, and scarce domains repeat. A null id counts once.
    """
    rates, _ = mixing_rates(docs, labelled, settings, floor, id_col=id_col, text_col=text_col)
    copies = rates.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max("copies").cast("int").alias("copies"))
    times = F.coalesce("copies", F.lit(1))
    joined = wrapped(docs, key=F.col(id_col)).join(copies, "key", "left").where(times > 0)
    return unwrapped(joined.select("row", F.explode(F.sequence(F.lit(1), times)).alias("turn")), docs.columns)


def labelled_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op7_mixing(spark, sf_dir):
    from strictpast.llm.common import table

    rates, _ = mixing_rates(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")))
    return rates
