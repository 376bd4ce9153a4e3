"""Soft-membership mixing to target weights, in DataFrame functions only.

Labelled documents say what the domains look like: ``high`` and ``low`` quality, and ``toxic``. A classifier of
hashed words gives every document its domain posteriors. Document rates, nonnegative, are then fitted so
that the expected tokens of each domain, sum of rate x tokens x posterior, meet their targets:
least squares by projected gradient. The residual is measured in the metric of the documents' Gram matrix,
in which a step of length 1 never overshoots. A gradient step is one sum over the posterior table with one
row per task; a document's rate is a function of its posteriors and the few numbers of the steps so far, so rates
are never stored or shuffled between steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facadelake.llm.common import written

DOMAINS = ("high", "low", "toxic")
# Shares of the expected tokens.
TARGETS = {"high": 0.88, "low": 0.08, "toxic": 0.04}
BUCKETS = 1 << 14  # hashed words
FIT_ROWS = 20_000  # labelled documents that the classifier learns from, about; chosen by the hash of their id
SOFTNESS = 0.02  # share of the prior in every posterior
STEPS, TOLERANCE, STALL = 40, 1e-7, 1e-6
MOST_SCALE = 2.0  # all rates together are raised by this at most so that clean documents keep 1; what is still below 1 is set to it


def _words(text: str | Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def labelled(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of the labels: toxic before quality; rows without a label are left out, of several
    rows of one document the worst counts."""
    rows = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") > 0, F.lit(2)).when(F.col("quality") > 0, F.lit(0)).when(F.col("quality") == 0, F.lit(1))
    return rows.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")


class Classifier:
    """Log weights of words per domain, relative to the first, and the domains' prior shares.

    A bounded table of ``BUCKETS`` x domains numbers, which goes into plans as a literal.
    """

    def __init__(self, prior: list[float], weights: list[list[float]]):
        self.prior, self.weights = prior, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
        known = labelled(labels)
        n = known.count()
        share = min(1.0, rows / n) if n else 0.0
        # At most about ``rows`` ids, so they may be broadcast; the documents stay where they are.
        chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        counts = (
            texts.select("domain", F.explode(_buckets(_words("text"))).alias("b"))
            .groupBy("b")
            .agg(*(F.count(F.when(F.col("domain") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS))))
        )
        totals = chosen.agg(*(F.count(F.when(F.col("domain") == k, 1)).alias(f"d{k}") for k in range(len(DOMAINS)))).first()
        table = [[0] * BUCKETS for _ in DOMAINS]
        for row in counts.collect():  # BUCKETS rows at most
            for k in range(len(DOMAINS)):
                table[k][row["b"]] = row[f"n{k}"]
        every = sum(totals) + len(DOMAINS)
        sums = [sum(t) for t in table]
        # A bucket's expected counts at the overall share smooth its counts: rare words say little.
        overall = [(sum(c) + 0.5) / (sum(sums) + 0.5 * BUCKETS) for c in zip(*table)]
        logs = [[math.log((c + 20 * BUCKETS * o / 100 + 0.1) / (s + 20 * BUCKETS / 100 + 0.1 * BUCKETS)) for c, o in zip(t, overall)] for t, s in zip(table, sums)]
        return cls([(d + 1) / every for d in totals], [[a - b for a, b in zip(w, logs[0])] for w in logs[1:]])

    def posteriors(self, buckets: Column) -> Column:
        """Array of domain posteriors of a document with these word buckets, the prior if it has none."""
        scores = [F.lit(0.0)]
        for weights in self.weights:
            literal = F.split(F.lit(" ".join(f"{w:.6g}" for w in weights)), " ").cast("array<double>")
            scores.append(F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(literal, b)))
        # Words of one document depend on each other: their evidence counts with the power 3/4 of their number.
        size = F.greatest(F.size(buckets), F.lit(1)).cast("double")
        return F.array(*(F.lit(math.log(p)) + s / F.pow(size, F.lit(0.25)) for p, s in zip(self.prior, scores)))


def softmax(logits: Column, prior: list[float]) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    weights = F.array(*(F.lit(p) for p in prior))
    return F.zip_with(powers, weights, lambda x, p: (1 - SOFTNESS) * x / total + SOFTNESS * p)


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``n_tokens``, its words, and ``p_<domain>``."""
    out = docs.withColumn("_llm_b", _buckets(_words("text")))
    out = out.withColumns({"n_tokens": F.size("_llm_b").cast("long"), "_llm_l": model.posteriors(F.col("_llm_b"))}).drop("_llm_b")
    out = out.withColumn("_llm_p", softmax(F.col("_llm_l"), model.prior)).drop("_llm_l")
    return out.withColumns({f"p_{d}": F.get("_llm_p", F.lit(k)) for k, d in enumerate(DOMAINS)}).drop("_llm_p")


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after these gradient steps, from 1: each takes the step's numbers, weighted by posteriors, and stays nonnegative."""
    rate = F.lit(1.0)
    for step in steps:
        change = sum((F.col(f"p_{d}") * g for d, g in zip(DOMAINS, step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - change)
    return rate


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small symmetric system by elimination; an unknown without a pivot (a domain without tokens) is 0."""
    n = len(right)
    rows = [[*m, r] for m, r in zip(matrix, right)]
    scale = max(abs(x) for m in matrix for x in m) or 1.0
    used: list[int] = []
    for c in range(n):
        pivot = max((r for r in range(n) if r not in used), key=lambda r: abs(rows[r][c]), default=None)
        if pivot is None or abs(rows[pivot][c]) <= 1e-12 * scale:
            used.append(-1 - c)
            continue
        used.append(pivot)
        for r in range(n):
            if r != pivot:
                f = rows[r][c] / rows[pivot][c]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[pivot])]
    return [rows[p][n] / rows[p][c] if p >= 0 else 0.0 for c, p in enumerate(used)]


def fit_rates(table: DataFrame, targets: dict[str, float] | None = None) -> list[list[float]]:
    """Gradient steps for ``table (n_tokens, p_<domain>...)``: the expected tokens of the domains meet ``targets``,
    as shares, with as many tokens altogether as there are. Each step is one aggregate over the table."""
    targets = targets or TARGETS
    share = [targets[d] / sum(targets.values()) for d in DOMAINS]
    mass = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]
    row = table.agg(
        F.coalesce(F.sum(mass), F.lit(0.0)).alias("total"), *(F.coalesce(F.sum(mass * F.col(f"p_{DOMAINS[i]}") * F.col(f"p_{DOMAINS[j]}")), F.lit(0.0)).alias(f"g{i}{j}") for i, j in pairs)
    ).first()
    total = row["total"]
    gram = [[row[f"g{min(i, j)}{max(i, j)}"] for j in range(len(DOMAINS))] for i in range(len(DOMAINS))]
    steps: list[list[float]] = []
    last: list[float] = []
    while total > 0 and len(steps) < STEPS:
        rated = table.select(*(mass * F.col(f"p_{d}") * rate_of(steps) for d in DOMAINS)).toDF(*DOMAINS)
        got = rated.agg(*(F.sum(d).alias(d) for d in DOMAINS)).first()
        miss = [got[d] - s * total for d, s in zip(DOMAINS, share)]
        # Met, or as near as nonnegative rates come: a step no longer moves the totals.
        if max(map(abs, miss)) <= TOLERANCE * total or last and max(abs(a - b) for a, b in zip(miss, last)) <= STALL * total:
            break
        last = miss
        steps.append(solve(gram, miss))
    return steps


def corpus_targets(table: DataFrame, targets: dict[str, float] | None = None) -> dict[str, float]:
    """Targets for ``table (n_tokens, p_<domain>...)`` by which ``high`` never falls: ``low`` and ``toxic`` get their target or, if that is
    less, the share they have; ``high`` the rest."""
    targets = targets or TARGETS
    total = sum(targets.values())
    row = table.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS)).first()
    found = {d: min(targets[d] / total, row[d] / row["n"]) if row["n"] else targets[d] / total for d in DOMAINS[1:]}
    return {DOMAINS[0]: 1.0 - sum(found.values()), **found}


def judged_clean() -> Column:
    """Whether ``high`` is a document's likeliest domain."""
    return (F.col("p_high") > F.col("p_low")) & (F.col("p_high") > F.col("p_toxic"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep_clean: bool = False) -> tuple[Classifier, list[list[float]], DataFrame]:
    """The classifier, the steps, and ``docs`` (without ``text``) with ``n_tokens``, posteriors and ``rate``.

    ``rate`` is the expected number of times a document is used. Null and empty texts have no tokens; their rate is that
    of the prior. Without labels every document has the posteriors of a uniform prior. Repeated rows each count. Targets
    that no nonnegative rates meet are met as nearly as the metric allows. ``keep_clean``: targets are those of ``corpus_targets``.
    """
    model = Classifier.fit(docs, labels)
    columns = [c for c in docs.columns if c != "text"]
    table = written(with_posteriors(docs, model).select(*columns, "n_tokens", *(f"p_{d}" for d in DOMAINS)), "mixing")
    steps = fit_rates(table, corpus_targets(table, targets) if keep_clean else targets)
    return model, steps, table.withColumn("rate", rate_of(steps))


def kept_rate(rated: DataFrame, steps: list[list[float]]) -> Column:
    """Rates of ``steps``, raised together so that those of ``rated``'s clean documents are 1 at least; beyond ``MOST_SCALE`` each alone."""
    least = rated.agg(F.min(F.when(judged_clean(), F.col("rate")))).first()[0]
    scale = 1.0 if least is None or least >= 1 else min(MOST_SCALE, 1 / least) if least > 0 else MOST_SCALE
    rate = rate_of(steps) * scale
    return F.when(judged_clean(), F.greatest(F.lit(1.0), rate)).otherwise(rate)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep_clean: bool = False) -> DataFrame:
    """``docs`` as often as their rates say: the whole part of the rate, and once more if a uniform number made of the row's
    id and text is below the rest. Rates come from the row's own text, so texts aren't joined or shuffled. ``keep_clean``: no document
    judged clean is drawn away, see ``corpus_targets`` and ``kept_rate``."""
    model, steps, fitted = mixing_rates(docs.select("doc_id", "text"), labels, targets, keep_clean)
    rate = kept_rate(fitted, steps) if keep_clean else rate_of(steps)
    rated = with_posteriors(docs.withColumns({f"_own{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), model)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(rate + draw).cast("int")
    # The observed totals also keep the optimizer from working posteriors out again for a filter on the rate.
    out = rated.withColumn("_times", times).observe("mixing", F.count(F.lit(1)).alias("rows"), F.sum("_times").alias("drawn"))
    out = out.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
    return out.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)))
