"""Soft-membership mixing, in DataFrame functions alone.

A classifier fitted on a labelled table (naive Bayes over hashed words) gives every document a posterior over domains.
Document rates r >= least are then fitted by projected gradient least squares, so that the expected tokens of each
domain, the sum of r x tokens x posterior, match the targets. Each step is one aggregate of as many sums as there are
domains; a rate is a function of a document's posterior and of the steps so far, so steps write nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import keep, least_hashed

BUCKETS = 4096
STEPS, TOLERANCE = 30, 1e-4
#: Labelled rows that the classifier is fitted on at most: those of least hash.
SAMPLE = 5000


def words(text: Column) -> Column:
    """Words at ASCII white space, with an empty one before the first or after the last where the text begins or ends
    with white space; of a null or blank text, empty ones alone."""
    return F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+")


def bucket(word: Column) -> Column:
    """The bucket of a word; -1 of an empty one."""
    return F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


class Domains:
    """Log odds of word buckets by domain: weights[bucket][domain], and the log priors."""

    def __init__(self, names: list[str], priors: list[float], weights: list[list[float]]):
        self.names, self.priors, self.weights = names, priors, weights


def fit_domains(labelled: DataFrame, sample: int = SAMPLE) -> Domains:
    """From labelled(text, domain). Rows without a domain are not used; without any row there is one domain, "all"."""
    rows = labelled.where("domain is not null").select("text", F.col("domain").cast("string").alias("domain"))
    rows = keep(least_hashed(rows, F.xxhash64("text", "domain"), sample), "labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes) or ["all"]
    total = sum(sizes.values())
    priors = [math.log(sizes[d] / total) if total else 0.0 for d in names]
    seen = rows.select("domain", F.explode(words(F.col("text"))).alias("w")).groupBy("domain", bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).where("b >= 0")
    counts = [[0.5] * len(names) for _ in range(BUCKETS)]
    for r in seen.collect():  # BUCKETS x domains at most
        counts[r["b"]][names.index(r["domain"])] += r["n"]
    sums = [sum(c[k] for c in counts) for k in range(len(names))]
    return Domains(names, priors, [[math.log(c[k] / sums[k]) for k in range(len(names))] for c in counts])


def posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """doc_id, row (a hash), n_tokens, p (array, in the order of model.names): one row for each row of docs.

    A text without words has the priors."""
    none = (-1, *(0.0 for _ in model.names))
    table = docs.sparkSession.createDataFrame([none, *((b, *map(float, w)) for b, w in enumerate(model.weights))], "b int, " + ", ".join(f"w{k} double" for k in range(len(model.names))))
    # The hash has a step of its own: beside the generator it would be computed for every word.
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    each = rows.select("doc_id", "row", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    # Words of a row meet in its own task: what is shuffled is one row of sums for each document.
    sums = (
        each.select("doc_id", "row", "pos", bucket(F.col("w")).alias("b"))
        .join(F.broadcast(table), "b")  # BUCKETS rows and one
        .groupBy("doc_id", "row")
        .agg(
            F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"),
            F.sum(F.when(F.col("b") >= 0, 1).otherwise(0)).alias("tokens"),
            *(F.sum(f"w{k}").alias(f"s{k}") for k in range(len(model.names))),
        )
    )
    logs = F.array(*(F.lit(prior) + F.col(f"s{k}") / F.col("copies") for k, prior in enumerate(model.priors)))
    top = sums.select("doc_id", "row", "copies", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), logs.alias("l"))
    parts = F.transform("l", lambda x: F.exp(x - F.array_max("l")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    p = top.select("doc_id", "row", "n_tokens", "copies", F.transform(parts, lambda x: x / total).alias("p"))
    return p.select("doc_id", "row", "n_tokens", "p", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, by elimination with pivots; a is small, symmetric and positive."""
    n, rows = len(b), [[*r, y] for r, y in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for j in range(n):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def fit_rates(soft: DataFrame, names: list[str], targets: dict[str, float], least: float = 0.0, steps: int = STEPS) -> Column:
    """The rate of a document, as a column over soft(n_tokens, p).

    The targets are shares of the tokens; one for a domain that is not among names is an error. Without a floor their total is that of the corpus; with one it is the least
    that lets every domain keep what it has. Gradients are scaled by the Gram matrix of the domains over the rows that
    stand above the floor, which each step's aggregate brings along; a step that does not help is shortened."""
    k = len(names)
    p = [F.element_at("p", i + 1) for i in range(k)]
    t = F.col("n_tokens").cast("double")

    def sums(rate: Column, begin: bool = False) -> tuple[list[float], list[list[float]]]:
        """Expected tokens by domain at a rate, and the Gram matrix of the rows above the floor, as shares of all."""
        free = F.when((rate > least) | F.lit(begin), t).otherwise(0.0)
        got = soft.agg(*(F.sum(rate * t * x) for x in p), *(F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i + 1))).first()
        gram, at = [[0.0] * k for _ in range(k)], k
        for i in range(k):
            for j in range(i + 1):
                gram[i][j] = gram[j][i] = got[at] / total
                at += 1
        return [x / total for x in got[:k]], gram

    rate = F.lit(1.0)
    total = float(soft.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return rate
    unknown = sorted(d for d, s in targets.items() if s > 0 and d not in names)
    if unknown:
        raise ValueError(f"targets for domains that no labelled row has: {unknown}")
    share = [max(0.0, targets.get(n, 0.0)) for n in names]
    if not sum(share):
        raise ValueError(f"no target for any of the domains {names}")
    share = [s / sum(share) for s in share]
    have, gram = sums(rate, begin=True)  # all rows may rise
    scale = max((least * h / s for h, s in zip(have, share) if s > 0), default=1.0) if least > 0 else 1.0
    wanted = [s * max(1.0, scale) for s in share]
    error, length = [h - w for h, w in zip(have, wanted)], 1.0
    for _ in range(steps):
        size = math.sqrt(sum(e * e for e in error))
        if size < TOLERANCE or length < 1e-3:
            break
        step = _solve([[x + (1e-6 if i == j else 0.0) for j, x in enumerate(row)] for i, row in enumerate(gram)], error)
        tried = F.greatest(F.lit(float(least)), rate - sum((x * F.lit(length * s) for x, s in zip(p, step)), F.lit(0.0)))
        got, free = sums(tried)
        new = [g - w for g, w in zip(got, wanted)]
        if math.sqrt(sum(e * e for e in new)) < size:
            rate, error, gram, length = tried, new, free, 1.0
        else:
            length /= 4
    return rate


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0) -> DataFrame:
    """doc_id, row, n_tokens, p_<domain> ..., rate, copies for every row of docs(doc_id, text, ...).

    copies is the rate's whole part, plus one with the odds of the rest, by a hash of the row. Null and empty texts have
    no tokens, the classifier's priors as posterior, and a rate by it. Repeated rows have equal values. An empty table
    gives an empty one; domains without a target have the target zero, and a target without labelled rows is an error;
    other columns are not read.
    """
    model = fit_domains(labelled)
    soft = keep(posteriors(docs, model), "posteriors")
    rate = fit_rates(soft, model.names, targets, least)
    u = F.pmod(F.xxhash64("row", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    rated = soft.withColumn("rate", rate)
    copies = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.select("doc_id", "row", "n_tokens", *(F.element_at("p", i + 1).alias(f"p_{n}") for i, n in enumerate(model.names)), "rate", copies.alias("copies"))


def remixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0) -> DataFrame:
    """docs with each row as often as its rate says, with docs' columns. Rows alike in doc_id and text have one rate and
    are each drawn alike; rows with nulls, empty and very long texts are as mix() says; an empty table stays empty."""
    changed = mix(docs, labelled, targets, least).where("copies <> 1").select("doc_id", "row", "copies").distinct()
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("r"))
    # The changed rows grow with the input, so both sides are shuffled at any size.
    joined = tagged.join(changed.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")), "left")
    n = F.coalesce("copies", F.lit(1))
    many = joined.where(n > 0).select("d", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    return many.select(*(F.col("d")[c].alias(c) for c in docs.columns))
