"""Quality by ordinal cumulative-link regression on graded ratings.

A document's score is the sum of shared weights of its hashed text features; ordered thresholds cut the score into
grades: P(grade <= j) = logistic(threshold j - score). The expected grade and the probability of the top grade follow.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_filter, arrow_map, keep, least_hashed

HASH_BITS = 18
GRADES = 3
#: Letters of a word that its forms share.
STEM = 5
#: Rated rows that the model is fitted on at most: those whose ids have the least hash.
SAMPLE = 12_000
MIN_TAIL = 0.5
#: Features that the model has at most.
FEATURES = 8192
LETTERS = re.compile(r"[^\W\d_]+")
_LEAST_Z, _EPOCHS, _BATCH, _RATE, _DECAY = 4.0, 40, 128, 0.3, 1e-4


_MASK = (1 << HASH_BITS) - 1
#: Of every character of one unit: whether it is a letter, and whether a capital.
_KINDS = np.fromiter((chr(c).isalpha() + 2 * chr(c).isupper() for c in range(1 << 16)), np.uint8, 1 << 16)


class _Hashes(dict):
    """Hashes of names, remembered until there are half a million."""

    def __missing__(self, name: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        got = self[name] = xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 3) & _MASK
        return got


_hash = _Hashes()


def _letters(text: str) -> tuple[int, int]:
    """How many letters and capitals a text has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KINDS[points[points < 1 << 16]], minlength=4)
    beyond = [chr(p) for p in points[points >= 1 << 16].tolist()]
    return int(kinds[1] + kinds[3]) + sum(map(str.isalpha, beyond)), int(kinds[2] + kinds[3]) + sum(map(str.isupper, beyond))


def _bin(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def features(text: str | None) -> np.ndarray:
    """Sorted hashes of what a text has (words even, others odd): words (lower case, without marks), beginnings of longer
    words (so that other forms of a word count with it), marks at the ends of words, and grades of its
    repetition, capitals, marks and length. Presence counts, not number: long texts weigh as short ones."""
    raw = (text or "").split()
    distinct = set(raw)
    words = set(LETTERS.findall(" ".join(distinct).lower()))
    words |= {f"{w[:STEM]}*" for w in words if len(w) > STEM}
    marks = [w.strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for w in distinct if not w[-1].isalnum()]
    names = {f"m:{w[-3:]}" for w in marks}
    n = max(1, len(raw))
    letters, capitals = _letters(text or "")
    chars = max(1, sum(map(len, raw)))
    names |= {
        f"repeat:{_bin(len(distinct) / n, (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8))}:{_bin(n, (20, 100, 500, 3000))}",
        f"capitals:{_bin(capitals / max(1, letters), (0.02, 0.1, 0.3, 0.6))}",
        f"letters:{_bin(letters / chars, (0.3, 0.5, 0.7, 0.8, 0.9, 0.95))}",
        f"words:{_bin(n, (2, 5, 10, 20, 50))}",
        f"length:{_bin(chars / n, (2.5, 3.5, 4.5, 6, 8, 11))}",
    }
    get = _hash.__getitem__
    of_words, of_names = (np.fromiter(map(get, x), np.int32, len(x)) for x in (words, names))
    return np.unique(np.concatenate([of_words & ~1, of_names | 1]))


class OrdinalModel:
    """weights over hashed features, and GRADES - 1 ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -60, 60)))


def likelihood(weights: np.ndarray, cuts: np.ndarray, cols: np.ndarray, where: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log odds of the grades of some rows, and its gradient by weights and by cuts. Entry k says that
    row where[k] has feature cols[k]."""
    n, levels = len(grades), len(cuts) + 1
    scores = np.bincount(where, weights[cols], minlength=n)
    below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-60.0], cuts, [60.0]])[None, :] - scores[:, None], -60, 60)))
    at = np.arange(n)
    low, high = below[at, grades], below[at, grades + 1]
    odds = np.clip(high - low, 1e-9, None)
    d_low, d_high = low * (1 - low) / odds / n, high * (1 - high) / odds / n
    by_cut = np.zeros(levels + 1)
    np.add.at(by_cut, grades + 1, -d_high)
    np.add.at(by_cut, grades, d_low)
    by_score = d_high - d_low
    return float(-np.log(odds).mean()), np.bincount(cols, by_score[where], minlength=len(weights)), by_cut[1:levels]


def train(rows: list, grades: list[int], size: int, levels: int = GRADES, seed: int = 5) -> OrdinalModel:
    """Fits by AdaGrad. rows are the features of each document, numbers below size."""
    y = np.array(grades, np.int64)
    weights, cuts = np.zeros(size), np.linspace(-1, 1, levels - 1)
    if not len(y):
        return OrdinalModel(weights, cuts)
    lens = np.array([len(r) for r in rows])
    flat, starts = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.concatenate([[0], np.cumsum(lens)])
    for j in range(levels - 1):  # start at the grades' own odds
        share = np.clip((y <= j).mean(), 0.01, 0.99)
        cuts[j] = np.log(share / (1 - share))
    cuts += np.arange(levels - 1) * 1e-3
    pushes, cut_pushes, rng = np.full(size, 1e-8), np.full(levels - 1, 1e-8), np.random.default_rng(seed)
    total, total_cuts, taken = np.zeros(size), np.zeros(levels - 1), 0
    for epoch in range(_EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), _BATCH):
            pick = order[at : at + _BATCH]
            lengths = starts[pick + 1] - starts[pick]
            where = np.repeat(np.arange(len(pick)), lengths)
            cols = flat[np.repeat(starts[pick] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
            _, grad, cut_grad = likelihood(weights, cuts, cols, where, y[pick])
            grad = grad + _DECAY * weights
            pushes += grad * grad
            weights -= _RATE * grad / np.sqrt(pushes)
            cut_pushes += cut_grad * cut_grad
            cuts = np.maximum.accumulate(cuts - _RATE * cut_grad / np.sqrt(cut_pushes))
        if 2 * epoch >= _EPOCHS:  # the mean of the later epochs stands for where they waver about
            total, total_cuts, taken = total + weights, total_cuts + cuts, taken + 1
    return OrdinalModel(total / taken, total_cuts / taken)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of labels(doc_id, quality, toxic): 0 toxic text, 1 poor text, 2 good text. The end of the scale has
    no lower bound, so each bad word may count in full."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


def telling(rated: DataFrame, levels: int = GRADES, most: int = FEATURES) -> list[int]:
    """The features of rated(grade, found) that differ most between lower and higher grades at some threshold: those of
    z >= _LEAST_Z that five rows have at least, `most` of them at most, in order."""
    sizes = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())

    def count(grades, found):
        cells = np.concatenate([np.frombuffer(f, np.int32).astype(np.int64) * levels + g for g, f in zip(grades, found)]) if found else np.zeros(0, np.int64)
        cells, n = np.unique(cells, return_counts=True)
        return [cells // levels, cells % levels, n]

    counts = arrow_map(rated.select("grade", "found"), count, "feature int, grade int, n long").groupBy("feature").agg(*(F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).cast("double").alias(f"n{g}") for g in range(levels)))
    scores = []
    for j in range(levels - 1):
        low, high = sum(sizes.get(g, 0) for g in range(j + 1)), sum(sizes.get(g, 0) for g in range(j + 1, levels))
        if low and high:
            c0, c1 = (sum((F.col(f"n{g}") for g in of), F.lit(0.0)) for of in (range(j + 1), range(j + 1, levels)))
            p = (c0 + c1) / total
            scores.append(F.abs(c1 / high - c0 / low) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / high + 1 / low)))
    if not scores:
        return []
    z = F.greatest(F.lit(0.0), *scores)
    seen = sum((F.col(f"n{g}") for g in range(levels)), F.lit(0.0))
    return sorted(r["feature"] for r in counts.select("feature", z.alias("z"), seen.alias("seen")).where((F.col("z") >= _LEAST_Z) & (F.col("seen") >= 5)).orderBy(F.desc("z"), "feature").limit(most).collect())


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, levels: int = GRADES) -> OrdinalModel:
    """From docs(doc_id, text) and ratings(doc_id, grade): at most `sample` rated rows, those whose ids have the least
    hash. An id that is rated several times has its least grade; texts alike in all features count once, with their
    least grade. Without any rated row all grades tie. Only the telling features of these rows come to the driver."""
    spark = docs.sparkSession
    some = least_hashed(ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")), F.xxhash64("doc_id"), sample)
    rated = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text")
    found = arrow_map(rated, lambda ids, grades, texts: [ids, grades, [features(t).tobytes() for t in texts]], "doc_id long, grade int, found binary")
    found = found.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("found").alias("found")).groupBy("found").agg(F.min("doc_id").alias("doc_id"), F.min("grade").alias("grade"))
    found = keep(found.select("doc_id", "grade", "found"), "rated")
    used = np.array(telling(found, levels), np.int32)
    shared = spark.sparkContext.broadcast(used)  # FEATURES numbers

    def among(ids, grades, rows):
        return [ids, grades, [np.flatnonzero(np.isin(shared.value, np.frombuffer(r, np.int32), assume_unique=True)).astype(np.uint16).tobytes() for r in rows]]

    rows = sorted(arrow_map(found, among, "doc_id long, grade int, found binary").collect(), key=lambda r: r["doc_id"])  # sample rows of at most FEATURES numbers
    small = train([np.frombuffer(r["found"], np.uint16) for r in rows], [r["grade"] for r in rows], len(used), levels)
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = small.weights
    return OrdinalModel(weights, small.cuts)


def grade(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, p_top, accepted for every row of docs(doc_id, text, ...).

    A document is accepted if its odds of the top grade are at least min_tail. Null and empty texts are graded as texts
    without words, and very long ones as a whole; repeated rows each get a row; rows without a doc_id keep that null;
    other columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))  # of fixed size
    kind = dict(docs.dtypes)["doc_id"]

    def rows(ids, texts):
        own = OrdinalModel(*shared.value)
        tails = [own.tails(own.score(features(t))) for t in texts]
        return [ids, [float(t.sum()) for t in tails], [float(t[-1]) for t in tails], [bool(t[-1] >= min_tail) for t in tails]]

    return arrow_map(docs.select("doc_id", "text"), rows, f"doc_id {kind}, expected_grade double, p_top double, accepted boolean")


def accepted(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of docs that grade() accepts, with docs' columns. Nulls, empty and very long texts and repeated rows are
    judged as grade() does; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))

    def keeps(texts):
        own = OrdinalModel(*shared.value)
        return [bool(own.tails(own.score(features(t)))[-1] >= min_tail) for t in texts]

    return arrow_filter(docs, "text", keeps)
