"""Masked pseudo-likelihood by a bidirectional window network in numpy.

The network sees the embeddings of the SIDE words on either side of a place, not the word there, and gives the odds of
every word in three steps: of a class, of a bucket in that class, both by layers that see the context, and of the word
in the bucket by its exact count in the corpus. So the odds of all words of the corpus sum to one at every place. The
sum of the log odds of all words scores a document.

The VOCABULARY most frequent words are looked up in memory: each has its embedding, and the most frequent ones a bucket
of their own. All other words have hashed embeddings, more of them the more distinct words there are (up to HASHED), and
buckets by the same hash. Their counts, a table as large as the corpus makes it, are joined to the texts by the words'
hashes and never gathered in one place.

The network is trained on all texts: every task trains a copy on its own rows, the copies are averaged by the words that
they saw (an embedding by how often they saw its words), in a shuffled sum, and the average begins the next round. A
round masks one fold of the places; with as many rounds as folds every place of every text is predicted once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map, keep, small_batches, text_bytes

VOCABULARY, CLASSES, BUCKETS = 50_000, 16, 64
#: Hashed embeddings: a power of two, one to KINDS_A_ROW distinct words beyond the vocabulary; least and greatest number.
KINDS_A_ROW, NEAR, HASHED, _SEED = 4, 1 << 10, 1 << 16, 42
SIDE, WIDTH, HIDDEN = 2, 8, 24
ROUNDS, FOLDS, BATCH, RATE = 2, 2, 2048, 0.08
_FLUSH = 500_000
#: Odds in logs: of what is never, and the most that any are; and the least odds that a log is taken of.
_NEVER, _MOST, _LEAST = np.float32(-1e9), np.float32(60), np.float32(1e-30)


def words_of(text: str | None) -> list[bytes]:
    """Words at ASCII white space, A-Z in lower case, whole text."""
    return text_bytes(text).lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts. Tasks count before the shuffle, and send on what they have when it gets large."""
    small_batches(docs.sparkSession)

    def count(batches):
        seen: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            if len(seen) > _FLUSH:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Ranks(dict):
    """Words' ranks; -1 of any other word."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Vocabulary:
    """Every word's place in the model: its embedding (by rank, or hashed), its cell (class and bucket), and the log of
    its share in the cell; of a word beyond the ranked ones, that of one count, to which the log of its count adds."""

    def __init__(self, ranked: list[tuple[bytes, int]], total: int, kinds: int, classes: int = CLASSES, buckets: int = BUCKETS):
        self.number = _Ranks((bytes(w), i) for i, (w, _) in enumerate(ranked))
        self.counts = np.array([n for _, n in ranked], np.int64)
        inside = int(self.counts.sum())
        self.hashed = min(HASHED, max(NEAR, 1 << max(0, math.ceil((kinds - len(ranked)) / KINDS_A_ROW) - 1).bit_length()))
        outside = max(0, total - inside)
        self.outer = min(classes - 1, max(1, round(classes * outside / total))) if outside else 0
        self.outer_cells = self.outer * buckets
        inner = classes - self.outer
        self.mass = np.zeros((classes, buckets))
        self.cell = np.zeros(len(ranked) + self.hashed, np.int32)
        run, filled = 0, [0] * classes
        for i, (_, n) in enumerate(ranked):
            c = min(inner - 1, inner * run // max(1, inside))
            self.cell[i] = c * buckets + filled[c] % buckets
            filled[c] += 1
            run += n
            self.mass.flat[self.cell[i]] += n
        self.share = np.zeros(len(self.cell), np.float32)
        self.share[: len(ranked)] = np.log(self.counts / self.mass.ravel()[self.cell[: len(ranked)]])
        if self.outer:
            self.cell[len(ranked) :] = inner * buckets + np.arange(self.hashed) % self.outer_cells

    def fill(self, sums: dict[int, int]) -> None:
        """Takes the counts of all other words, summed by their cell among the last ones."""
        first, n = self.mass.size - self.outer_cells, len(self.number)
        for k, s in sums.items():
            self.mass.flat[first + k] = s
        self.share[n:] = -np.log(np.maximum(1, self.mass.ravel()[self.cell[n:]]))

    def outer_cell(self, h: Column) -> Column:
        """The cell among the last ones of a word by its hash."""
        return F.pmod(h.bitwiseAND(F.lit(self.hashed - 1)), F.lit(self.outer_cells)).cast("int")

    @property
    def rows(self) -> int:
        """Embeddings: of each word by rank, hashed ones, and one of what lies beyond either end."""
        return len(self.cell) + 1

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The embedding of each word of all texts, in one row; and of the words beyond the ranked ones, by text and hash:
        the text, the hash, and how often it occurs there."""
        words = [w for t in texts for w in t]
        out = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        other = np.flatnonzero(out < 0)
        hashes = np.fromiter([xxhash.xxh64_intdigest(words[k], _SEED) for k in other.tolist()], np.uint64, len(other))
        out[other] = len(self.number) + (hashes & np.uint64(self.hashed - 1)).astype(np.int32)
        text, hashes = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[other], hashes.view(np.int64)
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])) if len(other) else other
        return out, (text[new], hashes[new], np.diff(np.append(new, len(other))).astype(np.int32))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The size words of greatest n, ties by word. Grades of n, each a sixteenth of a doubling, tell first which words
    can be among them: else every task of the sort would send the driver as many."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 16 x 63 rows at most
    least, above = 0, 0
    for least, k in levels:
        above += k
        if above >= size:
            break
    return [(bytes(r["word"]), r["n"]) for r in counts.where(level >= least).orderBy(F.desc("n"), "word").limit(size).collect()]


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the table of all words' counts."""
    counts = keep(word_counts(docs), "words")
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    ranked = most_frequent(counts, size)
    words = Vocabulary(ranked, total or 0, kinds)
    if words.outer:
        last, least = ranked[-1]
        others = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(bytearray(last)))))
        cell = words.outer_cell(F.xxhash64("word"))  # XXH64 with seed 42, as in numbers()
        words.fill({r["cell"]: r["n"] for r in others.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect()})  # as many rows as cells
    return words, counts


class Network:
    """Embeddings, one hidden layer, odds of classes, odds of buckets by class; params is one flat float32 vector. mass
    has the counts of each class's buckets: the network starts from them, and those without any are never given odds."""

    def __init__(self, mass: np.ndarray, rows: int, params: np.ndarray | None = None, seed: int = 9):
        classes, buckets = mass.shape
        self.shapes = [(rows, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, classes), (classes,), (classes, HIDDEN, buckets), (classes, buckets)]
        sizes = [math.prod(s) for s in self.shapes]
        if params is None:
            rng = np.random.default_rng(seed)
            scales = [0.3, (2 * SIDE * WIDTH) ** -0.5, 0, HIDDEN**-0.5 / 4, 0, HIDDEN**-0.5 / 4, 0]
            params = np.concatenate([rng.standard_normal(n, np.float32) * np.float32(x) for n, x in zip(sizes, scales)])
            starts = np.cumsum([0, *sizes])
            of_class = mass.sum(axis=1)
            params[starts[4] : starts[5]] = np.log(np.maximum(of_class, 1) / max(1, mass.sum()))
            params[starts[6] : starts[7]] = np.log(np.maximum(mass, 1) / np.maximum(of_class, 1)[:, None]).ravel()
        self.params = np.array(params, np.float32)
        self.parts = [p.reshape(s) for p, s in zip(np.split(self.params, np.cumsum(sizes)[:-1]), self.shapes)]
        self.embed, self.w1, self.b1, self.w2, self.b2, self.w3, self.b3 = self.parts
        self.no_class, self.no_bucket = np.where(mass.sum(axis=1) > 0, np.float32(0), _NEVER), np.where(mass > 0, np.float32(0), _NEVER)
        self.pushes = [np.full(s, 1e-3, np.float32) for s in self.shapes]
        self.seen = np.zeros(rows, np.int64)

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """The 2 x SIDE neighbours of every place of one text, as rows of embedding indexes; the last is beyond the ends."""
        padded = np.full(len(numbers) + 2 * SIDE, len(self.embed) - 1, np.int64)
        padded[SIDE : SIDE + len(numbers)] = numbers
        n = len(numbers)
        return np.stack([padded[k : k + n] for k in (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1))], axis=1)

    def forward(self, contexts: np.ndarray, classes: np.ndarray) -> tuple:
        """Inputs, hidden values, odds of all classes and of the buckets of each row's own class (exponentials, with the
        inverse of their sums), and where each class begins. classes are in order."""
        x = self.embed[contexts].reshape(len(contexts), -1)
        h = x @ self.w1
        h += self.b1
        np.maximum(h, 0, out=h)
        z = h @ self.w2
        z += self.b2 + self.no_class
        starts = np.searchsorted(classes, np.arange(len(self.w3) + 1)).tolist()
        y, bias = np.empty((len(h), self.b3.shape[1]), np.float32), self.b3 + self.no_bucket
        for c, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            if a < b:
                np.matmul(h[a:b], self.w3[c], out=y[a:b])
                y[a:b] += bias[c]
        sums = []
        for odds in (z, y):
            np.minimum(odds, _MOST, out=odds)
            np.exp(odds, out=odds)
            sums.append(1 / (odds @ np.ones(odds.shape[1], np.float32)))
        return x, h, z, y, sums, starts

    def log_odds(self, contexts: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The log odds of each row's cell."""
        order, rows = np.argsort(cells, kind="stable"), np.arange(len(cells))
        classes, buckets = np.divmod(cells[order], self.b3.shape[1])
        _, _, z, y, (by_z, by_y), _ = self.forward(contexts[order], classes)
        out = np.empty(len(cells), np.float32)
        out[order] = np.log(np.maximum(z[rows, classes] * by_z, _LEAST)) + np.log(np.maximum(y[rows, buckets] * by_y, _LEAST))
        return out

    def gradient(self, contexts: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log odds of the cells, for each of the params."""
        order, n = np.argsort(cells, kind="stable"), len(cells)
        contexts, rows = contexts[order], np.arange(n)
        classes, buckets = np.divmod(cells[order], self.b3.shape[1])
        x, h, d, e, sums, starts = self.forward(contexts, classes)
        for odds, right, by in ((d, classes, sums[0]), (e, buckets, sums[1])):
            by /= n
            odds *= by[:, None]
            odds[rows, right] -= np.float32(1 / n)
        dh = d @ self.w2.T
        g3, gb3, ones = np.zeros_like(self.w3), np.zeros_like(self.b3), np.ones(n, np.float32)
        for c, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            if a < b:
                dh[a:b] += e[a:b] @ self.w3[c].T
                np.matmul(h[a:b].T, e[a:b], out=g3[c])
                np.matmul(ones[a:b], e[a:b], out=gb3[c])
        dh *= h > 0
        dx = (dh @ self.w1.T).reshape(-1, WIDTH)
        flat = contexts.ravel()
        de = np.empty(self.embed.shape, np.float32)
        for k in range(WIDTH):
            de[:, k] = np.bincount(flat, dx[:, k], minlength=len(self.embed))
        return [de, x.T @ dh, ones @ dh, h.T @ d, ones @ d, g3, gb3]

    def step(self, contexts: np.ndarray, cells: np.ndarray, rate: float = RATE) -> None:
        """One AdaGrad step on the mean negative log odds of the cells."""
        parts = (self.embed, *self.parts[1:])
        for p, g, s in zip(parts, self.gradient(contexts, cells), self.pushes):
            root = g * g
            s += root
            np.sqrt(s, out=root)
            g /= root
            g *= np.float32(rate)
            p -= g


def numbered(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """row, doc_id, the numbers of a text's words, 4 bytes each, and others: the hashes of those beyond the ranked ones,
    with how often each occurs. Texts are cut into words once for all rounds."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(words)  # VOCABULARY words, and a number for each hashed embedding
    kind = dict(docs.dtypes)["doc_id"]
    entry = [pa.field("h", pa.int64()), pa.field("k", pa.int32())]

    def rows(batches):
        for batch in batches:
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            numbers, (text, hashes, times) = shared.value.numbers(texts)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(hashes), pa.array(times)], fields=entry))
            ends = 4 * np.cumsum([0, *map(len, texts)])
            packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(numbers.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, others], ["doc_id", "numbers", "others"])

    out = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, numbers binary, others array<struct<h: long, k: int>>")
    return keep(out.select(F.monotonically_increasing_id().alias("row"), "*"), "numbers")


def other_logs(numbers: DataFrame, counts: DataFrame) -> DataFrame:
    """row, logs, n_novel of rows with words beyond the ranked ones: the sum of the logs of their counts, and how many of
    them no other row has."""
    several = counts.where("n > 1").groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n"))
    places = numbers.select("row", F.explode("others").alias("o")).select("row", "o.h", "o.k")
    novel = F.when(F.col("n").isNull() | (F.col("n") == F.col("k")), F.col("k")).otherwise(0)
    each = places.join(several.hint("shuffle_hash"), "h", "left").select("row", (F.col("k") * F.log(F.coalesce("n", F.lit(1)))).alias("log_n"), novel.alias("novel"))
    return each.groupBy("row").agg(F.sum("log_n").alias("logs"), F.sum("novel").alias("n_novel"))


def train(numbers: DataFrame, words: Vocabulary, rounds: int = ROUNDS, folds: int = FOLDS, batch: int = BATCH) -> np.ndarray:
    """The network's params after rounds over all texts. Each round is one job, whose tasks may be run again."""
    spark = numbers.sparkSession
    small_batches(spark)
    size, shared = words.rows, spark.sparkContext.broadcast((words.mass, words.cell))
    params = Network(words.mass, size).params
    values = [f"v{k}" for k in range(WIDTH)]
    for k in range(rounds):
        start = spark.sparkContext.broadcast(params)  # VOCABULARY + HASHED embeddings at most

        def learn(batches, start=start, fold=k % folds, rate=RATE / (k + 1)):
            mass, cell = shared.value
            net, seen, have, pending = Network(mass, size, start.value), 0, 0, []
            for rows in batches:
                for packed in rows.column(0).to_pylist():
                    if packed:
                        masked = np.random.default_rng(zlib.crc32(packed)).integers(0, folds, len(packed) // 4) == fold
                        pending.append((np.frombuffer(packed, np.int32), masked))
                        have += len(masked)
                        if have >= 8 * batch:
                            seen += _learn(net, pending, cell, rate, batch)
                            pending, have = [], 0
            if pending:
                seen += _learn(net, pending, cell, rate, batch)
            if seen:
                # Embeddings that the task saw, and all other weights in rows of as many.
                used = np.flatnonzero(net.seen)
                rest = net.params[size * WIDTH :]
                rest = np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)
                i = np.concatenate([used, size + np.arange(len(rest))])
                n = np.concatenate([net.seen[used], np.full(len(rest), seen)])
                sums = (np.concatenate([net.embed[used], rest]) * n[:, None]).astype(np.float32)
                for at in range(0, len(i), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(i[part].astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in sums[part].T), pa.array(n[part])], ["i", *values, "n"])

        sums = numbers.select("numbers").mapInArrow(learn, f"i int, {', '.join(f'{v} float' for v in values)}, n long").groupBy("i").agg(*(F.sum(v).alias(v) for v in values), F.sum("n").alias("n"))
        # As many rows as embeddings, and the other weights.
        got = sums.select("i", *((F.col(v) / F.col("n")).cast("float").alias(v) for v in values)).toArrow()
        padded = np.pad(params, (0, -len(params) % WIDTH)).reshape(-1, WIDTH)
        padded[got.column("i").to_numpy()] = np.stack([got.column(v).to_numpy() for v in values], axis=1)
        params = padded.ravel()[: len(params)]
        start.unpersist()
    return params


def _learn(net: Network, pending: list[tuple[np.ndarray, np.ndarray]], cell: np.ndarray, rate: float, batch: int) -> int:
    """Trains on the masked places of some texts in mixed order, on a copy of just the embeddings that are in them."""
    numbers = np.concatenate([n for n, _ in pending])
    masked = np.concatenate([m for _, m in pending])
    used, local, n = np.unique(numbers, return_inverse=True, return_counts=True)
    used = np.append(used, len(net.embed) - 1)
    net.seen[used] += np.append(n, len(pending))
    whole = net.embed, net.pushes[0]
    net.embed, net.pushes[0] = whole[0][used], whole[1][used]
    ends = np.cumsum([len(p) for p, _ in pending])
    contexts = np.concatenate([net.contexts(x) for x in np.split(local, ends[:-1])])[masked]
    cells = cell[numbers[masked]]
    order = np.random.default_rng(len(cells)).permutation(len(cells))
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        net.step(contexts[pick], cells[pick], rate)
    whole[0][used], whole[1][used] = net.embed, net.pushes[0]
    net.embed, net.pushes[0] = whole
    return len(cells)


def log_likelihood(net: Network, cell: np.ndarray, share: np.ndarray, numbers: np.ndarray) -> float:
    """The sum of the words' log odds given both sides, without the log counts of words beyond the ranked ones."""
    total = float(share[numbers].sum(dtype=np.float64))
    contexts = net.contexts(numbers) if len(numbers) else None
    for at in range(0, len(numbers), 4096):
        total += float(net.log_odds(contexts[at : at + 4096], cell[numbers[at : at + 4096]]).sum(dtype=np.float64))
    return total


def log_likelihoods(net: Network, cell: np.ndarray, share: np.ndarray, texts: list[np.ndarray]) -> list[float]:
    """log_likelihood() of many texts; short ones go through the network together."""
    out, group, have = [0.0] * len(texts), [], 0

    def flush() -> None:
        if group:
            numbers = np.concatenate([texts[k] for k in group])
            odds = net.log_odds(np.concatenate([net.contexts(texts[k]) for k in group]), cell[numbers]) + share[numbers]
            for k, part in zip(group, np.split(odds, np.cumsum([len(texts[k]) for k in group])[:-1])):
                out[k] = float(part.sum(dtype=np.float64))

    for k, text in enumerate(texts):
        if len(text) >= 2048:
            out[k] = log_likelihood(net, cell, share, text)
        elif len(text):
            group.append(k)
            have += len(text)
            if have >= 4096:
                flush()
                group, have = [], 0
    flush()
    return out


def score(docs: DataFrame, rounds: int = ROUNDS, folds: int = FOLDS, batch: int = BATCH) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token, n_novel for every row of docs(doc_id, text, ...).

    n_novel counts the words of a row, beyond the most frequent, that no other row has. Null and empty texts have no
    words, a log likelihood of 0, a null per_token and no novel words; very long ones are read and scored whole. Repeated
    rows each get a row with equal values; rows without a doc_id keep that null. An empty table gives an empty one;
    other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    words, counts = vocabulary(docs)
    numbers = numbered(docs, words)
    params = train(numbers, words, rounds, folds, batch)
    shared = spark.sparkContext.broadcast((words.mass, words.rows, words.cell, words.share, params))
    kind = dict(docs.dtypes)["doc_id"]

    made: list[Network] = []

    def rows(keys, ids, packed):
        mass, size, cell, share, weights = shared.value
        if not made:
            made.append(Network(mass, size, weights))
        texts = [np.frombuffer(p, np.int32) for p in packed]
        return [keys, ids, [len(t) for t in texts], log_likelihoods(made[0], cell, share, texts)]

    scored = arrow_map(numbers.select("row", "doc_id", "numbers"), rows, f"row long, doc_id {kind}, n_tokens long, part double")
    total = F.col("part") + F.coalesce("logs", F.lit(0.0))
    return scored.join(other_logs(numbers, counts).hint("merge"), "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"), F.coalesce("n_novel", F.lit(0).cast("long")).alias("n_novel")
    )
