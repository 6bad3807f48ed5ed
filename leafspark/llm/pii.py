"""Personal data: fixed detectors, and bootstrapped contextual extraction.

Seeds are what the detectors find, and words of the shape of keys: long, of letters and digits mixed. Each mention, a
seed or a candidate (a word with digits that is no seed), induces lexical patterns of several kinds: the two tokens
before it, the token before with the mention's shape, the tokens on both sides, the token after with the shape. Tokens are
words and marks, so "token =" is two of them.

Patterns and instances form a graph, which Spark scores in rounds: a pattern by the scores of its distinct instances,
those that are no seed among them, an instance without a seed by its best pattern. Patterns of high confidence that many
different seeds support then discover identifiers, whatever their shape: those get the kind "identifier". Base spans
always stay; what a detector's pattern matches but its test refuses is never an identifier.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map, keep

KINDS = ("email", "ip", "card", "phone", "identifier")
ROUNDS, MIN_CONFIDENCE, MIN_SEEDS = 3, 0.8, 5
#: Characters that a key-shaped word has at least; of a candidate.
KEY, LEAST = 20, 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does: what fails there fails further on in the run.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A candidate: letters, digits and inner marks, with a digit somewhere.
WORD = re.compile(r"(?<![^\W_])(?=[^\W\d_]*+(?:[-._+/@][^\W\d_]++)*+[-._+/@]?\d)[^\W_]++(?:[-._+/@][^\W_]++)*+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
QUOTES = frozenset("\"'`(){}[]<>")
CONTEXT = 64


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind, of what the detectors find; code points, end exclusive."""
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *s) for s in _ips(text)]
        out += [("card", *s) for s in _cards(text)]
        out += [("phone", *s) for s in _phones(text)] if "+" in text else []
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _refused(text: str) -> list[tuple[int, int]]:
    """What the detectors' patterns match, tests or not: numbers that may be decoys."""
    return sorted(m.span() for p in (IP, CARD, PHONE) for m in p.finditer(text) if p is not CARD or sum(map(str.isdigit, m[0])) >= 12)


def shape(word: str) -> str:
    """What a word is made of, and about how long it is."""
    kinds = "".join(k for k, has in (("x", str.isalpha), ("0", str.isdigit)) if any(map(has, word)))
    marks = "".join(c for c in word if not c.isalnum())[:6]
    return f"{'h' if not set(word.lower()) - set('0123456789abcdef') else ''}{kinds}{marks}{min(6, len(word).bit_length())}"


def key_shaped(word: str) -> bool:
    """Long, without marks, with letters and digits that change places often, as in random strings."""
    if len(word) < KEY or not word.isalnum() or not word.isascii():
        return False
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:]))
    return 5 * turns >= len(word)


def patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns that a mention induces, in lower case with digits as 0. Quotes and brackets do not count as tokens."""
    fold = lambda s: DIGIT.sub("0", s.lower())
    before = [t for t in TOKEN.findall(fold(text[max(0, start - CONTEXT) : start])) if t not in QUOTES][-2:]
    after = [t for t in TOKEN.findall(fold(text[end : end + CONTEXT])) if t not in QUOTES][:1]
    form, out = shape(text[start:end]), []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} *")
    if before:
        out.append(f"{before[-1]} <{form}>")
    if before and after:
        out.append(f"{before[-1]} * {after[0]}")
    if after:
        out.append(f"<{form}> {after[0]}")
    return out


def _instance(text: str) -> int:
    return xxhash.xxh64_intdigest(text.lower().encode("utf-8", "surrogatepass"), 11) - (1 << 63)


def mentions(text: str | None, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, and candidates that overlap neither a base span nor a decoy, with their patterns."""
    if not text or (not base and not DIGIT.search(text)):
        return []
    out = [{"seed": True, "base": True, "first": s, "end": e, "patterns": patterns(text, s, e), "instance": _instance(text[s:e])} for _, s, e in base]
    taken, k, reach = sorted({(s, e) for _, s, e in base} | set(_refused(text))), 0, -1
    for m in WORD.finditer(text):
        word, (start, end) = m[0], m.span()
        if len(word) < LEAST:
            continue
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= start:
            out.append({"seed": key_shaped(word), "base": False, "first": start, "end": end, "patterns": patterns(text, start, end), "instance": _instance(word)})
    return out


def score(edges: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """pattern, confidence, seeds of the patterns to trust, from edges(pattern, instance, seed), one for each pair.

    A pattern's confidence is the sum of its instances' strengths over one more than their number. A seed has strength 1,
    another instance the confidence of the best pattern that min_seeds seeds support, 0 at first."""
    strength = keep(edges.select("instance", "seed").groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("strength")), "instances")
    confidence = None
    for k in range(rounds):
        weighed = edges.join(strength.hint("merge"), "instance")
        confidence = keep(weighed.groupBy("pattern").agg((F.sum("strength") / (F.count("*") + 1)).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds")), f"patterns{k}")
        if k + 1 < rounds:
            believed = F.when(F.col("seeds") >= min_seeds, F.col("confidence")).otherwise(0.0)
            learnt = edges.join(confidence.hint("merge"), "pattern").groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("given"), F.max(believed).alias("best"))
            strength = keep(learnt.select("instance", F.greatest("given", "best").alias("strength")), f"instances{k}")
    return confidence.where((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds))


_SPAN = "array<struct<kind: string, first: int, end: int>>"


def _scan(ids, texts):
    keys, base, found = [], [], []
    for i, text in zip(ids, texts):
        spans = base_spans(text)
        keys.append(xxhash.xxh3_128_digest(f"{i}|".encode() + (text or "").encode("utf-8", "surrogatepass")))
        base.append([{"kind": k, "first": s, "end": e} for k, s, e in spans])
        found.append(mentions(text, spans))
    return [ids, keys, base, found]


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")


def _of(kind: str):
    return lambda span: span["kind"] == F.lit(kind)


def discover(scanned: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """row, new (spans of the kind identifier) of scanned(row, mentions) that trusted patterns find. Tables here grow with
    the mentions, so all joins shuffle both sides, at any size."""
    found = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    found = keep(found.select("row", "seed", "base", "first", "end", "instance", F.explode("patterns").alias("pattern")), "mentions")
    edges = keep(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    trusted = score(edges, rounds, min_confidence, min_seeds).select("pattern")
    return found.where("not base").join(trusted.hint("merge"), "pattern", "left_semi").groupBy("row").agg(F.collect_set(F.struct(F.lit("identifier").alias("kind"), "first", "end")).alias("new"))


def personal_data(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_identifier, n_spans for every row of
    docs(doc_id, text, ...).

    The counts and the digest are of base spans; spans and n_spans have discovered identifiers too. A null text is an
    empty one and has no spans; very long ones are read whole. Repeated rows each get a row, with equal values, and count
    once as evidence; rows without a doc_id keep that null. An empty table gives an empty one; other columns are not
    read.
    """
    kind = "array<struct<seed: boolean, base: boolean, first: int, end: int, patterns: array<string>, instance: long>>"
    scanned = keep(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, f"doc_id long, row binary, base {_SPAN}, mentions {kind}"), "scanned")
    new = keep(discover(scanned.where(F.size("mentions") > 0), rounds, min_confidence, min_seeds), "discovered")
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    both = F.concat("base", F.coalesce("new", F.array().cast(_SPAN)))
    order = F.transform(F.array_sort(F.transform(both, lambda s: F.struct(s["first"].alias("first"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["end"].alias("end")))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return scanned.drop("mentions").join(new.hint("merge"), "row", "left").select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(order).alias("spans"),
        F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_identifier"), F.size(both).cast("long").alias("n_spans"),
    )
