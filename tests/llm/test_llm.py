"""The training-data operators against brute force on small tables, with the awkward rows in them."""

import bz2
import hashlib
import math
import random
import re
import struct
import time
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafspark.llm import common, decontaminate, html_text, lm, media, mixing, pii, quality, sharding, simhash, substring_dedup
from leafspark.llm.common import clear, components, keep, least_hashed, settle, shared_dir, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id string"


def words(n, seed, kinds=400):
    r = random.Random(seed)
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def awkward():
    """Copies, near copies, shared passages, blanks, nulls, ties, a long text, clashing extra columns."""
    base = words(300, 1)
    near = base[:150] + ["changed"] + base[151:]
    passage = words(60, 2)
    texts = {
        0: " ".join(base),
        1: "  ".join(base).upper(),
        2: " ".join(near),
        3: "",
        4: None,
        5: " \n\t ",
        6: "one two",
        7: "ONE\x0btwo",
        8: " ".join(words(70, 3) + passage + words(40, 4)),
        9: " ".join(words(30, 5) + passage + words(80, 6)),
        10: " ".join(["again"] * 200),
        11: " ".join(["again"] * 120 + words(20, 7)),
        12: "ünïcode ÄÖ 日本 \U0001f600 " * 30,
        13: " ".join(words(30000, 8, 9000)),
        14: " ".join(base),
        15: " ".join(passage[:49]),
        16: " ".join(passage[:50]),
        17: "x" * 5000,
    }
    rows = [(i, t, "en", "s", len(t or ""), i, "clash") for i, t in texts.items()]
    return rows + [rows[14], (None, " ".join(base), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(marks, radius=2):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {m: find(m) for m in marks}


def test_simhash_is_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    marks = {}
    for i, text, *_ in awkward():
        marks.setdefault(brute_fingerprint(text), []).append(i)
    root = brute_components(list(marks))
    least = {}
    for m, ids in marks.items():
        least[root[m]] = min([least.get(root[m], math.inf), *(i for i in ids if i is not None)])
    want = sorted((-1 if i is None else i, f"{brute_fingerprint(t):016x}", least[root[brute_fingerprint(t)]]) for i, t, *_ in awkward())
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got) == want


@pytest.mark.parametrize("crowd", [1, 64])
def test_links_connect_what_brute_force_connects(spark, crowd):
    r = random.Random(4)
    marks = {r.getrandbits(64) for _ in range(150)}
    for m in list(marks)[:60]:
        x = m
        for _ in range(r.randrange(6)):
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            marks.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(m),) for m in marks], "fp long")
    edges = simhash.links(frame, crowd=crowd).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges) or crowd == 1
    got = {n: x for n, x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(list(marks))
    groups = lambda of: sorted(sorted(signed(m) for m in marks if of(m) == k) for k in {of(m) for m in marks})
    assert groups(lambda m: got.get(signed(m), signed(m))) == groups(lambda m: want[m])


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < 0.5
    bits[:, 1] = bits[:, 0]
    both = bits.T.astype(float) @ bits
    for n in (500, 10**6, 10**9):
        groups = simhash.partitions(n, both * n / 500)
        assert sorted(b for g in groups for b in g) == list(range(64))
        chosen = simhash.thresholds(n, both * n / 500, groups, [100 * (k + 1) for k in range(len(groups))])
        assert sum(chosen) == 2 - len(groups) + 1 and min(chosen) >= -1
    assert any({0, 1} <= set(g) for g in groups)


def test_one_of_each(docs):
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect())
    found = {r[0]: r[2] for r in simhash.near_duplicates(docs).collect() if r[0] is not None}
    assert ids == [-1, *sorted(i for i, c in found.items() if i == c)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (159, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 160), 200]}}


def brute_contamination(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, who, t_ = cut(text), set(), set(), text
    for i, t in items:
        v = cut(t)
        n = min(13, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if v and tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                who |= {str(i)} if i is not None else set()
    ids = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t_ or "")]
    firsts, lasts = sorted(k for k in hit if k - 1 not in hit), sorted(k for k in hit if k + 1 not in hit)
    spans = ",".join(f"{places[a][0]}:{places[z][1]}" for a, z in zip(firsts, lasts))
    return len(w), len(hit), len(who), ids, bool(hit) and 20 * len(hit) >= len(w), spans


ITEMS = [(1, " ".join(words(40, 2))), (10, "One, TWO"), (2, None), (3, ""), (4, "?!"), (5, " ".join(words(13, 3))), (6, " ".join(words(14, 3))), (7, "日本"), (None, " ".join(words(13, 4)))]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination_is_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block,))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in decontaminate.contamination(docs, items).collect())
    assert got == sorted((-1 if i is None else i, *brute_contamination(t, ITEMS)) for i, t, *_ in awkward())
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute_contamination(t, ITEMS)[1] for _, t, *_ in awkward())
    assert (len(decontaminate.item_blocks(items)) > 1) == (block == 20)


def test_hits_map_to_the_original():
    text = "Ä  b-C, \U0001f600 three"
    assert [text[a:b] for a, b in decontaminate.word_spans(text)] == ["Ä", "b", "C", "\U0001f600", "three"]
    assert decontaminate.original_spans(text, [(1, 3)]) == [(3, 6)]


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


PII = [
    "mail a.b@c.de, or x@y or q@@z.com; a@b.c@d.e",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 0001.002.03.4 00000001.2.3.4",
    "card 4539 1488 0343 6467 no 4539 1488 0343 6468 4539-1488-0343-6467 1 2 3",
    "tel +1 (743) 555-3824 or +49 30 123456 or +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+4539148803436467 4539148803436467@x.org 10.0.0.1@h.com é@x.de é.a@x.de",
    "@@@ a@b.c. ++1 (2) . 3",
    None,
    "",
]


def test_base_spans_are_brute_force():
    r = random.Random(3)
    texts = PII + ["".join(r.choice("019.+-@ a(.") for _ in range(60)) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_personal_data_discovers_by_context(spark):
    rows = [(i, f"please send it to agent{i}@mail.org today") for i in range(20)]
    rows += [(100 + i, t) for i, t in enumerate(PII)] + [(200, "please send it to 77-1234-XY, thanks"), (201, "built in 1994 or 12345"), (200, "please send it to 77-1234-XY, thanks")]
    got = pii.personal_data(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string"))
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    text = rows[-1][1]
    at = text.index("77")
    assert by[200]["spans"] == f"identifier:{at}:{at + 10}" and by[200]["n_identifier"] == 1 and by[201]["spans"] == ""
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t))
        assert by[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert sum(by[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")) == len(brute_spans(t))
        assert set(base.split(",")) - {""} <= set(by[i]["spans"].split(","))


def secrets(n, seed):
    """Documents with keys after "token =" and member numbers after "member no", some of key shape, most not; others with
    numbers that are none of it. (id, text, the identifiers in it)"""
    r, out = random.Random(seed), []
    prose = lambda k: " ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    for i in range(n):
        kind = i % 6
        if kind == 0:
            key = "a1" + hexes(38)
            out.append((i, f'{prose(9)} token = "{key}" {prose(5)}', [key]))
        elif kind == 1:
            key = r.choice(["k9-", "x7"]) + hexes(r.randrange(4, 9)) + "z1"
            out.append((i, f'{prose(4)} token = "{key}" {prose(8)}', [key]))
        elif kind == 2:
            out.append((i, f"{prose(6)} write to u{i}@mail.org or {prose(2)} {prose(6)}", []))
        elif kind == 3:
            key = f"{r.randrange(100, 999)}-{r.choice('ABC')}{r.randrange(10, 99)}" if r.random() < 0.3 else "m7" + hexes(28) + "9f"
            out.append((i, f"{prose(7)} member no. {key}, {prose(4)}", [key]))
        elif kind == 4:
            out.append((i, f"{prose(7)} in {r.randrange(1900, 2030)} and {r.randrange(1000, 99999)} {prose(3)} 4539 1488 0343 646{r.randrange(8, 10)} {prose(2)}", []))
        else:
            out.append((i, f"{prose(20)} v{r.randrange(9)}.{r.randrange(100)} {prose(3)}", []))
    return out


def test_unseen_identifiers_are_found(spark):
    rows = secrets(900, 4)
    got = {x["doc_id"]: x for x in pii.personal_data(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)).collect()}
    hit = lost = wrong = unseen = 0
    for i, text, want in rows:
        spans = [s.split(":")[1:] for s in got[i]["spans"].split(",") if s.startswith("identifier")]
        found = {text[int(a) : int(b)] for a, b in spans}
        assert got[i]["n_spans"] == got[i]["n_identifier"] + got[i]["n_email"] + got[i]["n_ip"] + got[i]["n_card"] + got[i]["n_phone"]
        hit += len(found & set(want))
        unseen += sum(w in found and not pii.key_shaped(w) for w in want)
        lost += len(set(want) - found)
        wrong += len(found - set(want))
    assert hit >= 0.9 * (hit + lost) and unseen > 150 and wrong == 0


def brute_trusted(edges, rounds, min_confidence, min_seeds):
    seed_of, of = {}, {}
    for p, i, s in edges:
        seed_of[i] = max(s, seed_of.get(i, False))
        of.setdefault(p, []).append((i, s))
    strength = {i: float(s) for i, s in seed_of.items()}
    for k in range(rounds):
        confidence = {p: sum(strength[i] for i, _ in x) / (len(x) + 1) for p, x in of.items()}
        seeds = {p: sum(s for _, s in x) for p, x in of.items()}
        if k + 1 < rounds:
            strength = {i: max([float(seed_of[i]), *(confidence[p] for p, x in of.items() if seeds[p] >= min_seeds and i in [y for y, _ in x])]) for i in seed_of}
    return {p: (confidence[p], seeds[p]) for p in of if confidence[p] >= min_confidence and seeds[p] >= min_seeds}


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_pattern_scores_are_brute_force(spark, rounds):
    r = random.Random(rounds)
    seeds = {i: r.random() < 0.5 for i in range(80)}
    edges = sorted({(f"p{r.randrange(25)}", int(i) % 80) for i in [r.randrange(80) for _ in range(400)]} | {("all", i) for i in seeds if seeds[i]} | {("most", i) for i in list(seeds)[:50] if seeds[i] or i < 4})
    edges = [(p, i, seeds[i]) for p, i in edges]
    frame = spark.createDataFrame(edges, "pattern string, instance long, seed boolean").repartition(3)
    got = {x["pattern"]: (x["confidence"], x["seeds"]) for x in pii.score(frame, rounds, 0.5, 3).collect()}
    want = brute_trusted(edges, rounds, 0.5, 3)
    assert got.keys() == want.keys() and len(got) > 2 and all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in got)


def test_gear_hash_is_rolling():
    data = bytes(random.Random(1).randbytes(3000))
    h, want = 0, []
    for b in data:
        h = (2 * h + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear_hashes(data).tolist() == want
    ends = media.cut(data)
    assert ends[-1] == len(data) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))
    long = bytes(random.Random(2).randbytes(60000))
    assert len(set(media.chunks(b"inserted" + long)) & set(media.chunks(long))) > 10


def test_media_round_trip(spark, docs):
    got = {(-1 if r["doc_id"] is None else r["doc_id"]): r for r in media.media(docs).collect()}
    for i, text, *_ in awkward():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = got[-1 if i is None else i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["feature"].startswith(f"samples={len(payload)};")
    assert got[0][1:] == got[14][1:] == got[-1][1:] and got[3][1:] == got[4][1:]
    assert media.media(docs).count() == len(awkward())


def plain_chunks(payload):
    """Cut byte by byte: after LEAST bytes where the top bits of the hash are zero, after MOST bytes anyway."""
    out, h, start = [], 0, 0
    for i, b in enumerate(payload):
        h = (2 * h + int(media.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if (n >= media.LEAST and h >> (32 - media.CUT_BITS) == 0) or n == media.MOST or i + 1 == len(payload):
            out.append(payload[start : i + 1])
            start = i + 1
    return out


def test_stored_payloads_are_brute_force(spark):
    """Records written out by hand: every distinct chunk is in that of its owner alone."""
    r = random.Random(5)
    block = ["".join(chr(r.randrange(33, 300)) for _ in range(9000)) for _ in range(4)]
    texts = [block[0], block[0] + block[1], block[1] + "x" + block[0], block[2] * 3, "", None, "short", block[3], block[3], block[2] + block[3], "y" * 30000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    name = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    payloads = {}
    for t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        payloads[name(payload)] = (raw, plain_chunks(payload))
    owner, holders = {}, {}
    for p, (_, parts) in sorted(payloads.items()):
        for k, c in enumerate(parts):
            owner.setdefault(c, (p, k))
            holders[c] = holders.get(c, 0) + 1
    want = {}
    for p, (raw, parts) in payloads.items():
        own = [k for k, c in enumerate(parts) if owner[c] == (p, k)]
        whole = len(own) == len(parts)
        head = b"LCDC" + len(raw).to_bytes(8, "little") + len(parts).to_bytes(4, "little") + bytes([whole])
        rows = b"".join(name(c) + len(c).to_bytes(4, "little") + bytes([(k in own) + 2 * (k in own and holders[c] > 1)]) for k, c in enumerate(parts))
        want[p] = head + rows + bz2.compress(raw if whole else b"".join(parts[k] for k in own))
    listed, store = media.build_store(frame)
    assert {bytes(x["name"]): bytes(x["stored"]) for x in store.collect()} == want
    names = {x["doc_id"]: bytes(x["name"]) for x in listed.collect()}
    for x in media.media(frame).collect():
        stored = want[names[x["doc_id"]]]
        assert (x["media_bytes"], x["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    bad = store.withColumn("stored", F.when(F.col("name") == bytearray(names[6]), F.lit(bytearray(want[names[7]]))).otherwise(F.col("stored")))
    with pytest.raises(Exception, match="do not match"):
        media.read_store(bad).collect()


def brute_passages(rows):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows if i is not None}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    out = {}
    for i, w in split.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_repeated_passages_are_brute_force(docs, batches):
    got = substring_dedup.repeated_passages(docs, batches).collect()
    want = brute_passages([(i, t) for i, t, *_ in awkward()])
    assert len(got) == len(awkward())
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r[1:]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["n_removed"] == 0


def test_repeated_passages_of_random_edits(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        w = words(160, r.randrange(4), 50)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(["a", "b"])
        a = r.randrange(60)
        rows.append((i * 3, " ".join(w[a : a + r.randrange(40, 160)])))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == brute_passages(rows)


def test_repeated_passages_at_several_places(spark):
    """Documents that hold a passage twice, of which a smaller one holds a part."""
    rows = []
    for seed in range(6):
        a, b, y = (words(100, 100 * seed + k, 10**6) for k in (1, 2, 3))
        x, z = (words(60, 100 * seed + k, 10**6) for k in (4, 5))
        rows += [(2 * seed, " ".join(a + b)), (2 * seed + 1, " ".join(a + x + y + a + x + z))]
    want = brute_passages(rows)
    assert [want[2 * k + 1][1] for k in range(6)] == [200] * 6
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == want


def test_windows_first_seen_in_wholly_removed_documents(spark):
    """Overlapping excerpts of T cover T, yet windows across their ends are first in T, and repeat after it."""
    rows = []
    for seed in range(6):
        t = words(240, 100 * seed + 1, 10**6)
        o1, o2, o3, o4 = (words(n, 100 * seed + k, 10**6) for k, n in ((2, 30), (3, 30), (4, 60), (5, 60)))
        texts = [t[:140] + o1, o2 + t[100:], t, o3 + t[91:149] + o4]
        rows += [(4 * seed + k, " ".join(x)) for k, x in enumerate(texts)]
    want = brute_passages(rows)
    assert [want[4 * k + 2][1] for k in range(6)] == [240] * 6 and [want[4 * k + 3][1] for k in range(6)] == [58] * 6
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == want


def test_rows_that_share_an_id(spark):
    """Rows in are rows out, each with its own words; a text of the same document takes nothing away."""
    p = " ".join(words(60, 5, 10**6))
    rows = [(1, p), (2, "x " + p + " y"), (2, "other"), (2, p + " tail"), (2, p + " tail"), (3, p), (None, p), (4, None), (4, "")]
    got = [tuple(x)[:3] for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(1, 60, 0), (2, 62, 60), (2, 1, 0), (2, 61, 60), (2, 61, 60), (3, 60, 60), (None, 60, 0), (4, 0, 0), (4, 0, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    alone = spark.createDataFrame([(7, p + " " + p), (7, p)], "doc_id long, text string")
    assert {x["n_removed"] for x in substring_dedup.repeated_passages(alone).collect()} == {0}


def test_an_index_serves_day_after_day(spark, tmp_path):
    """Three days' documents against an index in a folder, opened anew each day; a run half written does not count."""
    r = random.Random(12)
    base = [words(150, 900 + k, 10**6) for k in range(6)]
    rows = []
    for i in range(90):
        t = list(r.choice(base))
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        at = r.randrange(60)
        rows.append((i, " ".join(words(r.randrange(30), 2000 + i, 10**6) + t[at : at + r.randrange(40, 120)] + words(r.randrange(30), 5000 + i, 10**6))))
    want, folder = brute_passages(rows), str(tmp_path / "index")
    for day in range(3):
        today, before = [x for x in rows if x[0] // 30 == day], [x for x in rows if x[0] // 30 < day]
        index = substring_dedup.FingerprintIndex(folder=folder, spark=spark)
        earlier = spark.createDataFrame(before, "doc_id long, text string") if before else None
        got = substring_dedup.repeated_passages(spark.createDataFrame(today, "doc_id long, text string").repartition(2), 2, index, earlier)
        assert {x[0]: tuple(x[1:]) for x in got.collect()} == {i: want[i] for i, _ in today}
        (tmp_path / "index" / "run-90-90").mkdir(exist_ok=True)
    assert sum(want[i][1] > 0 for i in want) > 40 and len(substring_dedup.FingerprintIndex(folder=folder, spark=spark).runs) == 1
    with pytest.raises(ValueError):
        substring_dedup.repeated_passages(spark.createDataFrame(rows[:2], "doc_id long, text string"), 1, substring_dedup.FingerprintIndex(folder=folder, spark=spark))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy the best of the things now</div>
<article><h1>Head &amp; line</h1><p><b>First  para&shy;graph<br>goes on.<p>On.</p><p>x | y | z</p><aside>See the related story</aside>
<div id="comments"><p>I like this and that very much, it was good.</p></div></article><form><input>Sign up</form><footer>&copy; us</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == "Head & line\nFirst para\xadgraph goes on.\nOn.\nx | y | z"


def test_main_text_by_density_alone():
    long = "This is the story of a man who was in the house and had to go to the town with his dog. " * 4
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><div><p>{long}</p><p>And so on.</p><p>{long}</p></div><div><p>Contact</p><p><a href=3>Terms of use</a></p></div>"
    assert html_text.main_text(page) == f"{long.strip()}\nAnd so on.\n{long.strip()}"


class PlainReader(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser: (text, zone, heading, linked characters)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.linked, self.stack, self.raw, self.anchor = [], "", "", [("", "none")], [], False
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((text, self.stack[-1][1], bool(re.fullmatch("h[0-9]", self.stack[-1][0])), min(len(text), self.linked)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if self.raw or tag in html_text.RAW:
            self.raw.append(tag)
            self.text += " "
            return
        if tag == "a":
            self.anchor = True
        if tag in html_text.INLINE:
            self.text += " " if tag == "br" else ""
            return
        self.end()
        self.anchor = False
        if tag in html_text.VOID:
            return
        if tag == "p" and self.stack[-1][0] == "p":
            self.stack.pop()
        self.stack.append((tag, html_text._zone(tag, " ".join(f'{k}="{v}"' for k, v in attrs), self.stack[-1][1])))

    def handle_endtag(self, tag):
        if self.raw:
            if tag in self.raw:
                while self.raw.pop() != tag:
                    pass
            return
        if tag == "a":
            self.anchor = False
        if tag in html_text.INLINE or tag in html_text.VOID:
            return
        self.end()
        self.anchor = False
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.raw:
            self.text += data
            self.linked += len(" ".join(data.split())) if self.anchor else 0


def brute_main_text(page):
    found = PlainReader(page or "").blocks
    links = [n / len(t) for t, _, _, n in found]
    stops = [sum(w.strip(".,;:!?()\"'") in html_text.STOP_WORDS for w in t.lower().split()) / len(t.split()) for t, *_ in found]
    article = any(z == "article" and links[i] <= 0.5 for i, (_, z, _, _) in enumerate(found))
    first = []
    for i, (text, zone, _, _) in enumerate(found):
        if zone == "boiler" or (article and (zone != "article" or links[i] > 0.5)):
            first.append("bad")
        elif article:
            first.append("good" if len(text) >= 70 and stops[i] >= 0.15 else "short")
        elif links[i] > 0.2 or "\xa9" in text or (len(text) >= 70 and stops[i] < 0.15):
            first.append("bad")
        elif len(text) < 70:
            first.append("short")
        else:
            first.append("good" if stops[i] >= 0.3 and len(text) >= 200 else "near")
    out = []
    for i, label in enumerate(first):
        if label in ("short", "near"):
            decided = [k for k in range(len(found)) if first[k] in ("good", "bad") and (not article or found[k][1] == "article")]
            before, after = [k for k in decided if k < i][-1:], [k for k in decided if k > i][:1]
            near = after if found[i][2] and not article else before + after
            kinds = {first[k] for k in near}
            if not kinds:
                label = "good" if article or label == "near" else "bad"
            elif len(kinds) == 1:
                label = kinds.pop()
            elif article or label == "near":
                label = "good"
            else:
                least = min(abs(k - i) for k in near)
                label = "bad" if "bad" in [first[k] for k in near if abs(k - i) == least] else "good"
        if label == "good":
            out.append(found[i][0])
    return "\n".join(out)


def random_page(r):
    stops, others = sorted(html_text.STOP_WORDS), [f"wort{k}" for k in range(200)]
    words = lambda n, p: " ".join(r.choice(stops) if r.random() < p else r.choice(others) for _ in range(n))

    def piece(depth):
        kind = r.choice(["p", "p", "p", "h2", "li", "div", "section", "link", "nav", "mixed"])
        if kind == "link":
            return f"<p><a href='/x'>{words(r.randrange(1, 20), 0.2)}</a> {words(r.randrange(10), 0.3)}</p>"
        if kind == "mixed":
            return f"<p>{words(5, 0.4)} <b>{words(3, 0.5)}</b><br>{words(r.randrange(60), 0.4)} &amp; &eacute;&#66; <script>if (a < b) x('</p>')</script></p>"
        inside = "".join(piece(depth + 1) for _ in range(r.randrange(4))) if kind in ("div", "section", "nav") and depth < 3 else words(r.randrange(70), r.choice([0.05, 0.2, 0.35, 0.5]))
        named = r.choice(["", "", "", " class='sidebar'", ' id="comments"', " role=main", " style='display: none'", " class=text"]) if kind in ("div", "section") else ""
        return f"<{kind}{named}>{inside}</{kind}>"

    body = "".join(piece(0) for _ in range(r.randrange(14)))
    return f"<html><head><title>t</title></head><body>{f'<article>{body}</article><footer>{words(30, 0.4)}</footer>' if r.random() < 0.4 else body}</body></html>"


def test_main_text_is_brute_force(spark):
    r = random.Random(6)
    pages = [random_page(r) for _ in range(400)]
    assert [html_text.main_text(p) for p in pages] == [brute_main_text(p) for p in pages]
    real = table(spark, "/root/testdata/sf0.01", "pages")
    html = {x["page_id"]: x["html"] for x in real.collect()}
    got = {x["page_id"]: x["text"] for x in html_text.extract(real).collect()}
    assert got == {k: brute_main_text(v) for k, v in html.items()}


@pytest.mark.parametrize("unit", ["<a", "<a ", "<p x='", '<a " > "', "<a '\"> \"'", "a=", "<b>", "</p>", "<div class=a-b_"])
def test_broken_pages_take_linear_time(unit):
    began = time.process_time()
    for page in (unit * (1_000_000 // len(unit)), f"<div class='{unit * (1_000_000 // len(unit))}'>"):
        html_text.main_text(page)
        html_text.main_text(page + "'>")
    assert time.process_time() - began < 12


def test_main_text_keeps_formulas_and_media_texts():
    line = "and it was that of the others in the year that they had been with us"
    page = f"<article><p>The <math><mi>x</mi><mo>=</mo><annotation>x=3</annotation><mn>3</mn></math> {line}</p><p class='side'>{line}</p><p><video>told {line}</video></p></article>"
    assert html_text.main_text(page) == f"The x=3 {line}\n{line}\ntold {line}"


def test_pages_repeat_and_may_be_none(spark):
    rows = [(1, "u", "<p>" + "the of and to in is that " * 12), (1, "u", "<p>" + "the of and to in is that " * 12), (None, None, None), (2, "v", "")]
    kinds = "page_id long, url string, html string, text string, n_chars int"
    got = html_text.extract(spark.createDataFrame([(*x, "clash", 3) for x in rows], kinds).repartition(2))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(map(tuple, got.select("page_id", "n_chars").collect()), key=str) == [(1, 299), (1, 299), (2, 0), (None, 0)]
    assert html_text.extract(spark.createDataFrame([], kinds)).isEmpty()


def test_main_text_of_odd_pages(spark):
    odd = [None, "", "<", "<!-- open", "<script>open", "<p", "a < b", "</p></div>", "<article></article>", "<div " * 500, "<p>" * 2000 + "x"]
    frame = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(odd)], "page_id long, url string, html string, text string")
    got = html_text.extract(frame).collect()
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)


def brute_shard(doc_id, tree):
    draw = lambda name, w: -math.log(((xxhash.xxh64_intdigest(struct.pack("<q", doc_id), xxhash.xxh64_intdigest(name.encode(), 42)) >> 11) + 0.5) / 2**53) / w
    pick = lambda of: of[0] if len(of) == 1 else min(of, key=lambda x: draw(*x))
    total = lambda shards: sum(s.weight for s in shards)
    names = list(dict.fromkeys(s.region for s in tree))
    region = pick([(n, total([s for s in tree if s.region == n])) for n in names])[0]
    inside = [s for s in tree if s.region == region]
    rack = pick([(f"{region}/{n}", total([s for s in inside if s.rack == n])) for n in dict.fromkeys(s.rack for s in inside)])[0]
    return int(pick([(f"{rack}/{s.shard}", s.weight) for s in inside if f"{region}/{s.rack}" == rack])[0].rpartition("/")[2])


def test_shards(spark, docs):
    got = sharding.shard_documents(docs, parts=4).collect()
    for r in got:
        text = next(t for i, t, *_ in awkward() if i == r["doc_id"]) or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert r["grown_shard"] in (r["shard"], 16)
        if r["doc_id"] is not None:
            assert r["shard"] == brute_shard(r["doc_id"], sharding.layout(16))
            assert r["grown_shard"] == brute_shard(r["doc_id"], sharding.layout(17))
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weights_move_rows_only_as_they_must(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.layout(16)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    rows = ids.select(sharding.descend(F.col("doc_id"), tree).alias("a"), sharding.descend(F.col("doc_id"), heavier).alias("b")).collect()
    shares = np.bincount([r["a"] for r in rows], minlength=16) / 4000
    assert abs(shares - 1 / 16).max() < 0.02
    region = {s.shard: s.region for s in tree}
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(region[b] == region[5] for _, b in moved)
    rack = {s.shard: s.rack for s in tree}
    assert all(rack[b] == rack[5] for a, b in moved if region[a] == region[5])
    assert all(b == 5 for a, b in moved if rack[a] == rack[5])


def test_mixing(spark, docs, empty):
    rows = [(i, " ".join(words(50, i, 60) if i % 4 else [f"v{w}" for w in words(50, i, 60)]), "a" if i % 4 else "b") for i in range(200)]
    rows += [(500, None, None), (501, "", None), (502, "zz " * 9, None), (0, *rows[0][1:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    labelled = frame.where("doc_id % 2 = 0")
    targets = {"a": 0.5, "b": 0.5}
    got = mixing.mix(frame, labelled, targets).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r["doc_id"] < 200]
    assert all((r["p_b"] > 0.9) == (r["doc_id"] % 4 == 0) for r in known)
    total = sum(r["n_tokens"] for r in got)
    for d in "ab":
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / total - 0.5) < 1e-3
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got)
    raised = mixing.mix(frame, labelled, targets, least=1.0).collect()
    assert all(r["rate"] >= 1 and r["copies"] >= 1 for r in raised)
    mass = [sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in raised) for d in "ab"]
    assert abs(mass[0] / sum(mass) - 0.5) < 0.01
    again = mixing.remixed(frame, labelled, targets, 1.0)
    assert again.columns == frame.columns and again.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()
    assert mixing.mix(frame.limit(0), labelled, targets).count() == 0
    assert {r["rate"] for r in mixing.mix(frame, labelled.limit(0), {"all": 1}).collect()} == {1.0}


@pytest.mark.parametrize("least, targets", [(0.0, {"a": 0.6, "b": 0.1, "c": 0.3}), (0.0, {"a": 0.05, "b": 0.9, "c": 0.05}), (0.7, {"a": 0.2, "b": 0.5, "c": 0.3})])
def test_rates_are_brute_force(spark, least, targets):
    """The same steps in numpy, row by row; and the totals that they are for."""
    r = np.random.default_rng(5)
    p, t = r.dirichlet([0.3, 0.2, 0.4], 300), r.integers(0, 90, 300)
    soft = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens long, p array<double>").repartition(3)
    got = np.array([[x["r"], x["n_tokens"], *x["p"]] for x in soft.withColumn("r", mixing.fit_rates(soft, ["a", "b", "c"], targets, least)).collect()])
    rates = dict(zip(map(tuple, got[:, 2:]), got[:, 0]))
    rate, total, share = np.ones(300), t.sum(), np.array([targets[k] for k in "abc"])
    have, free = (t[:, None] * p).sum(0) / total, np.ones(300, bool)
    wanted = share * max(1.0, max(least * have / share) if least else 1.0)
    error, length = have - wanted, 1.0
    gram = (p * t[:, None]).T @ p / total
    for _ in range(mixing.STEPS):
        size = np.linalg.norm(error)
        if size < mixing.TOLERANCE or length < 1e-3:
            break
        tried = np.maximum(least, rate - length * (p @ np.linalg.solve(gram + 1e-6 * np.eye(3), error)))
        new = ((tried * t)[:, None] * p).sum(0) / total - wanted
        if np.linalg.norm(new) < size:
            rate, error, length, free = tried, new, 1.0, tried > least
            gram = (p * (t * free)[:, None]).T @ p / total
        else:
            length /= 4
    assert np.allclose([rates[tuple(q)] for q in p], rate, rtol=1e-6, atol=1e-6) and rate.min() >= least
    # A floor may leave no rates that meet the targets of soft memberships in full.
    assert np.allclose(((rate * t)[:, None] * p).sum(0) / total, wanted, atol=0.02 if least else 2e-3)


def test_targets_without_labelled_rows_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labelled = docs.select("text", F.lit("x").alias("domain"))
    with pytest.raises(ValueError, match="'y'"):
        mixing.mix(docs, labelled, {"x": 0.5, "y": 0.5})
    assert mixing.mix(docs, labelled, {"x": 0.5, "y": 0.0}).count() == 2


def test_posteriors_are_naive_bayes(spark):
    rows = [(i, " ".join(words(20, i, 30)), "abc"[i % 3]) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.fit_domains(frame)
    bucket = lambda w: ((xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)) % mixing.BUCKETS
    counts = np.full((mixing.BUCKETS, 3), 0.5)
    for _, t, d in rows:
        for w in t.split():
            counts[bucket(w), "abc".index(d)] += 1
    logs = np.log(counts / counts.sum(0))
    assert np.allclose(model.weights, logs)
    for r in mixing.posteriors(frame, model).collect():
        s = model.priors + sum(logs[bucket(w)] for w in rows[r["doc_id"]][1].split())
        p = np.exp(s - s.max())
        assert np.allclose(r["p"], p / p.sum())


def test_word_counts_are_exact(docs):
    got = {bytes(r["word"]): r["n"] for r in lm.word_counts(docs).collect()}
    want = {}
    for _, t, *_ in awkward():
        for w in lm.words_of(t):
            want[w] = want.get(w, 0) + 1
    assert got == want


@pytest.mark.parametrize("size", [1, 5, 60, 1000])
def test_most_frequent_is_a_sort(spark, size):
    r = random.Random(3)
    rows = [(b"%d" % i, r.choice([1, 1, 2, 3, 50, r.randrange(1, 10**6)])) for i in range(300)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    assert lm.most_frequent(counts, size) == sorted(rows, key=lambda x: (-x[1], x[0]))[:size]
    assert lm.most_frequent(counts.limit(0), size) == []


@pytest.mark.parametrize("most", [3, 40, 999, 1000, 5000])
def test_least_hashed_is_a_sort(spark, most):
    ids = spark.range(1000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    want = sorted((x["h"], x["doc_id"]) for x in ids.collect())[:most]
    assert sorted((x["h"], x["doc_id"]) for x in least_hashed(ids, F.col("h"), most).collect()) == want
    same = spark.range(1000).select(F.lit(7).alias("h"))
    assert least_hashed(same, F.col("h"), most).count() == min(most, 1000)


def test_one_of_each_passes_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "p"), (2, "a b c d", "q"), (None, "a b c d", "r"), (3, "other words of it", "s")], "doc_id long, text string, `a.b` string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted(x["a.b"] for x in got.collect()) == ["p", "r", "s"]


def small_network(seed=1):
    r = np.random.default_rng(seed)
    mass = r.integers(0, 5, (4, 6)).astype(float)
    mass[2] = 0
    net = lm.Network(mass, 40, seed=seed)
    for p in net.parts:
        p += r.standard_normal(p.shape).astype(np.float32) * 0.3
    return net, np.flatnonzero(mass.ravel())


def test_network_gradient():
    """Against differences of the loss, and steps lower it."""
    net, cells = small_network()
    r = np.random.default_rng(2)
    contexts, targets = net.contexts(r.integers(0, 39, 50)), r.choice(cells, 50).astype(np.int32)
    loss = lambda: -net.log_odds(contexts, targets).mean(dtype=np.float64)
    for part, grad in zip(net.parts, net.gradient(contexts, targets)):
        flat = part.reshape(-1)
        for k in [*r.integers(0, flat.size, 6), int(np.abs(grad).argmax())]:
            was = flat[k]
            flat[k] = was + 0.001
            up = loss()
            flat[k] = was - 0.001
            down = loss()
            flat[k] = was
            assert abs((up - down) / 0.002 - grad.ravel()[k]) < 2e-3
    before = loss()
    for _ in range(30):
        net.step(contexts, targets)
    assert loss() < before - 0.5
    every = [net.log_odds(contexts, np.full(50, c, np.int32)) for c in cells]
    assert np.allclose(np.exp(every).sum(0), 1, atol=1e-5)


def test_scores_tell_order_from_disorder(spark):
    r = random.Random(2)
    chain = {f"w{i}": [f"w{(3 * i + 1) % 40}", f"w{(5 * i + 2) % 40}"] for i in range(40)}
    rows = []
    for i in range(150):
        w = ["w1"]
        while len(w) < 80:
            w.append(r.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    odd = rows[7][1].split()
    r.shuffle(odd)
    rows += [(900, " ".join(odd)), (901, None), (902, ""), (903, "unseen words here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm.score(frame.repartition(2), rounds=24, batch=64).collect()}
    assert len(got) == len(rows)
    assert got[900]["per_token"] < min(got[i]["per_token"] for i in range(150)) - 0.3
    assert got[901]["log_likelihood"] == 0 and got[901]["per_token"] is None and got[902]["n_tokens"] == 0


def brute_odds(net, voc, counts, words):
    """The odds of every word of the corpus at each place, by the formula, in 64 bits."""
    hashed = lambda w: len(voc.number) + (xxhash.xxh64_intdigest(w, 42) & (voc.hashed - 1))
    row = lambda w: voc.number.get(w, hashed(w))
    soft = lambda z, mass: np.where(mass > 0, np.exp(z - z.max()), 0) / np.where(mass > 0, np.exp(z - z.max()), 0).sum()
    embed, w1, b1, w2, b2, w3, b3 = (p.astype(float) for p in net.parts)
    cell_sum, out = {}, []
    for w, n in counts.items():
        cell_sum[int(voc.cell[row(w)])] = cell_sum.get(int(voc.cell[row(w)]), 0) + n
    for i in range(len(words)):
        x = np.concatenate([embed[row(words[k])] if 0 <= k < len(words) else embed[-1] for k in (i - 2, i - 1, i + 1, i + 2)])
        h = np.maximum(x @ w1 + b1, 0)
        of_class = soft(h @ w2 + b2, voc.mass.sum(1))
        of_bucket = [soft(h @ w3[c] + b3[c], m) if m.any() else m for c, m in enumerate(voc.mass)]
        out.append({w: of_class[voc.cell[row(w)] // lm.BUCKETS] * of_bucket[voc.cell[row(w)] // lm.BUCKETS][voc.cell[row(w)] % lm.BUCKETS] * n / cell_sum[int(voc.cell[row(w)])] for w, n in counts.items()})
    return out


@pytest.mark.parametrize("size, rounds", [(5, 0), (30, 2), (1000, 2)])
def test_scores_are_brute_force(spark, size, rounds):
    """Every word of the corpus has odds at every place, they sum to one, and the scores are the sums of their logs."""
    r = random.Random(size)
    rows = [(i, " ".join(f"w{int(90 * r.random() ** 2)}" for _ in range(r.randrange(50)))) for i in range(30)] + [(None, "w89 w88 rare"), (50, None), (51, "ünïcode rare w1 w2 RARE"), (52, "only here here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    voc, table_of = lm.vocabulary(frame, size)
    counts = {bytes(x["word"]): x["n"] for x in table_of.collect()}
    numbers = lm.numbered(frame, voc)
    net = lm.Network(voc.mass, voc.rows, lm.train(numbers, voc, rounds, batch=64))
    found = numbers.collect()
    parts = lm.log_likelihoods(net, voc.cell, voc.share, [np.frombuffer(x["numbers"], np.int32) for x in found])
    more = {x["row"]: x for x in lm.other_logs(numbers, table_of).collect()}
    got = sorted((str(x["doc_id"]), p + (more[x["row"]]["logs"] if x["row"] in more else 0), more[x["row"]]["n_novel"] if x["row"] in more else 0) for x, p in zip(found, parts))
    want = []
    for i, t in rows:
        words_ = lm.words_of(t)
        odds = brute_odds(net, voc, counts, words_)
        assert all(abs(sum(o.values()) - 1) < 1e-9 for o in odds)
        novel = sum(w not in voc.number and counts[w] == words_.count(w) for w in words_)
        want.append((str(i), sum(math.log(o[w]) for o, w in zip(odds, words_)), novel))
    assert [x[::2] for x in got] == [x[::2] for x in sorted(want)]
    assert np.allclose([x[1] for x in got], [x[1] for x in sorted(want)], rtol=1e-4, atol=1e-3)


def test_scores_of_copies_and_long_texts(spark):
    long = " ".join(words(9000, 3, 3000))
    rows = [(1, "one of a kind"), (2, "two of a sort"), (3, "two of a sort"), (4, long), (5, long + " more")]
    got = {x["doc_id"]: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), batch=64).collect()}
    assert got[2]["log_likelihood"] == got[3]["log_likelihood"] > got[1]["log_likelihood"] and got[4]["n_tokens"] == 9000


def test_embeddings_grow_with_the_distinct_words():
    ranked = [(b"%d" % i, 5) for i in range(100)]
    sizes = [lm.Vocabulary(ranked, 10**9, kinds).hashed for kinds in (100, 10**5, 10**6, 10**8)]
    assert sizes == [1024, 32768, lm.HASHED, lm.HASHED]
    net = lm.Network(np.ones((4, 6)), 3000)
    assert len({tuple(net.embed[k]) for k in (1022, 1023, 1500, 2998)}) == 4
    assert net.contexts(np.array([1500, 2998]))[0].tolist() == [2999, 2999, 2998, 2999]


def test_quality_held_out():
    r = random.Random(6)
    bad = ["awful", "rotten", "vile"]

    def make(grade):
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(30, 200))]
        if grade == 1:
            w[r.randrange(len(w))] = r.choice(bad)
        return " ".join(x + "%%%" for x in w) if grade == 0 else " ".join(w)

    grades = [r.choice([0, 1, 1, 2, 2, 2]) for _ in range(3000)]
    model = quality.train([quality.features(make(g)) for g in grades], grades, 1 << quality.HASH_BITS)
    assert list(model.cuts) == sorted(model.cuts)
    wrong = sum((model.tails(model.score(quality.features(make(g))))[-1] >= 0.5) != (g == 2) for g in grades[:600])
    assert wrong <= 12


def test_quality_gradient():
    """Against differences of the likelihood, written out from the thresholds."""
    r = np.random.default_rng(3)
    weights, cuts, grades = r.standard_normal(9), np.array([-0.7, 0.4, 1.1]), r.integers(0, 4, 25)
    rows = [np.flatnonzero(r.random(9) < 0.4) for _ in grades]
    cols, where = np.concatenate(rows), np.repeat(np.arange(25), [len(x) for x in rows])

    def loss(w, c):
        total = 0.0
        for row, g in zip(rows, grades):
            below = [0.0, *(1 / (1 + math.exp(-(x - sum(w[k] for k in row)))) for x in c), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / 25

    value, by_weight, by_cut = quality.likelihood(weights, cuts, cols, where, grades)
    assert abs(value - loss(weights, cuts)) < 1e-9
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        assert abs((loss(weights + step, cuts) - loss(weights - step, cuts)) / 2e-5 - by_weight[k]) < 1e-6
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert abs((loss(weights, cuts + step) - loss(weights, cuts - step)) / 2e-5 - by_cut[k]) < 1e-6


def test_telling_features_are_brute_force(spark):
    r = random.Random(8)
    rows = [(g, sorted(k for k in range(60) if r.random() < (0.1 + 0.5 * (g if k % 7 == 0 else 1) / 2 if k < 40 else 0.02))) for g in [0, 1, 1, 2, 2, 2] * 150]
    frame = spark.createDataFrame([(g, bytearray(np.array(f, np.int32).tobytes())) for g, f in rows], "grade int, found binary").repartition(3)
    scores = {}
    for k in range(60):
        for j in (0, 1):
            low, high = [k in f for g, f in rows if g <= j], [k in f for g, f in rows if g > j]
            p = (sum(low) + sum(high)) / len(rows)
            z = abs(sum(high) / len(high) - sum(low) / len(low)) / math.sqrt(max(1e-12, p * (1 - p)) * (1 / len(high) + 1 / len(low)))
            if sum(low) + sum(high) >= 5:
                scores[k] = max(z, scores.get(k, 0))
    want = sorted((k for k in scores if scores[k] >= 4), key=lambda k: (-scores[k], k))
    assert quality.telling(frame) == sorted(want) and len(want) >= 5
    assert quality.telling(frame, most=3) == sorted(want[:3])


def test_quality_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(18)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.graded(labels))
    got = quality.grade(docs, model).collect()
    assert len(got) == len(awkward()) and all(0 <= x["expected_grade"] <= 2 for x in got)
    assert quality.accepted(docs, model, 0.0).columns == docs.columns and quality.accepted(docs, model, 0.0).count() == len(awkward())
    nothing = quality.fit(docs, quality.graded(labels.limit(0)))
    assert quality.grade(docs, nothing).count() == len(awkward())


def test_scratch_tables_go(spark, monkeypatch):
    monkeypatch.setattr(common, "_made", [])
    paths = lambda df: {f.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") for f in df.inputFiles()}
    way = []

    def make():
        way.append(keep(spark.range(5), "way"))
        return way[0].where("id > 1")

    old = keep(spark.range(3), "old")
    out = settle(spark, "out", make)
    assert out.count() == 3 and old.count() == 3 and all(Path(p).exists() for p in paths(out) | paths(old))
    clear(spark)
    assert not any(Path(p).exists() for p in paths(out) | paths(old) | paths(way[0]))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    model = quality.train([], [], 1 << quality.HASH_BITS)
    for got in (
        simhash.near_duplicates(empty),
        simhash.one_of_each(empty),
        decontaminate.contamination(empty, items),
        decontaminate.contamination(empty, none),
        pii.personal_data(empty),
        media.media(empty),
        substring_dedup.repeated_passages(empty),
        sharding.shard_documents(empty),
        lm.score(empty),
        quality.grade(empty, model),
    ):
        assert got.collect() == []
