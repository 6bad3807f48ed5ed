"""The stages in turn on the smallest tables: what each keeps is checked against brute force over its own input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafspark.llm import near_copies, simhash
from leafspark.llm.common import keep, table
from test_llm import brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = keep(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(spark, steps):
    want = table(spark, SF, "documents").columns
    assert [a.columns for _, _, a in steps[:-1]] == [want] * 4


def test_quality_leaves_most(spark, steps):
    _, before, after = steps[0]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    all_ids = {r["doc_id"] for r in before.collect()}
    clean = [i for i in all_ids if labels.get(i) == (1, 0)]
    assert len([i for i in clean if i in kept]) >= 0.95 * len(clean)
    assert kept < all_ids


def test_contaminated_go(spark, steps):
    _, before, after = steps[2]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not brute_contamination(r["text"], items)[1]}


def test_mixing_meets_targets_and_sharding_places_all(steps):
    (_, before, mixed), (_, _, placed) = steps[3], steps[4]
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in before.collect()}

    def shares(docs):
        tokens = {}
        for r in docs.collect():
            tokens[r["lang"]] = tokens.get(r["lang"], 0) + len((r["text"] or "").split())
        return [abs(tokens.get(k, 0) / sum(tokens.values()) - t) for k, t in corpus_pipeline.TARGETS.items()]

    assert sum(shares(mixed)) < sum(shares(before)) / 2
    assert sorted(r["doc_id"] for r in placed.collect()) == sorted(r["doc_id"] for r in mixed.collect())


def folder_of(spark, tmp_path, docs, labels, items):
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long, rate double, set string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, rows in (("documents", docs), ("labels", labels), ("benchmark", items)):
        spark.createDataFrame(rows, schema[name]).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, blanks, repeats, a long text, and columns named as those that the operators make."""
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    langs = ["en", "de", "es", "fr"]
    rows = [(i, text(60), langs[i % 4], "s", 1, 0.5, "x") for i in range(60)]
    rows += [(100, None, None, None, None, None, None), (None, text(30), None, None, None, None, None), (None, None, "en", "s", 1, 1.0, "x"), (101, "", "en", "s", 0, 1.0, "x"), (102, text(30000), "de", "s", 1, 1.0, "x"), rows[3], rows[3], (103, rows[5][1], "fr", "s", 1, 1.0, "x")]
    passage = text(20)
    rows.append((104, text(3000) + " " + passage + " " + text(3000), "en", "s", 1, 1.0, "x"))
    sf = folder_of(spark, tmp_path, rows, [(i, 1, 0) for i in range(60)] + [(None, 1, 0), (1, None, None)], [(1, passage), (2, None)])
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, sf), name)
        if name == "near_duplicates":
            got = [x["doc_id"] for x in docs.collect()]
            assert got.count(3) == 1 and 103 not in got and 5 in got and got.count(None) == before.where("doc_id is null").count()
        if name == "decontamination":
            assert 104 not in [x["doc_id"] for x in docs.collect()] and docs.count() == before.where("doc_id is null or doc_id <> 104").count()
        if name != "sharding":
            assert docs.columns == before.columns
    assert docs.count() == before.count()
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], [], [])).isEmpty()


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_firsts(rows):
    """The least doc_id of each component of documents alike to 0.8."""
    sets, root = brute_sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_near_copies_are_brute_force(spark):
    """Families of edited copies about the bound, chains, a crowd that share a passage, short and empty texts."""
    r, rows = random.Random(11), []
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([12, 60, 150, 300]))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 30)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
            if r.random() < 0.3:
                base = w  # a chain
    rows += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(r.randrange(30))]) for _ in range(40)]
    rows += ["", None, " \n", "one two", "ONE\x0btwo", "one two three", "x" * 500]
    r.shuffle(rows)
    rows = [(3 * i, t) for i, t in enumerate(rows)]
    frame = spark.createDataFrame([*rows, rows[5], (None, rows[5][1])], "doc_id long, text string").repartition(3)
    got = [x["doc_id"] for x in near_copies.one_of_each(frame).collect()]
    want = brute_firsts(rows)
    assert 40 < len(want) < len(rows) - 40
    assert got.count(None) == 1 and sorted(x for x in got if x is not None) == want


@pytest.mark.parametrize("crowd, block", [(2, 3), (2, 1000), (10, 8)])
def test_crowded_buckets_are_brute_force(spark, monkeypatch, crowd, block):
    """A family about the bound, and texts that share a long passage: nearly all meet in the same buckets."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(crowd + block)
    word = lambda: f"w{r.randrange(9000)}"
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(70)], []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
        rows.append(" ".join([word() for _ in range(r.randrange(30))] + passage))
    rows = list(enumerate(rows))
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = brute_firsts(rows)
    assert 20 < len(want) < 150 and sorted(x["doc_id"] for x in got.collect()) == want


def test_alike_is_brute_force():
    r = random.Random(2)
    sets = [sorted(r.sample(range(60), r.randrange(1, 50))) for _ in range(80)]
    got = near_copies.alike([np.array(s, np.uint64) for s in sets], width=7)
    assert got.tolist() == [[5 * len({*a} & {*b}) >= 4 * len({*a} | {*b}) for b in sets] for a in sets]


def test_stage_leaves_no_near_copies(spark, steps):
    _, before, after = steps[1]
    rows = [(x["doc_id"], x["text"]) for x in before.collect()]
    assert sorted(x["doc_id"] for x in after.collect()) == brute_firsts(rows)
    copy = table(spark, SF, "documents").where("n_chars > 1500").limit(1).collect()[0]
    changed = copy["text"].split()
    changed[40] = changed[100] = "changed"
    near = spark.createDataFrame([(copy["doc_id"], copy["text"]), (10**9, " ".join(changed))], "doc_id long, text string")
    assert [x["doc_id"] for x in corpus_pipeline.one_of_each(spark, near, SF).collect()] == [copy["doc_id"]]


@pytest.mark.parametrize("radius, m", [(8, 3), (5, 4), (3, 2)])
def test_fingerprints_within_a_radius_are_brute_force(spark, radius, m):
    """Random fingerprints, equal ones, and families about the radius."""
    r, fps = random.Random(radius), []
    for _ in range(25):
        base = r.getrandbits(64)
        fps += [base ^ sum(1 << b for b in r.sample(range(64), r.randrange(radius + 3))) for _ in range(12)]
    fps += fps[:3] + [0, 1, (1 << 64) - 1] + [r.getrandbits(64) for _ in range(300)]
    marks = spark.createDataFrame([(5 * i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long").repartition(3)
    want = {(5 * i, 5 * k) for k in range(len(fps)) for i in range(k) if (fps[i] ^ fps[k]).bit_count() <= radius}
    got = [tuple(x) for x in simhash.within(marks, radius, m, crowd=1000).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    some = {tuple(x) for x in simhash.within(marks, radius, m, crowd=4).collect()}
    assert some < want


def test_near_copies_come_by_simhash_too(spark):
    """Without any band, what is alike and within RADIUS bits is still linked, and nothing else."""
    r, rows = random.Random(21), []
    word = lambda: f"w{r.randrange(5000)}"
    for _ in range(15):
        base = [word() for _ in range(r.choice([40, 150, 300]))]
        for _ in range(5):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [None, "", "one two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sketch = near_copies.arrow_map(docs, near_copies._sketch, "doc_id long, key binary, bands array<long>, fp long, size int")
    _, roots = near_copies.groups(docs, sketch.withColumn("bands", F.array().cast("array<long>")))
    sets = brute_sets(rows)
    fps = [simhash.majority(near_copies.shingles(t)) & ((1 << 64) - 1) for t in rows]
    want = {i: i for i in range(len(rows))}
    for _ in rows:
        for i, a in enumerate(sets):
            for k, b in enumerate(sets):
                if a and a != b and 5 * len(a & b) >= 4 * len(a | b) and (fps[i] ^ fps[k]).bit_count() <= near_copies.RADIUS:
                    want[i] = want[k] = min(want[i], want[k])
    least = {}
    for i, a in enumerate(sets):
        least.setdefault(frozenset(a), i)
    assert {x["node"]: x["root"] for x in roots.collect() if x["node"] != x["root"]} == {i: x for i, x in want.items() if i != x and i in least.values()}
    assert 15 < len([i for i, x in want.items() if i != x]) < 60
