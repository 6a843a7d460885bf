import random
import re

import pyarrow as pa

from loomspan.llm import nearcopies as nc


def shingles(name, sql):
    w = re.findall(r"\w+", f"{name or ''} {sql or ''}".lower())
    return set(zip(w, w[1:], w[2:], strict=False))


def brute(rows, likeness=0.65):
    sets = {}
    for i, n, s in rows:
        if i is not None and shingles(n, s):
            sets[i] = shingles(n, s)
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= likeness * len(sets[a] | sets[b])}


def corpus(seed, bases, copies_of_each):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for b in range(bases):
        text = ["insert", "overwrite", "table", *(r.choice(words) for _ in range(r.randrange(20, 150)))]
        for _ in range(r.randrange(1, copies_of_each + 1)):
            own = list(text)
            for _ in range(r.randrange(0, max(2, len(own) // 12))):
                at = r.randrange(len(own))
                own[at : at + r.choice([0, 1, 1])] = [r.choice(words)] * r.choice([0, 1, 1])
            rows.append((i, f"task {b}", " ".join(own)))
            i += 1
    return rows


def run(spark, rows):
    return set(map(tuple, nc.found(spark.createDataFrame(rows, "task_id bigint, task_name string, sql string")).collect()))


def test_recall_against_brute_force(spark):
    rows = corpus(1, 120, 6)
    want, got = brute(rows), run(spark, rows)
    assert got <= want
    assert len(got) >= 0.995 * len(want) > 100


def test_tables_of_the_project(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/tasks.parquet")
    want = brute([(r["task_id"], r["task_name"], r["sql"]) for r in t.collect()])
    assert set(map(tuple, nc.found(t).collect())) == want


def test_large_buckets_are_split_and_finished(spark, monkeypatch):
    monkeypatch.setattr(nc, "BRUTE", 3)
    monkeypatch.setattr(nc, "BLOCK", 4)
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, "t", " ".join([*base[: r.randrange(50, 60)], f"x{i % 9}"])) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_copies_nulls_short_texts_and_repeats(spark, clash):
    rows = [(1, "a b", "c d"), (2, "A", "b, c D"), (3, None, "a b c d"), (4, None, None), (5, "a", "b"), (6, "", ""), (7, "a b", "c d e f g h"), (1, "a b", "c d"), (None, "a b", "c d")]
    assert run(spark, rows) == brute(rows) == {(1, 2), (1, 3), (2, 3)}
    df = clash(spark.createDataFrame(rows, "task_id bigint, task_name string, sql string"))
    g = {r["task_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in nc.groups(df).collect()}
    assert g == {1: (1, 0, 1), 2: (1, 0, 1), 3: (1, 0, 1), 7: (7, 0, 7)}
    assert run(spark, []) == set()


def test_hot_classes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nc.blocks, "BLOCK", 4)
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "p q r s t u v"]
    rows = [(i, "t", texts[i % 3] if i % 5 else "one of a kind " * i) for i in range(45)]
    got = nc.found(spark.createDataFrame(rows, "task_id bigint, task_name string, sql string")).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows)


def test_groups_are_components(spark):
    rows = corpus(8, 40, 5)
    df = spark.createDataFrame(rows, "task_id bigint, task_name string, sql string")
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in run(spark, rows):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r["task_id"]: r["group_id"] for r in nc.groups(df).collect()} == {i: find(i) for i in parent}


def test_buckets_across_batches():
    r = random.Random(1)
    rows = sorted((r.randrange(12), i) for i in range(300))
    rows += [(99, 1000 + i) for i in range(nc.BRUTE + 30)]

    def batches(n):
        for at in range(0, len(rows), n):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows[at : at + n]], pa.int64()), pa.array([i for _, i in rows[at : at + n]], pa.int64())], names=["path", "id"])

    by = {}
    for p, i in rows:
        by.setdefault(p, []).append(i)
    pairs = {(a, b) for p, ids in by.items() if len(ids) <= nc.BRUTE for a in ids for b in ids if a < b}
    large = {(p, i) for p, ids in by.items() if len(ids) > nc.BRUTE for i in ids}
    for n in (1, 7, 50, 1000):
        out = [x for b in nc._buckets(batches(n)) for x in zip(*(b[c].to_pylist() for c in ("path", "a", "b")), strict=True)]
        assert {(a, b) for p, a, b in out if p is None} == pairs
        assert {(p, a) for p, a, b in out if p is not None} == large


def test_very_long_text_in_chunks(spark):
    words = [f"q{i}" for i in range(60_000)]
    rows = [(1, "t", " ".join(words)), (2, "t", " ".join(words[:50_000])), (3, "t", " ".join(words[:20_000])), (4, "t", "a b c d e")]
    assert run(spark, rows) == brute(rows) == {(1, 2)}


def test_contained_variants_of_one_template(spark):
    r = random.Random(2)
    words = [f"w2x{i}" for i in range(150)]
    spans = set()
    while len(spans) < 400:
        a, b = sorted(r.sample(range(151), 2))
        if b - a >= 60:
            spans.add((a, b))
    rows = [(i, "", " ".join(words[a:b])) for i, (a, b) in enumerate(sorted(spans))]
    want, got = brute(rows), run(spark, rows)
    assert got <= want
    assert len(got) >= 0.999 * len(want) > 10_000
