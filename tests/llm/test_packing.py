import random
from collections import Counter
from itertools import combinations_with_replacement

import pytest

from loomspan.llm import packing


def test_fullest_is_exact():
    r = random.Random(2)
    for _ in range(200):
        stock = dict(Counter(r.randrange(1, 20) for _ in range(r.randrange(1, 7))))
        room = r.randrange(0, 40)
        best = max((sum(c) for n in range(8) for c in combinations_with_replacement(sorted(stock), n) if sum(c) <= room and all(v <= stock[k] for k, v in Counter(c).items())), default=0)
        got = packing.fullest(stock, room)
        assert sum(k * n for k, n in got) == best
        assert all(n <= stock[k] for k, n in got)


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_everything(seed):
    r = random.Random(seed)
    h = dict(Counter(min(200, int(r.lognormvariate(3.5, 0.9)) + 1) for _ in range(3000)))
    patterns = packing.plan(h, 200)
    used = Counter()
    for times, pattern in patterns:
        assert sum(k * n for k, n in pattern) <= 200
        for k, n in pattern:
            used[k] += n * times
    assert used == Counter(h)
    least = -(-sum(k * n for k, n in h.items()) // 200)
    assert sum(t for t, _ in patterns) <= least + 2
    assert len(patterns) <= 2 * len(h)


def packed(spark, sizes, capacity):
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    return packing.pack(df, capacity).collect()


def test_assignments(spark):
    r = random.Random(5)
    sizes = [(i, r.choice([0, 1, 7, 50, 100, 101, 250, 300, r.randrange(1, 400)])) for i in range(400)]
    rows = packed(spark, sizes, 100)
    pieces = {}
    for x in rows:
        pieces.setdefault(x["doc_id"], []).append((x["piece_no"], x["start"], x["n_tokens"]))
    for doc, n in sizes:
        want = [(k, k * 100, min(100, n - k * 100)) for k in range(-(-n // 100))]
        assert sorted(pieces.get(doc, [])) == want
    boxes = {}
    for x in rows:
        boxes.setdefault(x["container_id"], []).append((x["offset_in_container"], x["n_tokens"]))
    for own in boxes.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert sorted(boxes) == list(range(len(boxes)))
    assert len(boxes) <= -(-sum(n for _, n in sizes) // 100) + 2
    again = packed(spark, sizes[::-1], 100)
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_one_length_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ITEMS", 10)
    rows = packed(spark, [(i, 30) for i in range(500)], 100)
    assert len({(x["container_id"], x["offset_in_container"]) for x in rows}) == 500
    assert max(x["container_id"] for x in rows) == 166


def test_empty_nulls_and_clashing_columns(spark, clash):
    assert packed(spark, [], 100) == []
    assert packed(spark, [(1, 0)], 100) == []
    docs = clash(spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c")], "doc_id bigint, text string"))
    assert [(r["used"], r["n_items"]) for r in packing.containers(docs).collect()] == [(6, 2)]
    assert [r["n"] for r in packing.invariants(docs).collect()] == [0] * 5
    assert packing.summary(docs.limit(0)).first()["n_containers"] == 0
