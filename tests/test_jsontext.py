import random

from loomspan.functions import jsontext as j


def value(r, depth=0):
    pick = r.randrange(8 if depth < 3 else 5)
    if pick == 0:
        return r.choice(["1", "1.0", "1e0", "10e-1", "0", "-0", "0.0", "100", "1E2", "12345678901234567890123456789012345", "12345678901234567890123456789012345.0", "1.5", "150e-2"])
    if pick == 1:
        return r.choice(["true", "false", "null"])
    if pick < 5:
        return r.choice(['"a"', '"1"', '"true"', '"\\u0061"', '""', '"\\ud800"', '"é"', '"\\u00001"', '"\\u00000,1,0"'])
    if pick < 7:
        return "{" + ",".join(f'"{k}": {value(r, depth + 1)}' for k in r.sample("abc", r.randrange(3))) + "}"
    return "[" + ", ".join(value(r, depth + 1) for _ in range(r.randrange(3))) + "]"


def test_digests_agree_with_values():
    r = random.Random(3)
    texts = [value(r) for _ in range(700)]
    same = {}
    for t in texts:
        same.setdefault(j.comparable(j.parse(t)[1]), set()).add(j.digest(t))
    assert all(len(d) == 1 for d in same.values())
    assert len(set.union(*same.values())) == len(same)
    assert j.digest("{") is None and j.digest(None) is None
