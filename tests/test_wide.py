import random

from tidegrid.operators.wide import Attribute, wide_table

SCHEMA = "stay BIGINT, at DOUBLE, attribute STRING, num DOUBLE, txt STRING, stored DOUBLE, rid BIGINT, e STRING, conflicts STRING"
NAMES = [Attribute(f"a{i}", "double") for i in range(7)] + [Attribute("word", "string")]


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def test_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.randint(1, 4), float(rng.randint(0, 9)), f"a{rng.randint(0, 6)}", rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), None, float(rng.randint(0, 3)), i) for i in range(300)]
    data += [(1, 3.0, "word", None, "Calm", 1.0, 1000), (1, 3.0, "word", None, None, 9.0, 1001)]
    want, conflict, keys = {}, {}, set()
    for s, t, a, v, w, st, rid in data:
        keys.add((s, int(t)))
        v = None if v is None or v != v else v
        if v is not None or w is not None:
            k = (s, int(t), a)
            if k not in want or (st, rid) > want[k][0]:
                want[k] = ((st, rid), w if a == "word" else v)
            if v is not None:
                conflict.setdefault(k, set()).add(v)
    got = wide_table(rows(spark, data), NAMES, "stay", "at", fan_in=3).collect()
    assert {(r.stay, r["at"]) for r in got} == keys and len(got) == len(keys)
    for r in got:
        for a in NAMES:
            assert r[a.name] == want.get((r.stay, r["at"], a.name), (None, None))[1]
        assert set(r.conflicts) == {a.name for a in NAMES if len(conflict.get((r.stay, r["at"], a.name), ())) > 1}


def test_nulls_repeats_and_unknown_attributes(spark):
    data = [(None, 1.0, "a0", 1.0, None, 1.0, 1), (1, None, "a0", 1.0, None, 1.0, 2), (1, 1.0, None, 1.0, None, 1.0, 3), (1, 1.0, "other", 1.0, None, 1.0, 4), (1, 2.0, "a1", 5.0, None, None, 5), (1, 2.0, "a1", 5.0, None, None, 5)]
    got = wide_table(rows(spark, data), NAMES, "stay", "at").collect()
    assert [(r.stay, r["at"], r.a0, r.a1, r.conflicts) for r in got] == [(1, 2, None, 5.0, [])]


def test_empty(spark):
    got = wide_table(rows(spark, []), NAMES, "stay", "at")
    assert got.count() == 0 and got.columns == ["stay", "at", *[a.name for a in NAMES], "conflicts"]


def test_one_attribute(spark):
    got = wide_table(rows(spark, [(1, 2.0, "a0", 5.0, None, None, 5)]), NAMES[:1], "stay", "at").collect()
    assert [tuple(r) for r in got] == [(1, 2, 5.0, [])]
