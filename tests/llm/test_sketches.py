"""Problems 4, 6 and 7 against exact answers."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.ids import present, trimmed
from quern.llm import digests, distinct, heavy, queries
from tests.conftest import rows
from tools.compare import compare

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e300, 1e300), min_size=1, max_size=3000), st.sampled_from([20, 100, 500]))
def test_cluster_keeps_weight_and_order(values, compression):
    v = np.array(values)
    means, weights = digests.cluster(v, np.ones(len(v)), compression)
    assert weights.sum() == len(v) and len(means) <= compression / 2 + 2
    slack = 1e-9 * max(1.0, float(np.abs(v).max()))
    assert (np.diff(means) >= -slack).all() and means[0] >= v.min() - slack and means[-1] <= v.max() + slack


def metric_rows(seed, n):
    rnd = random.Random(seed)
    kinds = [lambda: rnd.lognormvariate(0, 2), lambda: rnd.choice([0.1, 0.2, 0.2]), lambda: rnd.uniform(-5, 5), lambda: rnd.choice([0.001, 1e12])]
    out = []
    for _ in range(n):
        h = 0 if rnd.random() < 0.4 else rnd.randrange(5)
        v = rnd.choice([None, float("nan"), float("inf"), float("-inf")]) if rnd.random() < 0.05 else kinds[h % 4]()
        out.append((rnd.choice([None, "x"]) if rnd.random() < 0.03 else f"h{h}", f"d{rnd.randrange(3)}", v))
    return out


def test_percentiles_are_certified_and_add_up(spark):
    data = metric_rows(1, 12000)
    df = spark.createDataFrame(data, "hostname string, dt string, value double").repartition(6)
    exact = defaultdict(list)
    for h, d, v in data:
        if h is not None and v is not None and np.isfinite(v):
            exact[h, d].append(v)
    found = digests.certified_percentiles(df, ["hostname", "dt"]).collect()
    assert {(r.hostname, r.dt) for r in found} == set(exact) and len(found) == len(exact) * len(digests.QUANTILES)
    for r in found:
        v = np.array(exact[r.hostname, r.dt])
        assert r.n == len(v)
        assert r.rank_low == pytest.approx((v < r.value).mean()) and r.rank_high == pytest.approx((v <= r.value).mean())
        assert r.rank_error <= max(digests.STATED_RANK_ERROR, 1 / len(v))
    daily = digests.build_digests(df, ["hostname", "dt"])
    merged = digests.certified(df, digests.estimates(digests.merge_digests(daily, ["hostname"]), ["hostname"]), ["hostname"])
    per = Counter()
    for (h, _), v in exact.items():
        per[h] += len(v)
    got = merged.collect()
    assert {r.hostname: r.n for r in got} == dict(per) and max(r.rank_error for r in got) <= digests.STATED_RANK_ERROR + 1e-4
    assert digests.certified_percentiles(df.limit(0), ["hostname", "dt"]).count() == 0


def test_fold_lets_go_of_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(digests, "HELD_VALUES", 50)
    df = spark.createDataFrame([(f"h{k % 40}", "d", float(k)) for k in range(2000)], "hostname string, dt string, value double")
    got = digests.build_digests(df, ["hostname", "dt"]).select("hostname", "n", "low", "high").collect()
    assert {(r.hostname, r.n, r.low, r.high) for r in got} == {(f"h{k}", 50, float(k), float(k + 1960)) for k in range(40)}


def member_rows(seed, n):
    rnd = random.Random(seed)
    ident = lambda: "hot" if rnd.random() < 0.3 else rnd.choice([None, "", " - ", f"ab{rnd.randrange(9)}f", f" u{rnd.randrange(40)}"])
    return [(rnd.choice(["2009-03-02", "2009-03-03", "2009-07-01", "bad", None]), ident(), rnd.choice([None, "ad1", "ad2"]), rnd.choice([None, "r1", "r2"])) for _ in range(n)]


@pytest.mark.parametrize("n", [1500, 0])
def test_distinct_counts_exact_over_any_days(spark, n):
    data = member_rows(2, n)
    df = spark.createDataFrame(data, "day string, who string, ad string, ref string").withColumn("id", F.lit("clash"))
    idents = {"who": present(trimmed(F.col("who")))}
    keys = [F.col("ad"), F.col("ref")]
    sets = defaultdict(set)
    for day, who, ad, ref in data:
        who = (who or "").strip(" \t")
        if day and day != "bad" and who not in ("", "-"):
            for key in ((), (ad,), (ad, ref)):
                if None not in key:
                    sets[key, day].add(who)
    key_of = lambda r: tuple(r[k] for k in ("k1", "k2") if k in r)
    level = lambda n: {(k, day): who for (k, day), who in sets.items() if len(k) == n}
    parts = [distinct.memberships(df.where(c), idents, keys, F.col("day")) for c in ("day = '2009-03-02'", "day <> '2009-03-02'")]
    for n, members in zip((2, 1, 0), distinct.memberships(df, idents, keys, F.col("day"))):
        patterns = distinct.pattern_totals(members)
        for days in (["2009-03-02"], ["2009-03-03", "2009-07-01"], None):
            want = defaultdict(set)
            for (key, day), who in level(n).items():
                if days is None or day in days:
                    want[key] |= who
            for found in [distinct.distinct_over(patterns, days), *([distinct.distinct_in_all(members)] if days is None else [])]:
                assert {key_of(r.asDict()): r.n_distinct for r in found.collect()} == {k: len(v) for k, v in want.items()}
        assert {(key_of(r.asDict()), r.period): r.n_distinct for r in distinct.distinct_by_period(patterns).collect()} == {k: len(v) for k, v in level(n).items()}
        months = defaultdict(set)
        for (key, day), who in level(n).items():
            months[key, day[:7] + "-01"] |= who
        got = distinct.distinct_by_period(patterns, lambda d: F.trunc(d, "month"))
        assert {(key_of(r.asDict()), r.period): r.n_distinct for r in got.collect()} == {k: len(v) for k, v in months.items()}
        merged = distinct.pattern_totals(distinct.merge(*(p[2 - n] for p in parts)))
        assert rows(merged.select(*distinct.key_columns(merged), "n_ids")) == rows(patterns.select(*distinct.key_columns(merged), "n_ids"))


def test_group_patterns_any_combination(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([None, "hot", *(f"u{k}" for k in range(50))]), rnd.choice([None, *(f"g{k}" for k in range(12))])) for _ in range(700)]
    df = spark.createDataFrame(data, "u string, g string")
    totals, members = distinct.group_patterns(df, F.col("u"), F.col("g"))
    combos = [(f"c{k}", f"g{g}", rnd.choice(["all", "any", "any", "not"])) for k in range(30) for g in rnd.sample(range(12), 4)]
    got = {r.combo: r.n_distinct for r in distinct.combined(totals, members, spark.createDataFrame(combos, "combo string, grp string, role string")).collect()}
    groups = defaultdict(set)
    for u, g in data:
        if u is not None and g is not None:
            groups[g].add(u)
    want = {}
    for k in range(30):
        role = lambda r: [groups[g] for c, g, x in combos if c == f"c{k}" and x == r]  # noqa: B023, E731
        if role("all") or role("any"):
            inside = set.intersection(*role("all")) if role("all") else set.union(*role("any"))
            inside = inside & set.union(*role("any")) if role("any") else inside
            want[f"c{k}"] = len(inside - set().union(*role("not")))
    assert got == {k: n for k, n in want.items() if n}


def test_code_has_its_distance():
    mul, inv = heavy._field()
    code = heavy._generator(mul, inv)
    rnd = np.random.default_rng(4)
    words = [np.array([np.bitwise_xor.reduce(mul[row, d]) for row in code]) for d in rnd.integers(0, 16, (60, heavy.DATA)).astype(np.uint8)]
    assert min((a != b).sum() for i, a in enumerate(words) for b in words[:i]) >= heavy.CHECK + 1
    data = rnd.integers(0, 16, heavy.DATA).astype(np.uint8)
    word = np.array([np.bitwise_xor.reduce(mul[row, data]) for row in code])
    for _ in range(20):
        at = np.sort(rnd.choice(heavy.POSITIONS, heavy.DATA, replace=False))
        assert (heavy._solve(mul, inv, code[at], word[at, None])[:, 0] == data).all()


@pytest.mark.parametrize(("groups", "n", "rounds"), [(2048, 4000, 16), (4, 4000, 16), (1, 4000, 1), (3, 4000, 2), (64, 0, 16), (64, 7, 16)])
def test_frequent_items_exact(spark, groups, n, rounds):
    rnd = random.Random(5)
    pick = lambda: rnd.choice([None, "", "-"]) if rnd.random() < 0.2 else f"heavy{int(rnd.expovariate(0.2))}" if rnd.random() < 0.6 else f"x{rnd.randrange(10**6)}"
    data = [(pick(), pick()) for _ in range(n)]
    df = spark.createDataFrame(data, "a string, item string").repartition(5)
    got = rows(heavy.frequent_items(df, ["a", "item"], one_in=50, groups=groups, rounds=rounds).select("field", "item", "n"))
    want = [(c, k, v) for i, c in enumerate(("a", "item")) for k, v in Counter(x[i] for x in data).items() if k not in (None, "", "-") and v * 50 >= n]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    result = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SMALL)
    assert ": ok," in result, result
