"""Problems 1, 2, 3 and 5 against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.ids import begin_ms, present, trimmed
from quern.operators import badrows, late, orphans, sessions
from tests.conftest import rows


def clean(x):
    x = None if x is None else x.strip(" \t").lower()
    return None if x in (None, "", "-") else x


def orphan_case(seed, n=400, hot=False):
    rnd = random.Random(seed)
    key = lambda: None if rnd.random() < 0.05 else rnd.choice(["", "-", " K1", "k1\t"]) if rnd.random() < 0.05 else "k1" if hot and rnd.random() < 0.4 else f"K{rnd.randrange(80)}"
    dt = lambda: None if rnd.random() < 0.03 else f"2009-03-02-{rnd.randrange(24):02}-05"
    return [(key(), dt()) for _ in range(n)], [(key(), dt()) for _ in range(n // 10)], [(key(), dt()) for _ in range(n)], [(key(), "2009-03-02", f"{rnd.randrange(5):02}", "clash") for _ in range(n)]


def orphans_by_hand(imps, gone, clicks, joined):
    first, there, removed, out = defaultdict(list), set(), defaultdict(list), {}
    for k, dt in imps:
        if clean(k):
            there.add(clean(k))
            first[clean(k)] += [dt] if dt else []
    for k, dt in gone:
        if clean(k):
            removed[clean(k)] += [dt] if dt else []
    n = Counter()
    for k, dt in clicks:
        k = clean(k)
        if k:
            withdrawn = bool(dt) and any(x <= dt for x in removed.get(k, []))
            ok = bool(dt) and any(x <= dt for x in first[k])
            if not ok or withdrawn:
                n["clicks", k, dt, "missing" if k not in there else "withdrawn" if withdrawn else "later"] += 1
    for k, day, hour, _ in joined:
        k = clean(k)
        if k and (k not in there or k in removed):
            n["joined", k, f"{day}-{hour}", "missing" if k not in there else "withdrawn"] += 1
    return sorted(((*k, v) for k, v in n.items()), key=repr)


@pytest.mark.parametrize(("seed", "hot", "n"), [(1, False, 400), (2, True, 400), (3, False, 0)])
def test_orphans(spark, seed, hot, n):
    imps, gone, clicks, joined = orphan_case(seed, n, hot)
    two = "impressionId string, dt string"
    i, g, c = (spark.createDataFrame(x, two) for x in (imps, gone, clicks))
    j = spark.createDataFrame(joined, "impressionId string, day string, hour string, src string")
    refs = orphans.timed_references(c, "clicks").unionByName(orphans.lasting_references(j, "joined"))
    got = orphans.orphan_references(refs, orphans.parent_states(i.withColumn("id", F.lit("clash")), g), 2 * n)
    assert rows(got) == orphans_by_hand(imps, gone, clicks, joined)
    by = orphans.orphans_by_period(got)
    assert (by.agg(F.sum("n_refs")).first()[0] or 0) == sum(x[-1] for x in orphans_by_hand(imps, gone, clicks, joined))


def test_probe_tells_equal_hashes_apart():
    cols = {"kind": [0, 0, 1, 1, 1], "h": [5, 5, 5, 5, 5], "id": ["a", "b", "b", "c", "a"], "src": [None] * 2 + ["s"] * 3, "period": [None] * 2 + ["2"] * 3, "asof": [None] * 2 + [2] * 3,
            "timed": [None] * 2 + [False] * 3, "n_refs": [None] * 2 + [1] * 3, "present": [True] * 2 + [None] * 3, "first_at": [1] * 2 + [None] * 3, "removed": [False, True] + [None] * 3, "removed_at": pa.array([None] * 5, pa.int64())}
    batch = pa.RecordBatch.from_pydict(cols)
    got = [(r["id"], r["reason"]) for b in orphans._probe(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert got == [("b", "withdrawn"), ("c", "missing")]


GOOD = '10.0.0.1 - u [02/Mar/2009:00:15:55 +0000] "GET /a HTTP/1.1" 200 12 "-" "B/1"'
LINES = {
    GOOD: None, GOOD + " \t\r": None, GOOD.replace('"GET /a HTTP/1.1"', '"a \\" b \\\\"'): None, GOOD.replace("12", "-"): None, GOOD.replace("12", "00000000000000000000000000000012"): None,
    GOOD.replace("12", "9223372036854775807"): None, GOOD.replace("10.0.0.1", 'we"ird\\'): None, GOOD.replace('"-"', '""'): None, GOOD.replace("02/Mar", "29/Feb").replace("2009", "2008"): None,
    None: "null_line", "": "field_count", "-- rotated --": "field_count", GOOD + "\n": "embedded_newline", GOOD.replace("GET", "G\nT"): "embedded_newline",
    GOOD.replace("12", "9223372036854775808"): "bad_bytes", GOOD.replace("12", "1e3"): "bad_bytes", GOOD.replace("12", "٣٤"): "bad_bytes", GOOD.replace("12", "--"): "bad_bytes",
    GOOD.replace(" 200", " 600"): "bad_status", GOOD.replace(" 200", " 99"): "bad_status", GOOD.replace(" 200", " 0200"): "bad_status", GOOD.replace(" 200 ", ' "200" '): "layout", GOOD.replace(" 200 ", " 20\\0 "): "layout",
    GOOD.replace("02/Mar", "30/Feb"): "bad_time", GOOD.replace("02/Mar", "2/Mar"): "bad_time", GOOD.replace("02/Mar", "02/mar"): "bad_time", GOOD.replace("00:15:55", "24:15:55"): "bad_time", GOOD.replace(":55 ", ":60 "): "bad_time",
    GOOD.replace("/2009:", "/2009 "): "bad_time", GOOD.replace("+0000", "0000"): "bad_time", GOOD.replace('"GET /a HTTP/1.1"', '""'): "empty_request", GOOD + ' "x"': "field_count", GOOD.replace(" 12", ""): "field_count",
    GOOD[:-1]: "quoting", GOOD.replace("B/1", 'B""1'): "layout", GOOD[:-1] + '\\"': "quoting", GOOD.replace("B/1", 'B "x" 1'): "quoting", GOOD.replace("/a", '"/a'): "quoting", GOOD.replace("- u", "-  u"): "spacing", GOOD.replace(" 12 ", "  12 "): "field_count", " " + GOOD: "spacing",
    GOOD.replace("GET /a HTTP/1.1", "GET /a").replace('"', "`"): "field_count", GOOD + GOOD: "quoting", GOOD.replace("- u", "-\tu"): None,
}


def test_bad_lines(spark):
    lines = list(LINES)
    del LINES[GOOD.replace("- u", "-\tu")]  # a tab within a field is a blank: judged below
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(lines)], "line_no bigint, line string, reason string")
    parsed = badrows.parse_access_lines(df)
    got = {r.row_id: r.reason for r in parsed.collect()}
    for k, x in enumerate(lines):
        if x in LINES:
            want = LINES[x]
            assert (got[k] is None) == (want is None), (x, got[k])
            assert got[k] == want, (x, got[k])
        else:
            assert got[k] is not None
    ok = badrows.loaded(parsed).orderBy("row_id").collect()
    assert len(ok) + badrows.rejected(parsed).count() == len(lines)
    assert (ok[0].status, ok[0].bytes, str(ok[0].dtime), ok[2].request) == (200, 12, "2009-03-02 00:15:55", 'a " b \\')
    assert badrows.parse_access_lines(df.limit(0)).count() == 0


def test_loaded_row_faults(spark):
    cases = [(200, "1", None), (200, "-", None), (200, "9223372036854775807", None), (200, "000000000000000000009", None), (99, "1", "bad_status"), (600, "1", "bad_status"), (None, "1", "bad_status"), (200, None, "bad_bytes"),
             (200, "", "bad_bytes"), (200, "9223372036854775808", "bad_bytes"), (200, "-1", "bad_bytes"), (200, " 5", "bad_bytes"), (200, "5\n", "bad_bytes"), (200, "٣", "bad_bytes"), (200, "9" * 60, "bad_bytes")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "log_id bigint, status int, bytes_string string, reason string")
    got = badrows.rejected_loaded(df)
    assert rows(got) == sorted(((i, c[2]) for i, c in enumerate(cases) if c[2]), key=repr)
    assert badrows.rejected_loaded(df.limit(0)).count() == 0


HOUR0 = 343656  # 2009-03-16 00:00 as hours since 1970


def name(minute):
    import datetime as dt

    return (dt.datetime(1970, 1, 1) + dt.timedelta(minutes=minute)).strftime("%Y-%m-%d-%H-%M")


def late_case(seed, n):
    rnd = random.Random(seed)
    begin = {k: None if rnd.random() < 0.1 else (HOUR0 + rnd.randrange(40)) * 3_600_000 + rnd.randrange(3_600_000) for k in range(60)}
    delay = lambda: rnd.choice([-5, 0, 10, 79, 80, 81, 400, 1499, 1500, 1501, 3000])
    slot = lambda k: ((begin[k] or HOUR0 * 3_600_000) // 3_600_000) * 60 + delay()
    imps, clicks, joined = [], [], []
    for _ in range(n):
        k = rnd.randrange(60)
        b = begin[k]
        imps.append((rnd.choice([f"K{k}", f" k{k}\t", None, "-"]), rnd.choice([str(b) if b else "x", "", f" {b} " if b else None]), rnd.choice([name(slot(k)), "bad", None])))
        k = rnd.randrange(70)
        clicks.append((f"k{k}", name(slot(min(k, 59)))))
        k = rnd.randrange(65)
        h = (begin.get(k) or HOUR0 * 3_600_000) // 3_600_000
        joined.append((f"K{k}", rnd.choice([True, False, None]), name(h * 60)[:10], name(h * 60)[11:13]))
    return imps, clicks, joined


def late_by_hand(imps, clicks, joined):
    import datetime as dt

    def at(x):
        try:
            return int((dt.datetime.strptime(x, "%Y-%m-%d-%H-%M") - dt.datetime(1970, 1, 1)).total_seconds()) // 60
        except (TypeError, ValueError):
            return None

    hour, imp, clk, known = {}, {}, {}, set()
    for k, b, d in imps:
        k, b = clean(k), (b or "").strip(" \t")
        if k:
            known.add(k)
            if len(b) == 13 and b.isdigit():
                hour[k] = int(b) // 3_600_000
            if at(d) is not None:
                imp[k] = min(imp.get(k, 10**9), at(d))
    for k, d in clicks:
        clk[clean(k)] = min(clk.get(clean(k), 10**9), at(d))
    found, figures = set(), Counter()
    for src, times in (("impressions", imp), ("clicks", clk)):
        for k, t in times.items():
            if k in known and k in hour:
                start = hour[k] * 60
                if start + 80 <= t < start + 1500:
                    found.add((src, k, hour[k]))
                for what, ok in (("provisional", t < start + 80), ("final", t < start + 1500), ("dropped", t >= start + 1500)):
                    figures[name(start)[:13], f"{src}_{what}"] += ok
    for k, c, day, h in joined:
        start = at(f"{day}-{h}-00")
        if c is not True and clean(k) in clk and clk[clean(k)] < start + 1500:
            found.add(("joined_impressions", clean(k), start // 60))
    return found, figures


@pytest.mark.parametrize(("seed", "n"), [(1, 600), (2, 60), (3, 0)])
def test_late_events(spark, seed, n):
    imps, clicks, joined = late_case(seed, n)
    i = spark.createDataFrame(imps, "impressionId string, requestBeginTime string, dt string").withColumn("src", F.lit("clash"))
    c = spark.createDataFrame(clicks, "impressionId string, dt string")
    j = spark.createDataFrame(joined, "impressionId string, clicked boolean, day string, hour string")
    ids = late.id_arrivals(i, c)
    events = late.deliveries(ids).unionByName(late.stale_publications(j, ids))
    found, figures = late_by_hand(imps, clicks, joined)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many steps of the clock
    try:
        released = late.k_slack(events).cache()
        assert {tuple(r) for r in late.corrections(released).collect()} == found
        for r in late.hourly_figures(released).collect():
            for f in ("impressions", "clicks"):
                for what in ("provisional", "final", "dropped"):
                    assert r[f"{f}_{what}"] == figures[r.evhour, f"{f}_{what}"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def visits_by_hand(events, gap):
    per = defaultdict(list)
    for k, t in events:
        if k is not None and t is not None:
            per[k].append(t)
    out = []
    for k, ts in per.items():
        ts.sort()
        start = n = 0
        for x in range(1, len(ts) + 1):
            if x == len(ts) or ts[x] - ts[x - 1] > gap:
                out.append((k, ts[start], ts[x - 1], ts[x - 1] - ts[start], x - start))
                start = x
    return sorted(out, key=repr)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-60, 300))), max_size=60), st.integers(1, 12))
def test_sessions_property(spark, events, gap):
    df = spark.createDataFrame(events, "k string, t bigint")
    assert rows(sessions.sessions(df, F.col("k"), F.col("t"), gap)) == visits_by_hand(events, gap)


def test_sessions_long_chain_and_hot_key(spark):
    events = [("hot", 1000 * k) for k in range(300)] * 2 + [("hot", 10**7)] + [(f"c{k % 7}", k * 777) for k in range(200)]
    df = spark.createDataFrame(events, "k string, t bigint").withColumn("n", F.lit("clash"))
    assert rows(sessions.sessions(df, F.col("k"), F.col("t"), 1000)) == visits_by_hand(events, 1000)


def test_session_key_and_time_as_stated(spark):
    raw = spark.createDataFrame([(" c\t", "1235952145480"), ("c", " 1235953945480"), ("-", "1235952145480"), ("c", "123"), (None, None), ("c", "1235955745481")], "userCookie string, requestBeginTime string")
    got = sessions.sessions(raw, present(trimmed(F.col("userCookie"))), begin_ms(F.col("requestBeginTime")))
    assert rows(got.select("key", "start_ms", "end_ms")) == [("c", 1235952145480, 1235953945480), ("c", 1235955745481, 1235955745481)]
