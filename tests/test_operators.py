"""Report, ads, similarity, alignment and keyed-data operators against brute force and small goldens."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.functions import logs as L
from quern.operators import ads, alignment, counting, keyed, log_reports, related
from quern.plans import reports
from tests.conftest import rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_counts(spark):
    df = frame(spark, [("Ab1 9x, foo-bar",), ("foo",), ("",), (None,)], "text string")
    assert rows(counting.word_count(df, "text")) == [("ab1", 1), ("bar", 1), ("foo", 2), ("x", 1)]
    g = frame(spark, [("/guid/a,/guid/b x/guid/c",), ("/guid/a",)], "text string")
    assert rows(counting.token_count(g, "text", "/guid/")) == [("/guid/a", 2), ("/guid/b", 1)]
    assert rows(counting.token_count(g, "text", "/guid/", anywhere=True)) == [("/guid/a", 2), ("/guid/b", 1), ("x/guid/c", 1)]
    t = frame(spark, [("b", 2), ("a", 2), ("c", None), ("d", 3)], "k string, n int")
    assert [r.k for r in counting.top(t, "n", 3, "k").collect()] == ["d", "a", "b"]
    assert counting.word_count(df.limit(0), "text").count() == 0


def test_cdn_reports_agree(spark):
    rnd = random.Random(2)
    data = [(f"ip{rnd.randrange(5)}", f"o{rnd.randrange(7)}", "E1", rnd.choice(["200", "404"]), rnd.randrange(1000), 1233450000 + rnd.randrange(5000)) for _ in range(500)]
    df = frame(spark, data, "IP string, Object string, EdgeLocation string, HTTPResponse string, Bytes bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    out = log_reports.cdn_reports(df)
    assert len(out) == 12
    for name, f in out.items():
        total = f.agg(F.sum("TotalBytes" if "TotalBytes" in f.columns else "RequestCount")).first()[0]
        assert total == (sum(x[4] for x in data) if "bytes" in name else 500)
    counts = [tuple(r) for r in out["client-ip-request-count"].collect()]
    assert counts == sorted(Counter(x[0] for x in data).items(), key=lambda x: (x[1], x[0]), reverse=True)
    assert set(log_reports.cdn_reports(df, ["edge-location"])) == {"edge-location-request-count", "edge-location-bytes-transferred", "edge-location-request-count-by-httpresponse"}
    with pytest.raises(ValueError):
        log_reports.cdn_reports(df, ["nothing"])


def test_cdn_lines_keep_every_date_and_row(spark):
    times = ["01/Mar/2009:10:00:00 +0000", "28/Feb/2009:23:59:59 +0100", "31/Dec/2010:00:00:01 -0500", "01/Foo/2009:10:00:00 +0000", "31/Feb/2009:10:00:00 +0000"]
    data = [(1000 * i, "192.0.2.1", t, "GET /a HTTP/1.1", 200, "7", "agent x") for i, t in enumerate(times)] + [(1, "192.0.2.1", times[0], "GET /a HTTP/1.1", 200, "7", "agent x")]
    lines = reports.cdn_lines(frame(spark, data, "log_id bigint, remoteAddr string, time string, request string, status int, bytes_string string, browser string"))
    assert lines.where("line like '#%'").count() == 4
    out = log_reports.cdn_reports(L.parse_cdn(lines))
    assert rows(out["client-ip-request-count"]) == [("192.0.2.1", 5)] and rows(out["object-popularity-bytes-transferred"]) == [("/a", 35)]
    assert rows(out["overall-volume-request-count"]) == [("2009-02-28 23:55:00", 1), ("2009-03-01 10:00:00", 2), ("2010-12-31 00:00:00", 1)]


def test_access_reports_own_host_and_no_match(spark):
    data = [("1.2.3.4", "http://www.example.org", "2009-01-01 01:00:00", 5), ("1.2.3.9", "http://a.test/x", "2009-01-02 01:30:00", None), ("host", "https://b.test", "2009-01-02 03:30:00", 7), (None, None, None, None)]
    df = frame(spark, data, "remoteAddr string, referrer string, t string, bytes bigint").withColumn("dtime", F.col("t").cast("timestamp"))
    out = log_reports.access_log_reports(df)
    assert rows(out["total_requests_bytes_per_hour"]) == [("01", 2, 5), ("03", 1, 7)]
    assert rows(out["top_50_ips"]) == [("1.2.3.*", 2, 5)]
    assert rows(out["top_50_external_referrers"]) == [("http://a.test", 1)]
    assert rows(out["top_50_search_terms_from_bing_google"]) == []
    bad = log_reports.bad_lines(L.parse_access(frame(spark, [("x",), (None,)], "line string")))
    assert rows(bad) == [(2, 2)]


SEEN = "requestBeginTime string, adId string, impressionId string, referrer string, userAgent string, userCookie string, ip string, dt string"


def test_click_join_windows(spark):
    imp = [("1239610346000", "ad", f"i{k}", "r", "ua", "c", "1.2.3.4", dt) for k, dt in enumerate(["2009-04-13-08-00", "2009-04-13-08-05", "2009-04-13-08-55", "2009-04-13-09-00"])]
    clk = [("i1", "2009-04-13-09-15"), ("i1", "2009-04-13-09-19"), ("i2", "2009-04-13-09-20"), ("i0", "2009-04-13-08-30"), (None, "2009-04-13-08-30")]
    i, c = frame(spark, imp, SEEN), frame(spark, clk, "impressionId string, dt string")
    join = lambda **kw: [(r.impressionId, r.clicked, r.requestBeginTime) for r in ads.click_join(i, c, "2009-04-13-08-00", "2009-04-13-09-00", "2009-04-13-09-20", **kw).orderBy("impressionId").collect()]
    t = "2009-04-13 08:12:26"
    assert join() == [("i1", True, t), ("i1", True, t), ("i2", False, t)]
    assert join(dedupe_clicks=True) == [("i1", True, t), ("i2", False, t)]
    assert join(lower_inclusive=True, dedupe_clicks=True) == [("i0", True, t), ("i1", True, t), ("i2", False, t)]
    assert rows(ads.clicked_counts(ads.click_join(i, c, "2009-04-13-08-00", "2009-04-13-09-00", "2009-04-13-09-20"))) == [(False, 1), (True, 2)]


def test_feature_index(spark):
    data = [("ad1", "Mozilla/5.0 (X11; x11)", "10.20.30.40", "Twitter.com", True), ("ad1", None, "::1", None, None), ("ad1", "", None, "twitter.com", False)]
    got = dict((r.feature, r.clicked_percent) for r in ads.feature_index(frame(spark, data, "adId string, userAgent string, ip string, referrer string, clicked boolean")).collect())
    assert got == {"ua:mozilla": 1.0, "ua:5.0": 1.0, "ua:x11": 1.0, "ip:10.20": 1.0, "ip:": 0.0, "page:twitter.com": 0.5}


def test_response_stats(spark):
    df = frame(spark, [(1.0, "a"), (3.0, "a"), (8.0, None), (float("nan"), "a"), (float("inf"), "b"), (None, "a")], "requestTime double, hostname string")
    assert rows(ads.response_stats(df)) == rows(frame(spark, [("a", 3.0, 1.0, 2.0), (None, 8.0, 8.0, 8.0), ("ALL", 8.0, 1.0, 4.0)], "h string, a double, b double, c double"))
    assert rows(ads.response_stats(df.limit(0))) == []
    req = frame(spark, [("1000", "3500", "h", "d1"), ("1000", "x", "h", "d1"), ("0", "1000", "g", "d2")], "requestBeginTime string, requestEndTime string, hostname string, dt string")
    assert rows(ads.request_times(req, "d1")) == [(2.5, "h"), (None, "h")]


def similarity_by_hand(ratings, n_users):
    import math

    per = defaultdict(dict)
    for u, i, r in ratings:
        per[u][i] = per[u].get(i, 0) + r
    per = {u: {i: math.floor(math.log(r)) + 1 for i, r in items.items()} for u, items in per.items()}
    sums = defaultdict(lambda: [0] * 6)
    for items in per.values():
        for x in items:
            for y in items:
                if x < y:
                    a, b = items[x], items[y]
                    for k, v in enumerate((1, a * a, a, a * b, b, b * b)):
                        sums[x, y][k] += v
    out = {}
    for pair, (n, sxx, sx, sxy, sy, syy) in sums.items():
        spread = math.sqrt(max(0, (n * sxx - sx * sx) * (n * syy - sy * sy)))
        r = round((n * sxy - sx * sy) / spread, 4) if spread else 0.0
        if n < 4:
            out[pair] = (0.0, n)
            continue
        r = max(-0.9999, min(0.9999, r))
        lo, up = math.tanh(math.atanh(r) - 1.96 / math.sqrt(n - 3)), math.tanh(math.atanh(r) + 1.96 / math.sqrt(n - 3))
        lo = 0.0 if r >= 0 and lo < 0 else lo
        s = min(abs(lo), abs(up)) if lo * up < 0 else min(lo, up)
        out[pair] = (s * (n / (n + 20)) ** 2 * math.log(n) / math.log(n_users), n)
    return out


def test_item_similarity_brute_force(spark):
    rnd = random.Random(3)
    data = [(f"u{rnd.randrange(60)}", f"i{rnd.randrange(12)}", rnd.randrange(1, 50)) for _ in range(900)]
    df = frame(spark, data, "user string, item string, rating bigint")
    got = {(r.item_x, r.item_y): (r.sim, r.n) for r in related.item_similarity(df, cutoff=1000, n_users=500).collect()}
    want = similarity_by_hand(data, 500)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9)
    again = {(r.item_x, r.item_y): r.sim for r in related.item_similarity(df.repartition(7, "rating"), cutoff=5, n_users=500).collect()}
    assert again == {(r.item_x, r.item_y): r.sim for r in related.item_similarity(df, cutoff=5, n_users=500).collect()}


def test_no_ratings_are_dropped_above_the_cutoff(spark, tmp_path, monkeypatch):
    """A customer with 200 suppliers and suppliers with 150 customers, through the registered query."""
    monkeypatch.setattr(related, "BLOCK", 64, raising=False)
    bought = [(u, i, 1 + (7 * u + 3 * i) % 50) for u in range(150) for i in range(200 if u == 0 else 60)]
    frame(spark, [(u, u) for u in range(150)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    frame(spark, bought, "l_orderkey bigint, l_suppkey bigint, l_quantity bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = reports.item_similarity(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.sum("n")).first()
    assert tuple(got) == (200 * 199 // 2, 200 * 199 // 2 + 149 * (60 * 59 // 2))


@pytest.mark.parametrize(("block", "held"), [(3, 2_000_000), (1000, 50), (4, 1)])
def test_pair_sums_in_cells(spark, monkeypatch, block, held):
    """Prolific users over several cells, sums let go early, text order of whole-number items, repeated ratings."""
    monkeypatch.setattr(related, "BLOCK", block)
    monkeypatch.setattr(related, "HELD_PAIRS", held)
    rnd = random.Random(7)
    data = [(rnd.randrange(8), rnd.choice([2, 10, 9, 100, 33, 4]), rnd.randrange(1, 9)) for _ in range(90)]
    want = defaultdict(lambda: [0] * 6)
    for u in range(8):
        own = sorted(((str(i), r) for k, i, r in data if k == u))
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                (x, v), (y, w) = own[a], own[b]
                for k, add in enumerate((1, v * v, v, v * w, w, w * w)):
                    want[x, y][k] += add
    got = related.pair_sums(frame(spark, data, "user bigint, item bigint, rating bigint"))
    assert {(r.item_x, r.item_y): [r.n, r.sxx, r.sx, r.sxy, r.sy, r.syy] for r in got.collect()} == dict(want)
    assert related.pair_sums(frame(spark, [], "user bigint, item bigint, rating bigint")).count() == 0


def test_postings_and_related(spark):
    data = [("17", "70", 3), ("35", "21", 1), ("49", "19", 2), ("49", "21", 1), ("49", "70", 4), ("87", "19", 1), ("87", "21", 2), ("98", "19", 2)]
    df = frame(spark, data, "user string, item string, rating bigint")
    halves = related.user_postings(df, block=2).where("user = '49'").collect()
    assert {(r.n, r.total) for r in halves} == {(3, 7)} and sorted(p.item for r in halves for p in r.postings) == ["19", "21", "70"]
    got = {r.user: (r.n, r.total, [tuple(p) for p in r.postings]) for r in related.user_postings(df).collect()}
    assert got["49"] == (3, 7, [("19", 2), ("21", 1), ("70", 4)]) and got["87"] == (2, 3, [("19", 1), ("21", 2)])
    sums = {(r.item_x, r.item_y): r.n for r in related.pair_sums(df).collect()}
    assert sums == {("19", "21"): 2, ("19", "70"): 1, ("21", "70"): 1}
    twice = related.pair_sums(frame(spark, [("u", "a", 1), ("u", "a", 2), ("u", "b", 3)], "user string, item string, rating bigint"))
    assert {(r.item_x, r.item_y): r.n for r in twice.collect()} == {("a", "a"): 1, ("a", "b"): 2}
    pairs = frame(spark, [("a", "b", 0.5, 9), ("a", "c", 0.5, 9), ("a", "d", 0.9, 2), ("b", "c", 0.1, 9)], "item_x string, item_y string, sim double, n bigint")
    names = frame(spark, [("a", "Ann")], "item string, name string")
    out = [tuple(r) for r in related.related_items(pairs, names, min_coratings=5, k=1).orderBy("item_x", F.desc("sim")).collect()]
    assert out == [("a", "a", 1.0, 0, "Ann"), ("a", "b", 0.5, 9, None), ("b", "b", 1.0, 0, None), ("b", "a", 0.5, 9, "Ann"), ("c", "c", 1.0, 0, None), ("c", "a", 0.5, 9, "Ann")]


def strand(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def align_by_hand(refs, reads, k):
    out = set()
    for q, read in reads:
        for rc in (False, True):
            s = strand(read) if rc else read
            for r, ref in refs:
                for at in range(len(ref) - len(s) + 1):
                    d = sum(a != b for a, b in zip(ref[at : at + len(s)], s))
                    if d <= k:
                        out.add((q, r, at, at + len(s), d, rc))
    return out


@pytest.mark.parametrize("redundancy", [1, 3])
def test_align_brute_force(spark, redundancy):
    rnd = random.Random(4)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    refs = [(1, dna(200)), (2, "A" * 40 + dna(60)), (3, dna(10))]
    reads = []
    for q in range(40):
        r = refs[q % 2][1]
        at = rnd.randrange(len(r) - 12)
        s = list(r[at : at + 12])
        for _ in range(rnd.randrange(4)):
            s[rnd.randrange(12)] = rnd.choice("ACGT")
        reads.append((q, "".join(s) if q % 3 else strand("".join(s))))
    found = alignment.align(frame(spark, refs, "ref_id bigint, seq string"), frame(spark, reads, "read_id bigint, seq string"), k=2, read_len=12, redundancy=redundancy)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == align_by_hand(refs, reads, 2)
    cut = alignment.align(frame(spark, refs, "ref_id bigint, seq string"), frame(spark, reads, "read_id bigint, seq string"), k=2, read_len=12, redundancy=redundancy, chunk=7)
    assert rows(cut) == sorted(got, key=repr)
    best = defaultdict(list)
    for x in sorted(got, key=lambda x: x[4]):
        best[x[0]].append(x)
    want = sorted(v[0] for v in best.values() if len(v) == 1 or v[1][4] > v[0][4])
    assert rows(alignment.unique_best(found)) == sorted(want, key=repr)
    stats = alignment.alignment_stats(found).first()
    assert (stats.n_alignments, stats.n_reverse, stats.n_reads) == (len(got), sum(x[5] for x in got), len(best))


def test_align_difference_finds_gaps(spark):
    ref = "GATTACACCGTTAGGCATCGATCGGCTAAGCT"
    reads = [(1, ref[5:11] + ref[12:18]), (2, ref[5:11] + "T" + ref[11:16]), (3, ref[5:17])]
    got = alignment.align(frame(spark, [(1, ref)], "ref_id bigint, seq string"), frame(spark, reads, "read_id bigint, seq string"), k=1, read_len=12, mode="difference")
    best = {r.read_id: r.differences for r in got.orderBy(F.desc("differences")).collect()}
    assert best == {1: 1, 2: 1, 3: 0}
    cut = alignment.align(frame(spark, [(1, ref)], "ref_id bigint, seq string"), frame(spark, reads, "read_id bigint, seq string"), k=1, read_len=12, mode="difference", chunk=4)
    assert rows(cut) == rows(got)
    pictures = alignment.alignment_pictures(got.where("read_id = 3 and differences = 0"), frame(spark, [(1, ref)], "ref_id bigint, seq string"), frame(spark, reads, "read_id bigint, seq string"), chunk=12)
    assert [r.picture for r in pictures.collect()] == [f"{ref[5:17]}\n{'|' * 12}\n{ref[5:17]}"]
    assert rows(alignment.alignment_text(got.where("read_id = 3 and differences = 0"))) == [("1\t5\t17\t3\t0\t+",)]


def test_align_with_unknown_bases_and_varied_lengths(spark):
    """N equals N in flanks and never seeds; reads of several lengths; empty and null sequences."""
    ref = "ACGTTGCAAGNNCTTACGGATCCATGCA"
    refs = frame(spark, [(1, ref), (2, ""), (3, None)], "ref_id bigint, seq string")
    reads = frame(spark, [(1, ref[2:12]), (2, ref[8:20]), (3, ref[14:25]), (4, ref[2:12].replace("N", "A")), (5, None), (None, ref[2:12])], "read_id bigint, seq string").withColumns({c: F.lit("clash") for c in ("h", "salt", "chunk", "offset", "i", "s")})
    refs = refs.unionByName(frame(spark, [(None, ref)], "ref_id bigint, seq string")).withColumns({c: F.lit("clash") for c in ("h", "chunk", "offset", "at")})
    got = alignment.align(refs, reads, k=2, min_len=10, max_len=12)
    assert {(r.read_id, r.ref_start, r.ref_end, r.differences) for r in got.collect() if not r.is_rc} == {(1, 2, 12, 0), (2, 8, 20, 0), (3, 14, 25, 0), (4, 2, 12, 2)}
    assert alignment.align(refs.limit(0), reads, k=2, min_len=10, max_len=12).count() == 0
    assert alignment.align(refs, reads.limit(0), k=2, min_len=10, max_len=12).count() == 0


def test_align_rejects_lengths(spark):
    refs = frame(spark, [(1, "ACGTACGTACGT")], "ref_id bigint, seq string")
    with pytest.raises(Exception, match="read length must be"):
        alignment.align(refs, frame(spark, [(1, "ACG")], "read_id bigint, seq string"), k=1, read_len=4).collect()
    ns = alignment.align(refs, frame(spark, [(1, "NNNN"), (2, None)], "read_id bigint, seq string"), k=1, read_len=4)
    assert ns.count() == 0


def test_kmers(spark):
    seqs = frame(spark, [(1, "ACGTAC"), (2, "AC"), (3, ""), (4, None)], "seq_id bigint, seq string")
    assert rows(alignment.kmer_count(seqs, 2)) == [("AC", 3), ("CG", 1), ("GT", 1), ("TA", 1)]
    places = lambda chunk: sorted((r.seq_id, r.chunk, r.positions) for r in alignment.kmer_places(seqs, 2, chunk).where("kmer = 'AC'").collect())
    assert places(100) == [(1, 0, [0, 4]), (2, 0, [0])] and places(3) == [(1, 0, [0]), (1, 1, [4]), (2, 0, [0])]
    assert rows(alignment.kmer_distinct(alignment.kmer_count(seqs, 2))) == [(4, 6)]
    text = "".join(random.Random(6).choice("ACGT") for _ in range(500))
    one = frame(spark, [(7, text)], "seq_id bigint, seq string")
    assert rows(alignment.kmers(one, 5, chunk=16)) == sorted(((7, text[i : i + 5], i) for i in range(496)), key=repr)
    assert rows(alignment.length_range(seqs)) == [(0, 6)]


def test_keyed(spark):
    counts = frame(spark, [("a", 3), ("b", 1)], "id string, count bigint")
    names = frame(spark, [("a", "z"), ("a", "y"), ("c", "n")], "id string, name string")
    assert rows(keyed.kv_merge(counts, names)) == [("a", 3, "y"), ("b", 1, "empty"), ("c", None, "n")]
    lines = frame(spark, [("Name\t/guid/1",), ("only",), ("x\tnone",), (None,)], "line string")
    assert rows(keyed.names_of(lines)) == [("/guid/1", "Name")]
    doc = '{"id":"o","hash":"h","interactions":[{"interaction":{"id":"1","created_at":"Thu, 09 Aug 2012 19:21:17 +0000","content":"a\\n\\"b\\"\\t","author":{"name":"n"}}},{"interaction":{"id":"2"}}]}'
    flat = keyed.interactions(frame(spark, [(doc,), ("{broken",), ('{"interactions":[]}',), (None,)], "json string"))
    assert rows(keyed.posts_per_day(flat)) == [("09 Aug 2012", 1)]
    assert flat.where("interaction_id = '1'").first()["interaction_content"] == 'a\n"b"\t'
    assert '"interaction_content":"a\\n\\"b\\"\\t"' in keyed.as_json(flat).where("key_date is not null").first()["json"]
