"""Column helpers: golden values, null and no-match cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import dna, ids, logs, similarity, text, times


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema).select(expr.alias("r")).first()["r"]


def test_words_and_tokens(spark):
    t = F.col("t")
    assert one(spark, text.words(t), t=("string", "Ab1 9x, foo-bar")) == ["ab1", "x", "foo", "bar"]
    assert one(spark, text.words(t), t=("string", "")) == []
    assert one(spark, text.words(t), t=("string", None)) is None
    for x in ("Ab1 9x, foo-bar", "", "12", "9a", "a9 9", "é9b1-2c", "  \n", "K\u212aİi", "-a", "x_y1__2z"):
        assert [w.lower() for w in one(spark, text.word_pieces(t), t=("string", x)) if w] == one(spark, text.words(t), t=("string", x)), x
    assert one(spark, text.agent_tokens(t), t=("string", "Mozilla/5.0 (X11; Linux)")) == ["Mozilla", "5.0", "X11", "Linux"]
    assert one(spark, text.list_tokens(t), t=("string", " a,b  c,,\n")) == ["a", "b", "c"]
    assert one(spark, text.extract_or_null(t, "(x+)"), t=("string", "abc")) is None
    assert one(spark, text.full_match(t, "a|b"), t=("string", "ab")) is False
    assert one(spark, text.first_octets(t), t=("string", "10.20.30.40")) == "10.20"
    assert one(spark, text.first_octets(t), t=("string", "::1")) == ""
    assert one(spark, text.day_token(t), t=("string", "Thu, 09 Aug 2012 19:21:17 +0000")) == "09 Aug 2012"


def test_times(spark):
    t = F.col("t")
    assert one(spark, times.ms_to_text(t), t=("string", "1239610346000")) == "2009-04-13 08:12:26"
    assert one(spark, times.ms_to_text(t), t=("string", "12x")) is None
    bucket = times.bucket_name(times.time_bucket(t.cast("timestamp"), 300))
    assert one(spark, bucket, t=("string", "2009-02-01 01:07:31")) == "2009-02-01 01:05:00"
    assert one(spark, bucket, t=("string", "1969-12-31 23:59:59")) == "1969-12-31 23:55:00"
    two = F.array(times.elapsed_seconds(F.lit("1000"), F.lit("3500")), times.elapsed_seconds(F.lit("1000"), F.lit("3500"), parity=True))
    assert one(spark, two) == [2.5, 3499.0]


def test_ids(spark):
    t = F.col("t")
    assert [one(spark, ids.clean_id(t), t=("string", x)) for x in (" \tAb ", "", " ", "-", " - ", None)] == ["ab", None, None, None, None, None]
    assert [one(spark, ids.begin_ms(t), t=("string", x)) for x in (" 1235952145480\t", "123595214548", "123595214548x", None)] == [1235952145480, None, None, None]
    minutes = ids.slot_minutes(ids.slot_number(t))
    assert [one(spark, minutes, t=("string", x)) for x in ("1970-01-01-01-05", "1970-13-01-01-05", "1970-01-01-01", None)] == [65, None, None, None]


def test_access_lines(spark):
    lines = ['10.1.2.3 - - [23/Jan/2009:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326 "http://www.google.com/search?hl=en&q=spark" "Mozilla/4.08"',
             '10.1.2.9 - bob [23/Jan/2009:23:59:59 +0000] "GET /b HTTP/1.1" 304 - "http://www.example.org/x" "curl/7.0"', "this line does not match", None]
    parsed = logs.parse_access(spark.createDataFrame([(x,) for x in lines], "line string"))
    got = parsed.select(times.hour_of_day(F.col("dtime")), "bytes", logs.address_block(F.col("remoteAddr")), logs.referrer_host(F.col("referrer")), logs.search_term(F.col("referrer"))).collect()
    assert tuple(got[0]) == ("20", 2326, "10.1.2.*", "http://www.google.com", "spark")
    assert got[1][1] == 0 and got[1][3] == "http://www.example.org"
    assert tuple(got[2]) == tuple(got[3]) == (None,) * 5


def test_access_line_with_separator_and_tail(spark):
    line = '1.2.3.4 - - [23/Jan/2009:13:55:36 -0700] "GET /\u0001a" 200 5 "" "b" more\nlines'
    r = logs.parse_access(spark.createDataFrame([(line,), (line.replace("\u0001", ""),)], "line string")).collect()
    assert [(x.request, x.referrer, x.browser, x.status) for x in r] == [("GET /\u0001a", "", "b", 200), ("GET /a", "", "b", 200)]


def test_cdn_lines(spark):
    lines = ["#Version: 1.0", "2009-02-01\t01:07:31\tFRA2\t2048\t192.0.2.10\tGET\td1.example.net\t/img/a.png\t200\t-\tMozilla/5.0",
             "2009-02-01\t01:09:59\tFRA2\t100\t192.0.2.10\tGET\td1.example.net\t/img/b.png\t404\t-\tMozilla/5.0 (X)", "", None]
    got = logs.parse_cdn(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.EdgeLocation, r.Bytes, r.HTTPResponse, r.UserAgent, str(r.ts)) for r in got] == [("FRA2", 2048, "200", "Mozilla/5.0", "2009-02-01 01:07:31"), ("FRA2", 100, "404", "Mozilla/5.0 (X)", "2009-02-01 01:09:59")]


@pytest.mark.parametrize(("r", "n", "users", "score"), [(1.0, 4, 100, 0.008319903594), (0.8, 50, 147160, 0.112564949831), (-0.1, 10, 1000, 0.020934181529), (-0.9, 50, 1000, -0.272266325145), (0.1, 10, 1000, 0.0), (0.9, 3, 1000, 0.0)])
def test_similarity_score(spark, r, n, users, score):
    assert one(spark, similarity.similarity_score(F.lit(r), F.lit(n), users)) == pytest.approx(score, abs=1e-11)


def test_similarity_helpers(spark):
    assert [one(spark, similarity.log_scale(F.lit(x))) for x in (1, 2, 3, 20)] == [1, 1, 2, 3]
    assert one(spark, similarity.log_scale(F.lit(0))) is None
    assert one(spark, similarity.sample_probability(10, F.lit(100), F.lit(0))) == pytest.approx(0.1)
    assert one(spark, similarity.sample_probability(10, F.lit(100), F.lit(20))) == pytest.approx(0.5)
    assert one(spark, similarity.pearson(*(F.lit(x) for x in (4, 4, 4, 4, 4, 4)))) == 0.0
    big = 2**40
    assert one(spark, similarity.pearson(*(F.lit(x) for x in (big, 3, big, 3, big, 4)))) == 1.0


GOLDEN = """AACCGATTCC no, ACCCGATTCC no, ACCGATTCCC no, AAACCGATTC no, AACCGATCCC no, AACCGTTCCC no, AACCGATTTC no, ACCCGATCCC yes,
ATCCGATTCA yes, ATCCGATTTC yes, ACCGATACCC yes, ACCGATCCCA yes, ACCGATTTCC yes, TACCGTTCCA yes, AACCGTCCCA no, AACCGCCCAA no"""


@pytest.mark.parametrize("case", [x.strip() for x in GOLDEN.split(",")])
def test_leftmost_seed_golden(case):
    pattern, accepted = case.split()
    _, edits = dna.k_difference("AACCGATTCCCAA", pattern, 3)
    assert dna.script_is_leftmost(edits, len(pattern), 5) == (accepted == "yes")


def edit_distance_to_prefix(ref, read):
    """Fewest edits that turn the read into some beginning of the reference."""
    row = list(range(len(ref) + 1))
    for i, a in enumerate(read, 1):
        after = [i]
        for j, b in enumerate(ref, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (a != b)))
        row = after
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("ACGT", max_size=14), st.text("ACGT", max_size=12), st.integers(0, 4))
def test_k_difference_is_least(ref, read, k):
    got, best = dna.k_difference(ref, read, k), edit_distance_to_prefix(ref, read)
    assert (got is None) == (best > k)
    if got:
        used, edits = got
        assert len(edits) == best
        gaps, extras = sum(k == "gap" for _, k in edits), sum(k == "extra" for _, k in edits)
        assert used == len(read) + gaps - extras


def test_dna_columns(spark):
    s = F.col("s")
    for seq in ("", "A", "AC", "ACG", "ACGT", "ACGTA", "ACGTAN", "ACGTANN", "ACGTANNA"):
        assert one(spark, dna.reverse_complement(dna.reverse_complement(s)), s=("string", seq)) == seq
    assert one(spark, dna.normal_bases(s), s=("string", "acgtnx")) == "ACGTNN"
    rnd = random.Random(1)
    for n in (1, 8, 16, 31):
        seed = "".join(rnd.choice("ACGT") for _ in range(n))
        assert one(spark, dna.unpack_seed(dna.pack_seed(s), n), s=("string", seed)) == seed


@pytest.mark.parametrize("length", [1, 3, 8, 31, 32, 50])
def test_seed_codes(length):
    rnd = random.Random(length)
    text = "".join(rnd.choice("ACGT" * 9 + "N") for _ in range(60)) * 3 + "A" * 60
    code, usable = dna.seed_codes(dna.base_codes(np.frombuffer(text.encode(), dtype=np.uint8)), length)
    seeds = [text[i : i + length] for i in range(len(text) - length + 1)]
    assert usable.tolist() == ["N" not in x for x in seeds]
    of = {}
    for x, c in zip(seeds, code.tolist()):
        if "N" not in x:
            assert of.setdefault(x, c) == c
    assert len(set(of.values())) == len(of)
    assert of["A" * length] == dna.homopolymer_codes(length)[0]
    assert len(dna.seed_codes(np.zeros(2, dtype=np.uint8), 3)[0]) == 0
