"""Problems 8, 9 and 10: packing limits, shares and caps, round trips of garbled text."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import mixing, mojibake, packing, tokens
from tests.conftest import rows


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no tokenizer here")
def test_token_counts(spark):
    import base64

    import tiktoken

    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "plain words <|endoftext|>", "head\n\ndiff --git a b\n+x = 1\n", "x" * 50000, "naïve 日本"]
    got = {r.doc_id: (r.n_tokens, r.n_prompt) for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    size = lambda t: len(enc.encode_ordinary(t))
    assert got[0] == got[1] == (0, 0)
    assert got[2] == (size(texts[2]),) * 2
    assert got[3] == (size("head\n\n") + size(texts[3][6:]), size("head\n\n"))
    assert got[4][0] == size(texts[4]) and got[5][0] == size(texts[5])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(1, 100), st.integers(101, 900)), st.floats(0, 1)), min_size=1, max_size=80), st.integers(1, 6), st.sampled_from([0.01, 0.3, 0.8, 1.0]))
def test_fill_obeys_all_limits(sizes, max_segments, loss_share):
    t = np.array([a for a, _ in sizes])
    b = np.array([int(a * x) for a, x in sizes])
    start = np.arange(len(t)) * 10_000
    most = int(loss_share * 100)
    out = packing.fill(t, b, t <= 100, start, 100, max_segments, most)
    bins, where = defaultdict(list), defaultdict(list)
    for row, container, at, n, loss in out:
        bins[container].append((row, n, loss))
        where[row].append((at, n, loss))
    assert set(bins) == set(range(len(bins)))
    for row in range(len(t)):
        at = start[row]
        for a, n, loss in sorted(where[row]):
            assert a == at and n > 0
            assert loss == max(0, min(n, a + n - (start[row] + t[row] - b[row])))
            at += n
        assert at == start[row] + t[row]
        assert t[row] > 100 or len(where[row]) == 1  # only what is too long is cut
    for own in bins.values():
        assert sum(n for _, n, _ in own) <= 100 and len(own) <= max_segments
        assert sum(x for _, _, x in own) <= most or (len(own) == 1 and t[own[0][0]] <= 100)


def test_pack_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    monkeypatch.setattr(packing, "PART_CONTAINERS", 3)
    rnd = random.Random(1)
    counts = [(k, n := rnd.choice([0, 1, 50, 100, 101, 199, 200, rnd.randrange(1, 900)]), rnd.randrange(n + 1)) for k in range(500)]
    df = spark.createDataFrame(counts, "doc_id bigint, n_tokens bigint, n_prompt bigint").withColumns({c: F.lit("clash") for c in ("capacity", "part", "copy", "shard")})
    packed = packing.pack(df, [100, 200], max_segments=8, loss_share=0.9)
    by = defaultdict(list)
    bins = defaultdict(list)
    for r in packed.collect():
        by[r.capacity, r.doc_id].append(r)
        bins[r.capacity, r.container].append(r)
    for cap in (100, 200):
        for k, n, prompt in counts:
            own = sorted(by.get((cap, k), []), key=lambda r: r.start_token)
            assert sum(r.n_tokens for r in own) == n and sum(r.n_loss for r in own) == n - prompt
            assert [r.start_token for r in own] == [sum(x.n_tokens for x in own[:i]) for i in range(len(own))]
            assert n > cap or len(own) <= 1 and all(r.is_whole for r in own)
    singles = 0
    for (cap, _), own in bins.items():
        assert sum(r.n_tokens for r in own) <= cap and len(own) <= 8
        if sum(r.n_loss for r in own) > 0.9 * cap:
            assert len(own) == 1 and own[0].is_whole
            singles += 1
    report = {r.capacity: r for r in packing.fill_report(packed, 8, 0.9).collect()}
    assert sum(r.n_single_over for r in report.values()) == singles > 0
    assert report[100].n_tokens == sum(n for _, n, _ in counts) and report[100].n_containers >= report[100].least_containers
    assert packing.over_limits(packed, 8, 0.9).count() == 0 and packing.over_limits(packed, 8, 0.5).count() > 0
    assert all(r.tokens_once and r.n_docs == sum(n > 0 for _, n, _ in counts) for r in packing.checks(packed, df).collect())
    assert rows(packing.pack(df.repartition(3), [100, 200], max_segments=8, loss_share=0.9)) == rows(packed)
    assert packing.pack(df.limit(0), [100]).count() == 0 and packing.pack(df, []).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [100, 1])


def test_repeated_ids_are_spread_over_shards(spark, monkeypatch):
    """A third of the rows under one id, some under none, a few of them longer than the capacity."""
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    data = [(7, 40, 20)] * 400 + [(None, 30, 30)] * 300 + [(7, 950, 0)] * 5 + [(k + 100, 25, 20) for k in range(500)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, n_prompt bigint")
    packed = packing.pack(df, [100]).collect()
    assert sum(r.n_tokens for r in packed) == sum(n for _, n, _ in data)
    assert Counter(r.doc_id for r in packed if r.is_whole) == Counter(k for k, n, _ in data if n <= 100)
    used = Counter()
    for r in packed:
        used[r.container] += r.n_tokens
    assert max(used.values()) <= 100
    assert max(Counter(r.container >> 32 for r in packed).values()) < 64 * 4


def test_poisson_inversion():
    at = np.arange(mixing.LEVELS)
    for cap in (1, 2, 5):
        for want in (0.01, 0.5 * cap, 0.95 * cap):
            mean = mixing.calibrated(at, np.ones(len(at)), want * len(at), cap)
            expected = sum(1 - s for s in mixing.poisson_steps(mean, cap))  # E min(X, cap)
            assert mixing.copies_at(at, mixing.poisson_steps(mean, cap)).mean() == pytest.approx(want, abs=2 / mixing.LEVELS)
            assert expected == pytest.approx(want, abs=0.01)
    assert mixing.copies_at(at, mixing.poisson_steps(mixing.calibrated(at, np.ones(len(at)), 9e9, 3), 3)).min() == 3


def test_mixture_shares_caps_and_order(spark):
    rnd = random.Random(2)
    docs = [(k, rnd.choice(["big", "big", "big", "small", "rare", None, "other"]), rnd.randrange(0, 400)) for k in range(6000)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumns({c: F.lit("clash") for c in ("seed", "n", "copy", "steps", "k")})
    targets = spark.createDataFrame([(" BIG", 0.4, 1), ("small", 0.3, 3), ("rare", 0.2, 2), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mixture(sized, targets)
    drawn = mixing.draw(sized, plan)
    got = drawn.collect()
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    used = Counter((r.source, r.doc_id) for r in got)
    caps = {"big": 1, "small": 3, "rare": 2}
    assert all(n <= caps[s] for (s, _), n in used.items()) and set(s for s, _ in used) == set(caps)
    shares = {r.source: r for r in mixing.shares_reached(drawn, plan).collect()}
    for s, want in (("big", 0.4), ("small", 0.3), ("rare", 0.2)):
        assert shares[s].actual_share == pytest.approx(want / 0.9, abs=0.005)
        assert shares[s].drawn_tokens == sum(r.n_tokens for r in got if r.source == s)
    assert shares["absent"].actual_share == 0 and shares["absent"].n_docs == 0
    assert rows(mixing.draw(sized.repartition(5), plan)) == rows(drawn)
    empty = mixing.plan_mixture(sized.limit(0), targets)
    assert mixing.draw(sized.limit(0), empty).count() == 0
    assert {r.actual_share for r in mixing.shares_reached(mixing.draw(sized.limit(0), empty), empty).collect()} == {0.0}


SENTENCES = ["Überprüfe große Änderungen für später", "l’accès à la fenêtre déjà fermée", "Исправить обработку ошибок журнала", "Διόρθωση σφαλμάτων ουράς", "キャッシュの上限を確認", "It’s a “temporary” façade — naïve", "źródło wątek błędów ścieżkę"]
GARBLE = {
    "utf8>cp1252": lambda s: s.encode().decode("latin_1").translate({b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 256)}), "utf8>latin1": lambda s: s.encode().decode("latin_1"), "utf8>cp437": lambda s: s.encode().decode("cp437"), "utf8>mac": lambda s: s.encode().decode("mac_roman"),
    "twice": lambda s: s.encode().decode("latin_1").encode().decode("latin_1"), "utf8>cp866": lambda s: s.encode().decode("cp866"), "utf8>koi8": lambda s: s.encode().decode("koi8_r"), "utf8>cp932": lambda s: s.encode().decode("cp932", "replace"),
    "lost": lambda s: s.encode().decode("ascii", "replace"),
}


def corpus(how, n_clean=8):
    docs = [(k * 100 + i, f"commit\n\n    {s}\n") for i, s in enumerate(SENTENCES) for k in range(n_clean)]
    return docs, [(10_000 + i, f"commit\n\n    {GARBLE[how](s)} end\n") for i, s in enumerate(SENTENCES)]


@pytest.mark.parametrize("how", sorted(GARBLE))
def test_garbled_documents_round_trip(spark, how):
    clean, garbled = corpus(how)
    df = spark.createDataFrame([*clean, *garbled, (1, None), (2, ""), (3, "only ascii \\u00e9 &eacute; %C3%A9")], "doc_id bigint, text string").withColumn("unit", F.lit("clash"))
    got = {r.doc_id for r in mojibake.garbled_documents(df).collect()}
    assert got == {k for k, _ in garbled}
    restored = {r.doc_id: r for r in mojibake.restored_documents(df).collect()}
    if how not in ("lost", "utf8>cp932"):
        for i, s in enumerate(SENTENCES):
            assert restored[10_000 + i].restored == f"commit\n\n    {s} end\n" and restored[10_000 + i].n_lost == 0
    else:
        assert all(r.n_replaced > 0 for r in restored.values() if r.n_lost == 0)


def test_eight_bit_pairs_need_a_frequent_original(spark):
    clean, _ = corpus("lost")
    bad = [(20_000, "    Исправить обработку".encode("koi8_r").decode("cp1251")), (20_001, "    Διόρθωση σφαλμάτων".encode("cp1253").decode("cp1252")), (20_002, "    źródło błędów".encode("cp1250").decode("cp1252"))]
    df = spark.createDataFrame([*clean, *bad], "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled_documents(df).collect()} == {k for k, _ in bad}
    assert {r.doc_id: r.restored for r in mojibake.restored_documents(df).collect()}[20_000] == "    Исправить обработку"


def test_eight_bit_copies_count_once(spark):
    clean, _ = corpus("lost")
    clean = [(k, f"{t} {k}") for k, t in clean]
    copies = [(20_000 + i, "    Исправить обработку".encode("koi8_r").decode("cp1251")) for i in range(40)]
    df = spark.createDataFrame([*clean, *copies], "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled_documents(df).collect()} == {k for k, _ in copies}


def test_eight_bit_words_agree(spark):
    said = {1: "    Исправить обработку ошибок", 2: "    źródło wątek błędów", 3: "    Διόρθωση σφαλμάτων ουράς", 4: "    não déjà – 5 ───"}
    bad = {11: said[1].encode("cp1251").decode("koi8_r"), 12: said[2].encode("cp1250").decode("cp1252"), 13: said[3].encode("cp1253").decode("cp1251")}
    df = spark.createDataFrame([*said.items(), *bad.items()], "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled_documents(df).collect()} == set(bad)
    restored = {r.doc_id: r.restored for r in mojibake.restored_documents(df).collect()}
    assert restored == {k: said[k - 10] for k in bad}


def test_garbled_on_purpose(spark):
    clean = [(k, "    año déjà\n    NÃO SÃO Â LA CARTE ├── src") for k in range(9)]
    mend = "diff --git a b\n@@ -1 +1 @@\n-x = 'aÃ±o'\n+x = 'año'\n"
    cases = {100: mend, 101: mend.replace("+x = 'año'", "+x = 'aÃ±o' "), 102: "diff --git a b\n@@ -1 +1 @@\n-x = 'aÃ±o'\n@@ -5 +5 @@\n+x = 'año'\n", 103: mend + "@@ -9 +9 @@\n x = 'dÃ©jÃ '\n", 104: "-x = 'aÃ±o'\n+x = 'año'\n"}
    cases[105] = mend.replace("aÃ±o", "a��o").replace("año", "año # ça")
    clean = [*clean, *((k + 20, "    ça déjà") for k in range(30))]
    df = spark.createDataFrame([*clean, *cases.items()], "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled_documents(df).collect()} == {101, 102, 103, 104}
    kept = {r.doc_id: r.restored for r in mojibake.restored_documents(df).collect()}
    assert kept[103] == mend + "@@ -9 +9 @@\n x = 'déjà'\n"
    assert mojibake.garbled_documents(df.limit(0)).count() == 0
