"""Sources, sinks, streams and the command line, on small files."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from quern import cli, schemas
from quern.sinks.kv import FolderStore, KVSink, ParquetStore, Retry
from quern.sinks import tables
from quern.sinks.tables import export_delimited, overwrite_partitions, write_report
from quern.sources import files
from quern.streaming import volumes
from tests.conftest import rows

CDN = "2009-02-01\t01:07:31\tFRA2\t2048\t192.0.2.10\tGET\td1.example.net\t/img/a.png\t200\t-\tMozilla/5.0"


def test_cdn_date_range_skips_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("X.2009-02-01-01.aa.gz", "#Version\n" + CDN + "\n"), ("sub/X.2009-02-01-02.bb.gz", CDN.replace("01:07", "02:07"))):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    (tmp_path / "X.2009-02-01-05.cc.gz").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "other.txt").write_text("nothing")
    read = lambda a, b: files.read_cdn_logs(spark, str(tmp_path), a, b).count()
    assert read("2009-02-01-01", "2009-02-01-02") == 2
    assert read("2009-02-01-02", "2009-02-01-04") == 1
    with pytest.raises(FileNotFoundError):
        read("2009-03-01-00", "2009-03-02-00")


def test_ratings_titles_fasta(spark, tmp_path):
    (tmp_path / "mv1.txt").write_text("1:\n1488844,3,2005-09-06\n822109,5,2005-05-13\n")
    assert rows(files.read_rating_files(spark, str(tmp_path / "mv1.txt"))) == [("1488844", "1", 3), ("822109", "1", 5)]
    lines = spark.createDataFrame([("7,2001,One, Two",), ("bad",)], "line string")
    assert rows(files.parse_titles(lines)) == [("7", "One, Two")]
    assert rows(files.parse_ratings(spark.createDataFrame([("2  1\t5",), ("x",), ("1 2 y",)], "line string"))) == [("2", "1", 5)]
    (tmp_path / "a.fa").write_text(">one x\nACgt\nNNAx\n\n>two\n\n>three\nGG")
    assert rows(files.read_fasta(spark, str(tmp_path / "a.fa"))) == [(1, "one x", "ACGTNNAN"), (2, "two", ""), (3, "three", "GG")]
    assert rows(files.read_headers(spark, str(tmp_path / "a.fa"))) == [(1, "one x"), (2, "two"), (3, "three")]


@pytest.mark.parametrize("block", [37, 400, 1 << 20])
def test_sequences_in_chunks(spark, tmp_path, monkeypatch, block):
    """Records that run over many blocks of two files, in chunks on a grid of their own."""
    import random

    rnd = random.Random(5)
    monkeypatch.setattr(files, "PIECE_BASES", 50)  # taken when the plan is made
    sizes = [0, 1, 100, 739, 16, 300, 0, 17]
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in sizes]
    for f, part in (("a.fa", range(5)), ("b.fa", range(5, 8))):
        with open(tmp_path / f, "w") as out:
            out.write("ACGT\n" * (f == "b.fa"))  # bases without a header
            for i in part:
                out.write(f">seq {i}\n" + "".join(seqs[i][k : k + 23] + "\n" for k in range(0, sizes[i], 23)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        whole = {r.seq_id: (r.header, r.seq) for r in files.read_fasta(spark, str(tmp_path)).collect()}
        assert whole == {i + 1: (f"seq {i}", x) for i, x in enumerate(seqs)}
        got = rows(files.read_sequences(spark, str(tmp_path), chunk=16, overlap=5))
        want = [(i + 1, k, 16 * k, 16 * (k + 1) >= len(x), x[16 * k : 16 * k + 21]) for i, x in enumerate(seqs) for k in range(max(1, -(-len(x) // 16)))]
        assert got == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_registered_partitions(spark, tmp_path):
    for k in ("a", "b"):
        spark.createDataFrame([(1,), (2,)], "n int").write.parquet(str(tmp_path / "t" / f"k={k}"))
    schema = spark.createDataFrame([], "n int, k string").schema
    read = lambda: files.register_partitions(spark, "registered", str(tmp_path / "t"), schema, "k")
    assert read().count() == 4
    spark.createDataFrame([(3,)], "n int").write.parquet(str(tmp_path / "t" / "k=c"))
    spark.createDataFrame([(4,)], "n int").write.parquet(str(tmp_path / "elsewhere"))
    assert rows(read().where("k = 'c'")) == [(3, "c")]
    files.add_partition(spark, "registered", str(tmp_path / "elsewhere"), k="d")
    assert rows(spark.table("registered").where("k = 'd'")) == [(4, "d")]
    assert rows(files.partitions(spark, "registered")) == [("k=a",), ("k=b",), ("k=c",), ("k=d",)]
    spark.sql("DROP TABLE registered")


def test_scratch_scope(spark):
    from quern.scratch import Scratch, scope

    with scope():
        kept = Scratch(spark).write(spark.range(3), "t")
        assert kept.count() == 3
        root = kept.inputFiles()[0].rsplit("/", 2)[0][7:]
        assert os.path.isdir(root)
    assert not os.path.exists(root)


def test_json_tables_and_documents(spark, tmp_path):
    part = tmp_path / "imp" / "dt=2009-04-13-08-05"
    part.mkdir(parents=True)
    (part / "a.json").write_text(json.dumps({"impressionId": "i1", "adId": "a", "more": 1}) + "\n")
    got = files.read_json_table(spark, str(tmp_path / "imp"), schemas.IMPRESSION).select("impressionId", "dt", "ip").collect()
    assert [tuple(r) for r in got] == [("i1", "2009-04-13-08-05", None)]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text('{"id":"o",\n "hash":"h", "interactions":[]}')
    (docs / "b.json").write_text("{broken")
    assert files.read_activity(spark, str(docs)).count() == 1
    (tmp_path / "wiki.txt").write_text("en Main 5 100\nen Other x 7\n")
    assert rows(files.read_table(spark, str(tmp_path / "wiki.txt"))) == [("en", "Main", 5, 100), ("en", "Other", None, 7)]


def test_report_and_partition_sinks(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("", None)], "k string, n int")
    path = write_report(df, str(tmp_path), "top", [F.desc_nulls_last("n")])
    assert open(path).read() == "a\t2\nb\t1\n\t\n"
    many = write_report(spark.range(1000, numPartitions=9), str(tmp_path), "many", ["id"])
    assert open(many).read().split() == [str(k) for k in range(1000)]
    monkeypatch.setattr(tables, "ONE_FILE_BYTES", 10)
    parts = write_report(spark.range(1000, numPartitions=9), str(tmp_path), "many")
    assert os.path.isdir(parts) and spark.read.text(parts).count() == 1000
    write_report(df.limit(0), str(tmp_path), "top")
    assert open(path).read() == ""
    day = lambda d, n: spark.createDataFrame([(d, "00", n)], "day string, hour string, n int")
    out = str(tmp_path / "parts")
    for d, n in (("d1", 1), ("d2", 2), ("d1", 3)):
        overwrite_partitions(day(d, n), out, "day", "hour")
    assert sorted((r.day, r.n) for r in spark.read.parquet(out).collect()) == [("d1", 3), ("d2", 2)]
    export_delimited(day("d1", 4), str(tmp_path / "tsv"), "day")
    assert rows(spark.read.csv(str(tmp_path / "tsv"), sep="\t"))[0][:2] == ("00", "4")


class Flaky:
    """Fails twice for each call number, then keeps what it got in files."""

    def __init__(self, path):
        self.path, self.calls = path, 0

    def put(self, domain, items, replace):
        import os
        import uuid

        self.calls += 1
        if self.calls % 3:
            raise OSError("try again")
        os.makedirs(f"{self.path}/{domain}", exist_ok=True)
        with open(f"{self.path}/{domain}/{uuid.uuid4().hex}", "w") as f:
            json.dump(items, f)


def no_sleep(seconds):
    return None


def test_kv_sink_retries_and_batches(spark, tmp_path):
    df = spark.range(45).select(F.lit("d").alias("date"), F.col("id").alias("host"), (F.col("id") * 2).alias("v"), F.lit("").alias("blank")).coalesce(1)
    KVSink(Flaky(str(tmp_path)), "dom", ("date", "host"), prefix="m-", retry=Retry(times=2, sleep=no_sleep)).write(df)
    got = [json.loads(p.read_text()) for p in (tmp_path / "dom").iterdir()]
    assert sorted(map(len, got)) == [5, 20, 20]
    assert dict(tuple(x) if isinstance(x, tuple) else (x[0], x[1]) for b in got for x in b)["m-d:7"] == {"v": ["14"]}
    with pytest.raises(Exception, match="try again"):
        KVSink(Flaky(str(tmp_path)), "dom", ("host",), retry=Retry(times=1, sleep=no_sleep)).write(df)


def test_folder_store(spark, tmp_path):
    store = FolderStore(f"file://{tmp_path}")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string, w string")
    KVSink(store, "d", ("k",)).write(frame([("a", "1", "x"), ("b", "1", None)]))
    KVSink(store, "d", ("k",), mode="append").write(frame([("a", "0", ""), ("b", "2", None)]))
    KVSink(store, "d", ("k",)).write(frame([("b", "9", None)]))
    KVSink(store, "d", ("k",), mode="append").write(frame([("b", "8", "y")]))
    assert rows(store.items(spark, "d")) == [("a", "v", ["0", "1"]), ("a", "w", ["x"]), ("b", "v", ["8", "9"]), ("b", "w", ["y"])]


def test_parquet_store_upserts(spark, tmp_path):
    store = ParquetStore(str(tmp_path))
    put = lambda data, schema, **kw: store.upsert(spark.createDataFrame(data, schema), "d", "id", **kw)
    put([("a", "3", "empty")], "id string, Count string, Name string")
    put([("a", "Ann"), ("b", "Bob")], "id string, Name string")
    items = lambda: {r.name: r.attributes for r in store.items(spark, "d").collect()}
    assert items() == {"a": {"Count": ["3"], "Name": ["Ann"]}, "b": {"Name": ["Bob"]}}
    (tmp_path / "d" / "v000000099").mkdir()  # what a failed upsert leaves
    put([("b", "Bo")], "id string, Name string", replace=False)
    assert items()["b"] == {"Name": ["Bo", "Bob"]}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 10), ("b", 299), ("c", 300)], "id string, s bigint").select("id", F.timestamp_seconds("s").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("id string, ts timestamp").parquet(src)
    volumes.drain(volumes.volume_stream(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(str(r.bucket), r.n) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("bucket").collect()] == [("1970-01-01 00:00:00", 2), ("1970-01-01 00:05:00", 1)]
    late = spark.createDataFrame([("z", 10**6)], "id string, s bigint").select("id", F.timestamp_seconds("s").alias("ts"))
    hits = str(tmp_path / "hits")
    spark.createDataFrame([("a", 60), ("b", 9000)], "id string, s bigint").select("id", F.timestamp_seconds("s").alias("ts")).unionByName(late).write.parquet(hits)
    late.write.mode("append").parquet(src)
    seen = spark.readStream.schema("id string, ts timestamp").parquet(src).select("id", F.col("ts").alias("seen_at"))
    clicks = spark.readStream.schema("id string, ts timestamp").parquet(hits).select("id", F.col("ts").alias("clicked_at"))
    volumes.drain(volumes.click_stream(seen, clicks), str(tmp_path / "joined"), str(tmp_path / "ck2"), "append")
    got = {r.id: r.clicked for r in spark.read.parquet(str(tmp_path / "joined")).collect()}
    assert got["a"] is True and got["b"] is False and got["c"] is False


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "X.2009-02-01-01.a.txt").write_text(CDN + "\n")
    cli.main(["cdn-reports", str(tmp_path / "in"), str(tmp_path / "out"), "--start", "2009-02-01-00", "--end", "2009-02-01-03", "--client-ip"])
    names = sorted(p.name for p in (tmp_path / "out").glob("*.txt"))
    assert names == [f"client-ip-{m}_2009-02-01-00_2009-02-01-03.txt" for m in ("bytes-transferred", "request-count-by-httpresponse", "request-count")]
    cli.main(["wait-for", "2000-01-01 00:00:00"])
    ref = "GATTACACCGTTAGGCATCGATCGGCTAAGCTTTGACCA"
    (tmp_path / "refs.fa").write_text(f">r\n{ref[:20]}\n{ref[20:]}\n")
    (tmp_path / "reads.fa").write_text(f">a\n{ref[4:16]}\n>b\n{ref[20:31]}A\n")
    cli.main(["align", str(tmp_path / "refs.fa"), str(tmp_path / "reads.fa"), str(tmp_path / "found"), "--read-len", "12", "--k", "1"])
    assert {(r.read_id, r.ref_id, r.ref_start, r.differences) for r in files.read_alignments(spark, str(tmp_path / "found")).collect() if not r.is_rc} == {(1, 1, 4, 0), (2, 1, 20, int(ref[31] != "A"))}
    (tmp_path / "ratings.txt").write_text("".join(f"u{u} i{i} {1 + (u * i) % 7}\n" for u in range(9) for i in range(3)))
    cli.main(["related-items", str(tmp_path / "ratings.txt"), str(tmp_path / "related"), "--users", "100", "--min", "2", "--k", "1"])
    assert {r[0] for r in rows(spark.read.csv(str(tmp_path / "related"), sep="\t"))} == {"i0", "i1", "i2"}
    (tmp_path / "w.txt").write_text("A b a")
    cli.main(["word-count", str(tmp_path / "w.txt"), str(tmp_path / "words")])
    assert rows(spark.read.csv(str(tmp_path / "words"), sep="\t")) == [("a", "2"), ("b", "1")]
