"""Command line: python -m quern.cli COMMAND ... runs one flow from files to files."""

from __future__ import annotations

import argparse
import datetime as dt
import time

from pyspark.sql import functions as F

from .functions import logs as L
from .operators import ads, alignment, counting, log_reports, related
from .scratch import scope
from .session import get_session
from .sinks.tables import overwrite_partitions, write_report
from .sources import files


def _cdn(a) -> None:
    spark = get_session()
    logs = files.read_cdn_logs(spark, a.input, "1970-01-01-00" if a.start == "any" else a.start, None if a.end == "any" else a.end).cache()
    named = [k for k in log_reports.CDN_REPORTS if getattr(a, k.replace("-", "_"))]
    end = dt.datetime.now(dt.UTC).strftime("%Y-%m-%d-%H") if a.end == "any" else a.end
    for name, frame in log_reports.cdn_reports(logs, None if a.all or not named else named, a.bucket).items():
        write_report(frame, a.output, f"{name}_{a.start}_{end}")


def _access(a) -> None:
    logs = L.parse_access(files.read_lines(get_session(), a.input)).cache()
    for name, frame in log_reports.access_log_reports(logs).items():
        write_report(frame, a.output, name)


def _clicks(a) -> None:
    spark = get_session()
    from .schemas import CLICK, IMPRESSION

    hour = dt.datetime.strptime(f"{a.day}-{a.hour}", "%Y-%m-%d-%H")
    name = lambda minutes: (hour + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%d-%H-%M")
    joined = ads.click_join(files.read_json_table(spark, f"{a.input}/impressions", IMPRESSION), files.read_json_table(spark, f"{a.input}/clicks", CLICK), name(0), name(60), name(60 + a.late))
    overwrite_partitions(joined.withColumns({"day": F.lit(a.day), "hour": F.lit(a.hour)}), f"{a.output}/joined_impressions", "day", "hour")


def _features(a) -> None:
    ads.feature_index(get_session().read.parquet(f"{a.input}/joined_impressions")).write.mode("overwrite").parquet(f"{a.output}/feature_index")


def _related(a) -> None:
    spark = get_session()
    ratings = files.parse_ratings(files.read_lines(spark, a.input))
    names = files.read_lines(spark, a.names).select(F.split("line", "\t")[0].alias("item"), F.get(F.split("line", "\t"), F.lit(1)).alias("name")) if a.names else None
    pairs = related.item_similarity(ratings, scale=a.scale, cutoff=a.cutoff, n_users=a.users)
    related.related_items(pairs, names, min_coratings=a.min, k=a.k).write.mode("overwrite").csv(a.output, sep="\t")


def _align(a) -> None:
    spark = get_session()
    refs = files.read_sequences(spark, a.refs, overlap=a.read_len + 2 * a.k).withColumnRenamed("seq_id", "ref_id").withColumn("seq", F.encode("seq", "UTF-8"))
    reads = files.read_fasta(spark, a.reads).select(F.col("seq_id").alias("read_id"), "seq")
    found = alignment.align_chunks(refs, reads, k=a.k, min_len=a.read_len, max_len=a.read_len, mode="difference" if a.differences else "mismatch", unique=a.unique, redundancy=a.redundancy)
    found.write.mode("overwrite").parquet(a.output)


def _words(a) -> None:
    counting.word_count(files.read_lines(get_session(), a.input), "line").write.mode("overwrite").csv(a.output, sep="\t")


def _wait(a) -> None:
    while dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S") < a.until:
        time.sleep(10)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for x in paths:
            c.add_argument(x)
        return c

    c = command("cdn-reports", _cdn, "input", "output")
    c.add_argument("--start", default="any")
    c.add_argument("--end", default="any")
    c.add_argument("--bucket", type=int, default=300)
    c.add_argument("--all", action="store_true")
    for name in log_reports.CDN_REPORTS:
        c.add_argument(f"--{name}", action="store_true")
    command("access-reports", _access, "input", "output")
    c = command("click-join", _clicks, "input", "output", "day", "hour")
    c.add_argument("--late", type=int, default=20)
    command("feature-index", _features, "input", "output")
    c = command("related-items", _related, "input", "output")
    c.add_argument("--names")
    c.add_argument("--scale", choices=("log", "real"), default="log")
    for name, kind, default in (("cutoff", float, 90), ("users", int, 147160), ("min", int, 5), ("k", int, 25)):
        c.add_argument(f"--{name}", type=kind, default=default)
    c = command("align", _align, "refs", "reads", "output")
    c.add_argument("--read-len", type=int, required=True)
    c.add_argument("--k", type=int, required=True)
    c.add_argument("--redundancy", type=int, default=1)
    c.add_argument("--differences", action="store_true")
    c.add_argument("--unique", action="store_true")
    command("word-count", _words, "input", "output")
    command("wait-for", _wait, "until")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    with scope():
        a.run(a)


if __name__ == "__main__":
    main()
