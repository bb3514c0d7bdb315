"""Commands over session logs and pair files: audit, trim, replay, harvest, hosts, bench, denylist, selftest."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import chunks
from .operators import harvest, policy, retention, sessions
from .sources import sessions as source
from .sources.storage import stored


def _session(args: argparse.Namespace) -> SparkSession:
    spark = SparkSession.builder.appName("logloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rebuilt(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(sessions.blocks(source.session_lines(files)).drop("block"), "blocks")
    return stored(sessions.calls(rows), "calls"), stored(sessions.texts(rows), "texts"), sessions.goals(rows)


def _names(spark: SparkSession, path: str | None) -> list[str]:
    return [r.name for r in source.name_list(spark, path).collect()] if path else []  # a list kept by hand


def _show(rows: DataFrame, most: int = 100) -> None:
    print("\t".join(rows.columns))
    for row in rows.limit(most).collect():
        print("\t".join("" if v is None else str(v) for v in row))


def audit(args: argparse.Namespace) -> int:
    spark = _session(args)
    pairs = stored(spark.read.json(args.pairs), "pairs")
    found, gone, verdict = harvest.audit(pairs, args.samples, _names(spark, args.names))
    _show(found.orderBy("detector"))
    _show(gone.orderBy("reason"))
    return verdict.first().code


def trim(args: argparse.Namespace) -> int:
    spark = _session(args)
    calls, texts, _ = _rebuilt(source.session_files(spark, args.root, args.least_bytes))
    calls = calls.where((F.col("tool") == "Bash") & (F.length("result") >= retention.LONG))
    later = calls.join(texts.withColumnRenamed("text_index", "t"), "session_id").where("t >= text_index").groupBy("session_id", "call_pos").agg(F.concat_ws("\n", F.collect_list("body")).alias("later"))
    outputs = calls.join(later, ["session_id", "call_pos"], "left").select("session_id", "call_pos", "result", retention.referenced(F.col("result"), F.coalesce("later", F.lit(""))).alias("used"))
    if args.used_only:
        outputs = outputs.where(F.size("used") > 0)
    # without a model, chunks score by their share of the output's distinct words
    score = F.transform(chunks(F.col("result")), lambda x: F.size(F.array_distinct(F.split(x, r"\s+"))) / F.greatest(F.lit(1), F.size(F.split(x, r"\s+"))))
    _show(retention.trim_report(retention.first_jobs(outputs, args.limit, "session_id", "call_pos"), score, args.keep))
    return 0


def replay(args: argparse.Namespace) -> int:
    """What would be kept of each session, against dropping all but the newest calls. Scores are a column of a table."""
    spark = _session(args)
    calls, _, _ = _rebuilt(source.session_files(spark, args.root, args.least_bytes))
    scores = spark.read.parquet(args.scores)
    rows = calls.join(scores.select("session_id", "call_pos", "score", "call_score"), ["session_id", "call_pos"], "left")
    action = policy.decide(F.col("score"), F.col("call_score"), F.col("tool"), args.keep)
    rows = rows.withColumn("old", policy.too_old(["call_pos"], "session_id", args.preserve)).withColumn("action", action)
    size = F.length("result")
    _show(rows.groupBy("session_id").agg(F.sum(size).alias("n_chars"), F.sum(policy.retained(F.col("action"), size)).alias("retained"), F.sum(F.when(F.col("old"), 0).otherwise(size)).alias("by_age"), F.avg(((F.col("action") != "keep") == F.col("old")).cast("int")).alias("agreement")).orderBy("session_id"))
    return 0


def harvest_(args: argparse.Namespace) -> int:
    spark = _session(args)
    calls, texts, goals = _rebuilt(source.session_files(spark, args.root, args.least_bytes, args.without))
    rows = stored(harvest.judged(calls, texts, goals, args.key, _names(spark, args.names), args.preserve), "judged")
    source.write_pairs(harvest.pairs(rows, args.key), args.out)
    _show(harvest.counts(rows).orderBy(F.col("n").desc(), "reason", "kind", "label"))
    return 0


def hosts(args: argparse.Namespace) -> int:
    spark = _session(args)
    known = source.name_list(spark, args.names) if args.names else None
    _show(harvest.brands(source.session_files(spark, args.root, args.least_bytes), known, args.most), args.most)
    return 0


def bench(args: argparse.Namespace) -> int:
    """Seconds to rebuild the sessions, n times: least, upper median and most."""
    spark = _session(args)
    seconds = []
    for _ in range(args.n):
        began = time.perf_counter()
        _rebuilt(source.session_files(spark, args.root, args.least_bytes))[0].count()
        seconds.append(time.perf_counter() - began)
    seconds.sort()
    print(f"{seconds[0]:.2f}\t{seconds[len(seconds) // 2]:.2f}\t{seconds[-1]:.2f}")
    return 0


def denylist(args: argparse.Namespace) -> int:
    spark = _session(args)
    _show(source.names_shown(source.name_list(spark, args.names)), 1_000_000)
    return 0


def selftest(args: argparse.Namespace) -> int:
    import pytest

    return int(pytest.main(["-q", args.tests]))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logloom", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, **options) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run, **options)
        return sub

    def tree(sub: argparse.ArgumentParser) -> argparse.ArgumentParser:
        sub.add_argument("root", help="folder of session files")
        sub.add_argument("--least-bytes", type=int, default=source.LEAST_BYTES)
        return sub

    sub = command("audit", audit)
    sub.add_argument("pairs")
    sub.add_argument("--names")
    sub.add_argument("--samples", type=int, default=4)
    sub = tree(command("trim", trim))
    sub.add_argument("--keep", type=float, default=policy.KEEP)
    sub.add_argument("--limit", type=int, default=25)
    sub.add_argument("--used-only", action="store_true")
    sub = tree(command("replay", replay))
    sub.add_argument("--scores", required=True, help="Parquet: session_id, call_pos, score, call_score")
    sub.add_argument("--keep", type=float, default=policy.KEEP)
    sub.add_argument("--preserve", type=int, default=policy.PRESERVE)
    sub = tree(command("harvest", harvest_))
    sub.add_argument("--key", required=True, help="secret for pseudonyms")
    sub.add_argument("--out", required=True)
    sub.add_argument("--names")
    sub.add_argument("--without", help="leave out files whose path has this")
    sub.add_argument("--preserve", type=int, default=policy.PRESERVE)
    sub = tree(command("hosts", hosts))
    sub.add_argument("--names")
    sub.add_argument("--most", type=int, default=100)
    sub = tree(command("bench", bench))
    sub.add_argument("-n", type=int, default=20)
    sub = command("denylist", denylist)
    sub.add_argument("names")
    sub = command("selftest", selftest)
    sub.add_argument("--tests", default="tests")
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
