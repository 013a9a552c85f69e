"""Command line; a declared refusal is one line and exit code 2."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify as K
from .operators import fit as fitting
from .operators.commits import Store
from .operators.load import Refused
from .plans import build, serve, warehouse
from .plans import cost_model as M
from .sources import artifacts, files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="provmart")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **defaults: str):
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for a, value in defaults.items():
            p.add_argument(f"--{a}", default=value)

    add("rebuild", "project", "store", run="run-1", stage="classify")
    add("idempotency-check", "project", "store")
    add("reset", "store", confirm="")
    add("label-sample", "store", "n", "out")
    add("classify-eval", "store", "labels")
    add("fit-amounts", "path", "scratch", "out")
    add("sample-amounts", "path", "n", "out")
    add("slice-fees", "path", "family", "tariff", "extra", "codes", "out")
    add("split-fees", "path", "family", "tariff", "extra", "out", families="")
    add("record-snapshots", "old", "new")
    add("model")
    add("simulate")
    add("report", "store", "out", run="run-1")
    add("export", "store", "out")
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """One command; prints small tables only."""
    match a.command:
        case "rebuild":
            for name, n in build.rebuild(spark, a.project, a.store, a.run, a.stage).items():
                print(f"{name}\t{n}")
        case "idempotency-check":
            print(f"{len(build.idempotency_check(spark, a.project, a.store))} tables, the same rows twice")
        case "reset":
            if a.confirm != Path(a.store).name:
                raise Refused(f"--confirm {Path(a.store).name} deletes {a.store}")
            print("deleted" if warehouse.drop(spark, a.store) else "nothing there")
        case "label-sample":
            if not a.n.isdigit() or not 1 <= int(a.n) <= 10_000:
                raise Refused(f"n {a.n!r}: 1 to 10000")
            ids = Store(spark, a.store).read("stg_classified_reviews").select("review_id").distinct()
            rows = ids.orderBy(F.sha2("review_id", 256), "review_id").limit(int(a.n)).collect()
            artifacts.write_rows(a.out, ["review_id", "label"], [[r.review_id, ""] for r in rows])
        case "classify-eval":
            keep = T.review_fold(F.col("review_id")) != 4
            gold = files.read_answer_key(spark, a.labels, build.LABELS).select("review_id", F.col("label").alias("theme"))
            found = Store(spark, a.store).read("stg_classified_reviews")
            K.grades(found.where(keep), gold.where(keep), list(build.LABELS), ["review_id"]).select("label", "predicted", "correct", "precision").orderBy("label").show(truncate=False)
            share = K.decided_share(found.where(keep), "review_id").first()
            print(f"{share.decided} of {share.texts} texts decided; fold 4 is held out and read by rebuild only")
        case "fit-amounts":
            amounts = files.read_amounts(spark, a.path)
            fit = fitting.lognormal_fit(amounts, "amount").first().asDict()
            if fit["n"] < 2:
                raise Refused(f"{a.path}: {fit['n']} amounts, two are needed")
            artifacts.write_fit(a.out, fit, [r.asDict() for r in fitting.fit_deciles(amounts, "amount").collect()])
        case "sample-amounts":
            if not a.n.isdigit() or not 1 <= int(a.n) <= 1_000_000:
                raise Refused(f"n {a.n!r}: 1 to 1000000")
            rows = files.read_amounts(spark, a.path).withColumn("place", F.struct("file", "at"))
            sample = fitting.systematic_sample(rows, F.lit(True), "place", int(a.n)).select("file", "at", F.format_string("%.2f", "amount").alias("amount"))
            artifacts.write_sorted(sample, a.out, ["file", "at"])
        case "slice-fees":
            codes = a.codes.split(",")
            fees = files.read_fee_table(spark, a.path, (a.family, a.tariff, a.extra)).where(F.col(a.family).isin(*codes))
            files.refuse_where(spark.createDataFrame([(c,) for c in codes], "code string").join(fees.select(F.col(a.family).alias("code")), "code", "left_anti"), F.lit(True), "a code without rows", "code")
            artifacts.write_sorted(fees, a.out, [a.family, a.tariff, a.extra])
        case "split-fees":
            fees = files.read_fee_table(spark, a.path, (a.family, a.tariff, a.extra))
            fees = fees.select(F.col(a.family).alias("family"), *[T.euro_total(F.col(c)).alias(k) for k, c in (("tariff", a.tariff), ("extra", a.extra))])
            files.refuse_where(fees, F.col("tariff").isNull() | F.col("extra").isNull(), "not whole euros", "family")
            split = fitting.fee_split(fees, "family", "tariff", "extra")
            if a.families:
                split = artifacts.closed_families(split, a.families.split(","))
            artifacts.write_fee_split(a.out, [r.asDict() for r in split.collect()])  # a row a family
        case "record-snapshots":
            old, new = (files.read_csv(spark, p, files.FETCHED) for p in (a.old, a.new))
            print(f"{artifacts.record_series(a.old, old, new, ['source', 'captured_at'])} new")
        case "model":
            M.cost_outputs(spark).orderBy("scenario", "name").show(100, truncate=False)
        case "simulate":
            M.hold_summary(M.guardrail_sim(spark)).orderBy("scenario").show(truncate=False)
        case "report":
            Path(a.out).write_text(build.report(spark, a.store, {a.run: "counted"}), encoding="utf-8")
        case "export":
            marts = {n: Store(spark, a.store).read(n) for n in ("review_drill", "theme_share_by_month", "theme_share_by_segment")}
            serve.export_sqlite(marts, a.out, {"title", "body", "text"})


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("provmart").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a)
    except Refused as refusal:
        print(f"refused: {refusal}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
