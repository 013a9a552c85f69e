"""Byte-stable artifacts: small ones written on the driver, large ones as sorted parts that are joined byte by byte."""

from __future__ import annotations

import csv
import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import work
from ..operators.load import Refused


def write_rows(path: str, header: list[str], rows: list[list[str]]) -> None:
    """A CSV file that either is there whole or as it was before."""
    part = f"{path}.part"
    with open(part, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(header)
        w.writerows(rows)
    os.replace(part, path)


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """A table of any size as one CSV file, sorted by ``order`` and then by all columns, with its header.

    Spark writes range-sorted parts; their bytes are copied one after another into a file beside the
    target, which then takes its place.  Rows never reach the driver, equal tables give equal bytes.
    """
    spark = df.sparkSession
    keys = [*order, *[c for c in df.columns if c not in order]]
    text = df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    parts = work.new_path(spark, "sorted")
    options = {"header": False, "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    text.write.options(**options).csv(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    source, target, aside = hadoop(parts), hadoop(path), hadoop(f"{path}.part")
    system, to = source.getFileSystem(conf), target.getFileSystem(conf)
    to.setWriteChecksum(False)  # a checksum file beside it would outlive a later change by other means
    out = to.create(aside, True)
    try:
        out.write(bytearray((",".join(df.columns) + "\n").encode()))
        for name in sorted(f.getPath().getName() for f in system.listStatus(source)):
            if name.startswith("part-"):
                stream = system.open(hadoop(source, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                finally:
                    stream.close()
    finally:
        out.close()
        to.setWriteChecksum(True)
    to.delete(target, False)
    to.rename(aside, target)
    system.delete(source, True)


def write_fit(path: str, fit: dict, deciles: list) -> None:
    """The fit artifact: fixed decimals, names in a fixed order."""
    rows = [["mu", f"{fit['mu']:.6f}"], ["sigma", f"{fit['sigma']:.6f}"], ["n", str(int(fit["n"]))], ["emp_mean", f"{fit['emp_mean']:.6f}"]]
    for d in sorted(deciles, key=lambda d: d["pct"]):
        rows += [[f"{side}_p{d['pct']}", f"{d[side]:.4f}"] for side in ("emp", "fit")]
    write_rows(path, ["name", "value"], rows)


def write_fee_split(path: str, rows: list) -> None:
    """The fee split artifact: whole euros and shares of six places, the overall row last."""
    out = []
    for r in sorted(rows, key=lambda r: (r["family"] == "overall", r["family"])):
        extra, tariff = int(r["extra"]), int(r["tariff"])
        if extra + tariff == 0:
            raise Refused(f"{r['family']}: billed nothing")
        out += [[f"{r['family']}_extra", str(extra)], [f"{r['family']}_tariff", str(tariff)], [f"{r['family']}_share", f"{extra / (extra + tariff):.6f}"]]
    write_rows(path, ["name", "value"], out)


def merged_series(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows, with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def record_series(path: str, old: DataFrame, new: DataFrame, keys: list[str]) -> int:
    """Rewrite a series sorted by its keys and return how many keys are new; nothing new leaves the same bytes.

    ``old`` must not read the file itself: the readers of ``files`` give work tables.
    """
    fresh = new.join(old.select(*keys), keys, "left_anti").count()
    write_sorted(merged_series(old, new, keys), path, keys)
    return fresh


def write_decisions(path: str, decisions: DataFrame) -> None:
    """The decision cache, sorted, one row for each decision."""
    columns = ["review_id", "prompt_version", "model", "theme"]
    write_sorted(decisions.select(*columns).distinct(), path, columns)


def write_fixture(folder: str, files: dict[str, tuple[list[str], list[list[str]]]]) -> None:
    """Small frozen files with a manifest of their SHA-256 digests."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, (header, rows) in files.items():
        write_rows(f"{folder}/{name}", header, rows)
    digests = [[n, hashlib.sha256(Path(folder, n).read_bytes()).hexdigest()] for n in sorted(files)]
    write_rows(f"{folder}/MANIFEST.csv", ["file", "sha256"], digests)


def check_fixture(folder: str) -> None:
    """Refuse a fixture whose files are not those of its manifest."""
    with open(f"{folder}/MANIFEST.csv", newline="", encoding="utf-8") as f:
        for row in csv.DictReader(f):
            if hashlib.sha256(Path(folder, row["file"]).read_bytes()).hexdigest() != row["sha256"]:
                raise Refused(f"{row['file']} is not the file of the manifest")


def closed_families(split: DataFrame, families: list[str]) -> DataFrame:
    """The fee split of exactly the declared families: a missing, repeated or unknown one, or one that billed nothing, is refused."""
    found = [r.family for r in split.where("family <> 'overall'").select("family").limit(len(families) + 1).collect()]
    if sorted(found) != sorted(families):
        raise Refused(f"families {sorted(found)}, declared {sorted(families)}")
    if row := split.where("extra + tariff = 0").first():
        raise Refused(f"{row.family}: billed nothing")
    rates = split.where("family <> 'overall'").agg(F.min("share").alias("lowest"), F.max("share").alias("highest"))
    return split.crossJoin(F.broadcast(rates))  # one row of bounds


def with_segment(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """Reviews with the segment of their platform; an unknown platform, and one under two segments, is refused."""
    known = sources.select(F.col("platform").alias("source"), "segment").distinct()
    if row := known.groupBy("source").count().where("count > 1").first():
        raise Refused(f"{row.source}: two segments")
    side = work.sized(known, 200)
    if row := reviews.join(side, "source", "left_anti").select("source").first():
        raise Refused(f"{row.source}: not a declared platform")
    return reviews.join(side, "source")
