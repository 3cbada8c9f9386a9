"""Tables of submissions in versions (A11): what is validated again is replaced as a whole.

Below a root, `<table>/commit=<token>` holds the rows that one commit wrote, and
`_live/<folder>` says of every submission which commit's rows are its own. A version is
the file `_commits/<number>` that names such a folder. It is made last, and only if no
other has its number, so readers see all of a commit or nothing of it, in every table; a
commit that dies before leaves files that no version names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["entity_id", "submission_id"]
LIVE = "entity_id string, submission_id string, commit string, sealed boolean"


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions that are kept, ascending; none before the first commit."""
    fs, where = _at(spark, f"{root}/_commits")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getLen() > 0)  # an empty file is a commit on its way


def _folder(spark: SparkSession, root: str, number: int) -> str:
    fs, where = _at(spark, f"{root}/_commits/{number:010d}")
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def live(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """entity_id, submission_id, commit, sealed of a version, the last if none is given."""
    kept = versions(spark, root)
    if number is not None and number not in kept:
        raise ValueError(f"no version {number} at {root}")
    if not kept:
        return spark.createDataFrame([], LIVE)
    return spark.read.schema(LIVE).parquet(f"{root}/_live/{_folder(spark, root, number or kept[-1])}")


def _publish(spark: SparkSession, root: str, number: int, folder: str) -> bool:
    """Makes a version; False if another writer has made it."""
    fs, where = _at(spark, f"{root}/_commits/{number:010d}")
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            return False
        raise e
    out.write(bytearray(folder.encode()))
    out.close()
    return True


def _committed(spark: SparkSession, root: str, change) -> int:
    """Publishes change(the live table), again on top of whatever another writer published first."""
    while True:
        base = (versions(spark, root) or [0])[-1]
        folder = f"{base + 1:010d}-{uuid.uuid4().hex[:12]}"
        change(live(spark, root, base or None)).write.parquet(f"{root}/_live/{folder}")
        if _publish(spark, root, base + 1, folder):
            return base + 1


def replace(spark: SparkSession, root: str, submissions: DataFrame, **tables: DataFrame) -> int:
    """Replaces all that the tables hold of submissions (entity_id, submission_id) by the
    given rows, in one commit; returns the version's number.

    A submission without rows in a table has none there afterwards, also in tables that
    aren't given. Rows of submissions that aren't named, or have a null id, are never
    seen. Naming a sealed submission is an error and changes nothing. Repeated names count
    once; no names at all make a version equal to the last.
    """
    token = f"c{uuid.uuid4().hex}"
    named = submissions.select(*KEYS).distinct()
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/commit={token}")

    def change(before: DataFrame) -> DataFrame:
        sealed = before.where("sealed").join(named, KEYS, "left_semi").limit(5).collect()
        if sealed:
            raise ValueError(f"sealed submissions can't be validated again: {', '.join(r.submission_id for r in sealed)}")
        return before.join(named, KEYS, "left_anti").unionByName(named.select(*KEYS, F.lit(token).alias("commit"), F.lit(False).alias("sealed")))

    return _committed(spark, root, change)


def seal(spark: SparkSession, root: str, submissions: DataFrame) -> int:
    """From the new version on, submissions can't be replaced. Unknown ones are ignored."""
    named = submissions.select(*KEYS).distinct().withColumn("now", F.lit(True))
    return _committed(spark, root, lambda before: before.join(named, KEYS, "left").select(*KEYS, "commit", (F.col("sealed") | F.coalesce("now", F.lit(False))).alias("sealed")))


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table's rows in a version, the last if none is given. Give tables that are read
    together one number. Only files of commits that own a submission are opened; their
    names, one a commit, come to the driver."""
    own = live(spark, root, number)
    commits = [r.commit for r in own.select("commit").distinct().collect()]
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.where(F.col("commit").isin(commits)).join(own.select(*KEYS, "commit"), [*KEYS, "commit"], "left_semi").drop("commit")


def vacuum(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Deletes all versions but the last, and the commits in which nothing is live; call
    it while no writer works. Returns the folders that went."""
    kept = versions(spark, root)
    if not kept:
        return []
    last, gone = _folder(spark, root, kept[-1]), []
    commits = {f"commit={r.commit}" for r in live(spark, root).select("commit").distinct().collect()}
    for number in kept[:-1]:
        fs, where = _at(spark, f"{root}/_commits/{number:010d}")
        fs.delete(where, False)
    for folder, stays in [("_live", {last}), *((name, commits) for name in names)]:
        fs, where = _at(spark, f"{root}/{folder}")
        for entry in (fs.listStatus(where) if fs.exists(where) else []):
            if entry.getPath().getName() not in stays:
                fs.delete(entry.getPath(), True)
                gone.append(f"{folder}/{entry.getPath().getName()}")
    return gone
