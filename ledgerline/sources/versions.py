"""Versioned tables on plain Parquet. New versions are written first; one pointer file for each version number names all of them.

Publishing is compare-and-set: the pointer of the next number is a file that only one writer can create. It needs a file system
that renames without overwriting in one step (HDFS) or makes links (a local or mounted one); object stores that do neither give no
such promise, and need a table format with a catalog instead.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and outlives lost executors."""
    return stage(df, f"{shared_folder(df.sparkSession)}/scratch")


def stage_path(df: DataFrame, path: str) -> str:
    """Writes ``df`` under a new name below ``path``."""
    path = f"{path}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` under a new name below ``path`` and reads it again."""
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, path))


def pointers(spark: SparkSession, base: str) -> DataFrame | None:
    """All that was ever published, one row a version."""
    try:
        return spark.read.schema("number long, name string, paths string").json(f"{base}/_current")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, base: str) -> tuple[int, dict[str, str]]:
    rows = pointers(spark, base)
    row = rows.orderBy(F.desc("number"), "name").first() if rows is not None else None
    return (row["number"], json.loads(row["paths"])) if row else (0, {})


def current(spark: SparkSession, base: str) -> dict[str, str]:
    """The paths of the published versions, by relation; none before the first publishing."""
    return newest(spark, base)[1]


class Outrun(Exception):
    """Another writer published first; nothing of this one is current. Rehearse again on the new versions."""


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with all its content at once, through the Hadoop file system; False, and nothing changed, if it is there.

    The content goes to a draft first (a name that readers pass over), so no reader ever sees a part of it, and a writer that dies
    on the way leaves the name free.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    target.getFileSystem(conf).mkdirs(target.getParent())
    # The file system below a mount table or view, which knows how names are taken.
    folder = target.getFileSystem(conf).resolvePath(target.getParent())
    fs, target, draft = folder.getFileSystem(conf), hadoop.Path(folder, target.getName()), hadoop.Path(folder, f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return fs.rename(draft, target)
        at = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        spark._jvm.java.nio.file.Files.createLink(at(target), at(draft))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)


def publish_paths(spark: SparkSession, paths: dict[str, str], base: str, on: int | None = None) -> dict[str, str]:
    """Makes tables that are written already current, all at once; relations not among them keep their versions.

    ``on`` is the version number that the tables were made from (the newest, if not given). Of all writers that publish on one
    number exactly one wins, whatever their order; the others are told by ``Outrun``, and what the winner published stays.
    """
    number, before = newest(spark, base)
    if on is not None and on != number:
        raise Outrun(base)
    all_ = before | paths
    row = json.dumps({"number": number + 1, "name": uuid.uuid4().hex, "paths": json.dumps(all_)})
    if not create_once(spark, f"{base}/_current/{number + 1:020d}.json", row + "\n"):
        raise Outrun(base)
    return all_


def publish(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Writes ``tables`` and makes them current. Readers see the old or the new state."""
    spark = next(iter(tables.values())).sparkSession
    return publish_paths(spark, {name: stage_path(df, f"{base}/versions/{name}") for name, df in tables.items()}, base)


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(current(spark, base)[name])
