"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sheetlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is written for.

    Times are zone-free (TIMESTAMP_NTZ) everywhere, so the zone only matters
    for what a user casts by hand. Skewed joins are left to adaptive execution,
    which splits the heavy partitions of either side at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder given to the context counts as well. Only a local session may go
    without either: it gets a temporary folder, because driver and executors are
    then one process on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if current is None:
        current = "file://" + tempfile.mkdtemp(prefix="sheetlake-")
        sc.setCheckpointDir(current)
    return current.rstrip("/")


def qualified_path(spark: SparkSession, path: str) -> str:
    """``path`` with its file system named, so tasks open the same files Spark would."""
    if "://" in path or path.startswith("file:"):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/") + ("//" if default.endswith(":///") else "") + path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sheetlake/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back from there.

    Later steps, and tasks repeated on another executor, all see the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own, wherever it is stored."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder of the library's own, wherever it is stored; nothing happens if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(target)


def drop_scratch(df: DataFrame) -> None:
    """Remove what :func:`checkpointed` stored; only for a table that nothing will read again."""
    path = getattr(df, "scratch", None)
    if path:
        remove_path(df.sparkSession, path)


def other_folders(spark: SparkSession, folder: str, kept: str) -> list[str]:
    """Everything directly below a folder of the library's own but ``kept``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stays = spark._jvm.org.apache.hadoop.fs.Path(kept).getName()
    return [e.getPath().toString() for e in system.listStatus(path) if e.getPath().getName() != stays]


def remove_others(spark: SparkSession, folder: str, kept: str) -> None:
    """Delete everything directly below a folder of the library's own but ``kept``."""
    for other in other_folders(spark, folder, kept):
        remove_path(spark, other)


def create_only(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole if there is none of that name; whether it was written.

    Of several drivers that try at once one succeeds: the text goes to a file of its own,
    which then takes the name by a step that fails where the name is taken.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    write_text(spark, draft.toString(), text)
    try:
        if system.getScheme() == "file":  # a rename there would replace what is already there
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not system.exists(target) and system.rename(draft, target)
    finally:
        system.delete(draft, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in place of any other of that name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the library's own."""
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = system.open(source)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies directly below a folder, by name; nothing if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(e.getPath().getName() for e in system.listStatus(path)) if system.exists(path) else []
