"""Small files and renames on any file system that Spark knows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the context's checkpoint folder. Where
    neither is set, a session on one machine gets a fresh one; on a cluster that would be a folder of each machine's own."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="yieldloom-")
        path = _own[context.applicationId]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Names in a folder that match a glob pattern, in order; none if there is no such folder."""
    fs, where = _at(spark, f"{folder}/{pattern}")
    return sorted(s.getPath().getName() for s in fs.globStatus(where) or [])


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that match a glob pattern, in order."""
    fs, where = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change in ms) of a folder's data files in order, or of the file itself."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    own = [(s.getPath().getName(), s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where) if s.isFile()]
    return sorted(x[1:] for x in own if not x[0].startswith((".", "_")))


def first(spark: SparkSession, path: str) -> str:
    """The path itself, or the first data file of a folder."""
    fs, where = _at(spark, path)
    if not fs.getFileStatus(where).isDirectory():
        return path
    own = sorted(s.getPath().toString() for s in fs.listStatus(where) if not s.getPath().getName().startswith((".", "_")))
    if not own:
        raise FileNotFoundError(f"no files in {path}")
    return own[0]


def head(spark: SparkSession, path: str, size: int = 1 << 20) -> bytes:
    """The first bytes of a file; no more of it is read."""
    fs, where = _at(spark, path)
    size = min(size, fs.getFileStatus(where).getLen())
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
    finally:
        stream.close()


def whole(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    return head(spark, path, 1 << 30)


def changed(spark: SparkSession, path: str) -> float:
    """When a file or folder, or a file in it, was last changed, in seconds."""
    fs, where = _at(spark, path)
    status = fs.getFileStatus(where)
    times = [status.getModificationTime(), *([s.getModificationTime() for s in fs.listStatus(where)] if status.isDirectory() else [])]
    return max(times) / 1000


def put(spark: SparkSession, path: str, data: bytes, over: bool = False) -> None:
    """Write a small file that doesn't exist yet; over: or in the place of another."""
    if over:
        fs, part = _at(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        put(spark, part.toString(), data)
        _rename_over(spark, part.toString(), path)
        return
    fs, where = _at(spark, path)
    stream = (fs.getRaw() if fs.getScheme() == "file" else fs).create(where, False)  # without a file of checksums beside it
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _rename_over(spark: SparkSession, new: str, old: str) -> None:
    jvm = spark.sparkContext._jvm
    fs, source = _at(spark, new)
    _, target = _at(spark, old)
    if fs.getScheme() == "file":
        local = lambda p: jvm.java.io.File(p.toUri().getPath())
        if not local(source).renameTo(local(target)):
            raise OSError(f"cannot write {old}")
        return
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)


def publish(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file that appears whole or not at all; False if there is one of that name, which then stays as it is."""
    fs, target = _at(spark, path)
    part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    put(spark, part, data)
    _, source = _at(spark, part)
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":  # renaming there would put the new file in the place of an old one
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(source))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)
        return True
    except Exception:
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(source, False)


def _moves(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.moving-{name}.json"


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put what is at `new` in the place of `old`. What is to be moved is written down first, so that recover() can end the move
    if this process dies within it."""
    old = old.rstrip("/")
    recover(spark, old)
    if not publish(spark, _moves(old), json.dumps({"new": new}).encode()):
        raise OSError(f"{old} is being replaced by another process")
    recover(spark, old)


def recover(spark: SparkSession, path: str) -> None:
    """End a move to path that has begun; nothing if none has. The new table is whole when a move begins, so it is moved on."""
    path = path.rstrip("/")
    plan = _moves(path)
    if not exists(spark, plan):
        return
    new = json.loads(head(spark, plan))["new"]
    fs, target = _at(spark, path)
    aside = f"{new}-old"
    if not exists(spark, new) and not fs.exists(target) and exists(spark, aside):  # the new table is lost: the old one stands again
        fs.rename(_at(spark, aside)[1], target)
    if exists(spark, new):
        if fs.exists(target) and not fs.rename(target, _at(spark, aside)[1]):
            raise OSError(f"cannot move {path}")
        if not fs.rename(_at(spark, new)[1], target):
            raise OSError(f"cannot move {new} to {path}")
    remove(spark, aside)
    remove(spark, plan)
