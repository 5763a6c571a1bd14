"""File sources: a directory tree of documents (S1) decoded tolerantly.

Every file below the root counts, hidden ones too, whatever its extension.
The tree is listed by tasks: a frontier table holds the directories of one
depth, tasks list them and write what they hold, and the directories among
that are the next frontier, until none is left.  The driver sees only the
number of directories per depth.  Tasks then read the listed files, about
``READ_BYTES`` of them each; a file's content never leaves the row that names
it, so nothing is joined and names are never compared.

Files are keyed by their exact path relative to the root (a root that is a
file by its name): ``a b`` and ``a%20b`` are two files.  A file that cannot be
read, or that is too large for one value (2 GB), keeps its row with
``readable`` false.  Links to files are files; links to directories are not
followed, and directories that cannot be listed hold nothing.

File systems that Arrow cannot open (``viewfs:`` and others that only Spark
knows) are listed by the driver and read with ``binaryFile``, which refuses
hidden files: those are not readable there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Content of one reading task, about, and of one batch of rows.
READ_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Directories that one task lists.
TASK_DIRECTORIES = 64
#: The longest value a row can hold.
MAX_BYTES = (1 << 31) - 64

LISTED = "rel_path string, n_bytes long, directory boolean"


def open_tree(root: str):
    """``(filesystem, base path)`` of a root, taken literally where it is local."""
    from pyarrow import fs
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:"):].strip("/")
    if "://" not in root:
        return fs.LocalFileSystem(), os.path.abspath(root)
    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _lister(root: str, glob: str | None):
    def entries(system, base: str, rel: str):
        from pyarrow import fs
        try:
            found = system.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base))
        except OSError:
            return
        local = isinstance(system, fs.LocalFileSystem)
        for info in found:
            name = f"{rel}/{info.base_name}" if rel else info.base_name
            if info.type == fs.FileType.Directory:
                if not (local and os.path.islink(info.path)):
                    yield name, None, True
            elif info.type != fs.FileType.NotFound and (not glob or fnmatch(info.base_name, glob)):
                yield name, info.size, False

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_tree(root)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                rows = list(entries(system, base, rel))
                for at in range(0, len(rows), 100_000):
                    names, sizes, dirs = zip(*rows[at:at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(dirs)],
                                                     ["rel_path", "n_bytes", "directory"])
    return listing


def list_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(rel_path, n_bytes)`` of every file at or below ``root``, listed by tasks."""
    from pyarrow import fs
    system, base = open_tree(root)
    top = system.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if top.type == fs.FileType.File:
        return spark.createDataFrame([(top.base_name, top.size)], "rel_path string, n_bytes long")
    frontier, files = spark.createDataFrame([("",)], "rel_path string"), []
    while True:
        found = materialize(frontier.mapInArrow(_lister(root, glob), LISTED), "tree")
        files.append(found.where("NOT directory").select("rel_path", "n_bytes"))
        frontier = found.where("directory").select("rel_path")
        n = frontier.count()
        if not n:
            break
        frontier = frontier.repartition(-(-n // TASK_DIRECTORIES), "rel_path")
    out = files[0]
    for more in files[1:]:
        out = out.union(more)
    return out


def _reader(root: str, alone: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_tree(root)
        names, sizes, contents, held = [], [], [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())],
                                              ["rel_path", "n_bytes", "content"])
        for batch in batches:
            for name, size in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                content = None
                if size is None or size <= MAX_BYTES:
                    try:
                        with system.open_input_file(base if alone else f"{base}/{name}") as f:
                            content = f.readall()
                    except OSError:
                        pass
                if names and held + len(content or b"") > BATCH_BYTES:
                    yield batch_of()
                    names, sizes, contents, held = [], [], [], 0
                names.append(name)
                sizes.append(size)
                contents.append(content)
                held += len(content or b"")
        if names:
            yield batch_of()
    return read


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, rel_path, n_bytes, content)``; content is NULL where a file
    cannot be read."""
    from pyarrow import fs
    try:
        system, base = open_tree(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _read_by_spark(spark, root, glob)
    alone = system.get_file_info(base).type == fs.FileType.File
    listed = list_tree(spark, root, glob)
    total = listed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, total // READ_BYTES)
    rows = listed.repartition(parts, "rel_path").mapInArrow(_reader(root, alone), "rel_path string, n_bytes long, content binary")
    path = F.lit(root) if alone else F.concat(F.lit(root.rstrip("/") + "/"), F.col("rel_path"))
    return rows.select(path.alias("path"), "rel_path", "n_bytes", "content")


def _read_by_spark(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    """``read_tree`` where only Spark can open the files: listed through its
    file system, content matched by the encoded path, which is exact."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.makeQualified(top)
    base = top.toUri().getPath().rstrip("/")
    files, todo = [], [top]
    while todo:
        for status in system.listStatus(todo.pop()):  # a file lists itself
            path = status.getPath()
            if status.isDirectory():
                todo.append(path)
            elif not glob or fnmatch(path.getName(), glob):
                rel = path.toUri().getPath()[len(base):].lstrip("/") or path.getName()
                files.append((path.toString(), rel, int(status.getLen()), path.toUri().toString()))
    listed = spark.createDataFrame(files, "path string, rel_path string, n_bytes long, key string")
    key = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")
    content = spark.createDataFrame([], "key string, content binary")
    plain = [p for p, rel, _, _ in files if rel.rsplit("/", 1)[-1][:1] not in ("_", ".")]
    if plain:
        escaped = ["".join("\\" + c if c in "{}[]*?\\" else c for c in p) for p in plain]
        read = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(escaped)
        content = read.select(key(F.col("_metadata.file_path")).alias("key"), "content")
    return listed.withColumn("key", key(F.col("key"))).join(content, "key", "left").drop("key")


def decode_text(content, drop_invalid: bool = True):
    """Bytes -> text.  Invalid UTF-8 is dropped (it first becomes U+FFFD,
    then removed, which also removes genuine U+FFFD characters) and line ends
    are folded: CRLF and lone CR become LF."""
    s = F.make_valid_utf8(content.cast("string"))
    if drop_invalid:
        s = F.regexp_replace(s, "�", "")
    return F.regexp_replace(s, "\r\n?", "\n")


def documents_from_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, rel_path, text, n_bytes, readable)`` for every file at or below ``root``."""
    df = read_tree(spark, root, glob)
    return df.select("path", "rel_path", decode_text(F.col("content")).alias("text"), "n_bytes",
                     F.col("content").isNotNull().alias("readable"))
