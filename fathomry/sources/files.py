"""Folders of many files, listed and opened inside tasks.

Spark's file sources keep the name of every file on the driver and plan a few files a task, which millions of small files do
not allow. Here each level of folders is a table of one row per entry, a folder is listed by one task, and its files are
dealt out by name. ``root`` is a mounted folder or one that Arrow's file systems open.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.session import fresh_dir

# Files and bytes dealt to a task, bytes of files handed on at once, bytes of a
# large file in one chunk.
FILES, BYTES, HELD, CHUNK = 20_000, 128 << 20, 8 << 20, 16 << 20
SPECIAL = re.compile(r"[*?\[\]{}\\]")
QUOTED = ' "#<>?[\\]^`{|}'  # beside the per cent sign, what a URI writes as a number


def slots(spark: SparkSession) -> int:
    """Partitions for rows whose number says nothing about the work behind them."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _parts(spark: SparkSession, path: str) -> tuple[str, str, list[str]]:
    """(scheme as Spark writes it, path without it, patterns of the levels below): the path up to its first pattern."""
    levels = path.rstrip("/").split("/")
    fixed = next((i for i, x in enumerate(levels) if SPECIAL.search(x)), len(levels))
    base = spark._jvm.org.apache.hadoop.fs.Path("/".join(levels[:fixed]) or "/")
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    scheme, _, plain = whole.partition(":")
    globs = [spark._jvm.org.apache.hadoop.fs.GlobPattern(x).compiled().pattern() for x in levels[fixed:]]
    return f"{scheme}:" + ("" if plain.startswith("/") and not plain.startswith("//") else "//"), plain.removeprefix("//"), globs


def _listed(folders: DataFrame, scheme: str, glob: str | None, kind: str) -> DataFrame:
    """Entries of folders: path, length, whether they are folders. Hidden files are left out, and hidden folders that no
    pattern names, as Spark does."""
    pattern = None if glob is None else re.compile(glob)

    def kept(x):
        name = x.base_name
        hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
        if pattern is not None:
            return pattern.fullmatch(name) and not (hidden and x.type == pafs.FileType.File)
        return not hidden

    def entries(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, top = (pafs.LocalFileSystem(), folder) if scheme == "file:" else pafs.FileSystem.from_uri(scheme + folder)
                found = [
                    (x.path if scheme == "file:" else folder.rstrip("/") + "/" + x.base_name, x.size or 0, x.type == pafs.FileType.Directory)
                    for x in files.get_file_info(pafs.FileSelector(top))
                    if kept(x)
                ]
                for i in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 10_000]), (pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"])

    return folders.select("path").mapInArrow(entries, kind)


def list_whole(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> tuple[str, DataFrame, int]:
    """(scheme, files as (path, length), partitions to deal them to) of paths, which may be folders or patterns.

    A folder stands for the files in it, with ``recursive`` also for those below. A path that leads to nothing fails.
    """
    kind, out, scheme, total = "path string, length bigint, folder boolean", fresh_dir(spark, "files"), "file:", []
    for n, path in enumerate([paths] if isinstance(paths, str) else paths):
        scheme, base, globs = _parts(spark, path)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(scheme + base)
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(hadoop):
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
        status = system.getFileStatus(hadoop)
        level, depth = spark.createDataFrame([(base, status.getLen(), status.isDirectory())], kind).coalesce(1), 0
        while True:
            level.write.parquet(f"{out}/path={n}/level={depth}")
            level = spark.read.schema(kind).parquet(f"{out}/path={n}/level={depth}")
            if depth >= len(globs):
                total.append(level.filter("NOT folder"))
            # Below a folder that was named, only folders of partitions are opened.
            inside = level.filter("folder" if recursive or depth <= len(globs) else r"folder AND path RLIKE '=[^/]*$'")
            if depth <= len(globs) and level.isEmpty():
                raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
            if depth >= len(globs) and inside.isEmpty():
                break
            level = _listed(inside.repartition(slots(spark), "path"), scheme, globs[depth] if depth < len(globs) else None, kind)
            depth += 1
    found = total[0]
    for more in total[1:]:
        found = found.unionByName(more)
    files, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return scheme, found.select("path", "length"), max(slots(spark), files // FILES + 1, size // BYTES + 1)


def read_whole(spark: SparkSession, paths: str | list[str], recursive: bool = False, unpack: bool = False, pattern: str | None = None) -> DataFrame:
    """Files as (path, content), each whole; ``unpack`` opens compressed ones, ``pattern`` picks by file name.

    The path is the file's URI in plain characters; ``uri`` gives the form of Spark's file metadata. Listing runs jobs when
    this is called, reading is lazy.
    """
    scheme, found, parts = list_whole(spark, paths, recursive)
    if pattern is not None:
        found = found.filter(F.regexp(F.substring_index("path", "/", -1), F.lit(f"^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})$")))
    most, compression = HELD, "detect" if unpack else None

    def read(batches):
        local = pafs.LocalFileSystem()
        names, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, top = (local, path) if scheme == "file:" else pafs.FileSystem.from_uri(scheme + path)
                with files.open_input_stream(top, compression=compression) as f:
                    data = f.read()
                names.append(scheme + path)
                contents.append(data)
                held += len(data) + 100
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    names, contents, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return found.select("path").repartition(parts, "path").mapInArrow(read, "path string, content binary")


def uri(path: Column) -> Column:
    """A plain path as Spark's file metadata writes it."""
    out = F.replace(path, F.lit("%"), F.lit("%25"))
    for c in QUOTED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def read_records(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    """Elements ``tag`` of XML files as (path, content), a large file by chunks that several tasks take.

    A record goes from its opening tag to the first closing one, or to the next opening one or the end of its file if that
    comes before; it belongs to the chunk it begins in. Elements of one name do not nest. A compressed file is one chunk,
    which is unpacked bit by bit; a task holds a chunk and a record at most.
    """
    scheme, found, parts = list_whole(spark, paths)
    size, packed = CHUNK, r"\.(gz|bz2|lz4|zst)$"
    starts = F.when((F.col("length") == 0) | F.col("path").rlike(packed), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint")))
    chunks = found.select("path", F.explode(starts).alias("first"))
    opening = re.compile(rb"<" + tag.encode() + rb"(?=[\s/>])")
    closing = re.compile(rb"</" + tag.encode() + rb"\s*>|<" + tag.encode() + rb"(?=[\s/])[^<>]*/>")
    longest = len(tag) + 2  # bytes an opening tag may reach into the next chunk

    def records(source, stop):
        """Records that begin before ``stop`` bytes, all without a stop; what lies behind them is let go."""
        data, gone, at = source.read(size + longest), 0, 0
        while True:
            here = opening.search(data, at)
            if here is None:
                if stop is not None and gone + len(data) >= stop + longest:
                    return
                # A tag may be cut by the end of what was read.
                at, new = max(at, len(data) - longest), source.read(min(size, 1 << 20))
                if not new:
                    return
                data, gone, at = data[at:] + new, gone + at, 0
                continue
            at = here.start()
            if stop is not None and gone + at >= stop:
                return
            while True:
                after, end = opening.search(data, at + 1), closing.search(data, at)
                edge = min([x for x in (after and after.start(), end and end.end()) if x], default=None)
                new = source.read(min(size, 1 << 20)) if edge is None or edge + longest > len(data) else b""
                if not new:
                    break
                data, gone, at = data[at:] + new, gone + at, 0
            yield data[at : edge or len(data)]
            if edge is None:
                return
            at = edge

    def read(batches):
        local = pafs.LocalFileSystem()
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, top = (local, path) if scheme == "file:" else pafs.FileSystem.from_uri(scheme + path)
                if re.search(packed, path):
                    source, stop = files.open_input_stream(top, compression="detect"), None
                else:
                    source, stop = files.open_input_file(top), size
                    source.seek(first)
                names, contents, held = [], [], 0
                with source:
                    for content in records(source, stop):
                        names.append(scheme + path)
                        contents.append(content)
                        held += len(content)
                        if held >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                            names, contents, held = [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return chunks.repartition(parts, "path", "first").mapInArrow(read, "path string, content binary")
