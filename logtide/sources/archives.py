"""Log lines inside archives, unpacked by the executors.

Listing an archive is one task per archive; reading is one task per member for
zip and plain tar files, whose members can be reached directly, and one per
archive for compressed tar files, which cannot. Lines leave in bounded batches.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.sources.lines import name_selected

# What marks a diagnostic bundle, and the folders read from one.
ARCHIVE_NAME = r"(?i)\.(zip|tar|tgz|tar\.gz|tbz2|tar\.bz2|txz|tar\.xz)$"
BUNDLE_MARKS = ("sosreport", "sos_commands")
BUNDLE_FOLDERS = ("var/log/", "sos_logs/")
BATCH_LINES = 5000

MEMBERS = "archive string, member string, inner string, direct boolean"
LINES = "archive string, member string, inner string, block_start long, line_seq long, value string"


@contextmanager
def _opened(uri: str):
    filesystem, path = pafs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(path) as source:
        yield source


def _is_zip(source) -> bool:
    found = zipfile.is_zipfile(source)
    source.seek(0)
    return found


def _members(source) -> Iterator[tuple[str, object]]:
    """(name, open file) of every regular member, in order."""
    if _is_zip(source):
        with zipfile.ZipFile(source) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    with archive.open(info) as member:
                        yield info.filename, member
    else:
        with tarfile.open(fileobj=source, mode="r|*") as archive:
            for info in archive:
                if info.isfile():
                    yield info.name, archive.extractfile(info)


def _names(source) -> tuple[list[str], bool]:
    """Member names, and whether members can be opened one by one."""
    if _is_zip(source):
        with zipfile.ZipFile(source) as archive:
            return [i.filename for i in archive.infolist() if not i.is_dir()], True
    try:
        with tarfile.open(fileobj=source, mode="r:") as archive:
            return [i.name for i in archive if i.isfile()], True
    except tarfile.ReadError:
        source.seek(0)
    with tarfile.open(fileobj=source, mode="r|*") as archive:
        return [i.name for i in archive if i.isfile()], False


def _bundle_names(names: list[str]) -> list[str] | None:
    """Members to keep of a diagnostic bundle, None for other archives."""
    if not any(mark in n.lower() for n in names for mark in BUNDLE_MARKS):
        return None
    return [n for n in names if n.split("/", 1)[-1].startswith(BUNDLE_FOLDERS)]


def _is_archive_name(name: str) -> bool:
    return name.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz", ".tbz2", ".tar.bz2", ".txz", ".tar.xz"))


def list_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """archive, member, and whether the member can be opened by itself."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        .select("path").where(F.col("path").rlike(ARCHIVE_NAME))
    )

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                with _opened(path) as source:
                    names, direct = _names(source)
                kept = _bundle_names(names)
                for name in names if kept is None else kept:
                    rows.append((path, name, None, direct))
                yield pd.DataFrame(rows, columns=["archive", "member", "inner", "direct"])

    return files.repartition("path").mapInPandas(listed, MEMBERS)


def read_archives(
    spark: SparkSession, paths: list[str], all_files: bool = False,
    log_files: bool = True, txt_files: bool = False,
) -> DataFrame:
    """Lines of the selected members; archives inside are opened once."""
    members = list_members(spark, paths).withColumn("name", F.regexp_extract("member", "([^/]+)$", 1))
    nested = F.col("name").rlike(ARCHIVE_NAME)
    wanted = members.where(nested | name_selected(F.col("name"), all_files, log_files, txt_files))
    # One group per member that can be reached directly, else one per archive.
    unit = F.when(F.col("direct"), F.col("member"))
    work = wanted.select("archive", "member", "direct", unit.alias("unit")).repartition("archive", "unit")

    def batches_of(archive, member, inner, source) -> Iterator[pd.DataFrame]:
        lines, first = [], 0
        for raw in source:
            line = raw.decode("utf-8", "ignore").removesuffix("\n").removesuffix("\r")
            lines += line.split("\r")
            if len(lines) >= BATCH_LINES:
                yield _frame(archive, member, inner, first, lines)
                first, lines = first + len(lines), []
        if lines:
            yield _frame(archive, member, inner, first, lines)

    def _frame(archive, member, inner, first, lines) -> pd.DataFrame:
        n = len(lines)
        return pd.DataFrame({
            "archive": [archive] * n, "member": [member] * n, "inner": [inner] * n,
            "block_start": [0] * n, "line_seq": range(first, first + n), "value": lines,
        })

    def opened(archive, member, source) -> Iterator[pd.DataFrame]:
        if not _is_archive_name(member):
            yield from batches_of(archive, member, None, source)
            return
        for inner, content in _members(io.BytesIO(source.read())):
            yield from batches_of(archive, member, inner, content)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (archive, direct), rows in pdf.groupby(["archive", "direct"]):
                wanted_names = set(rows["member"])
                with _opened(archive) as source:
                    if direct and _is_zip(source):
                        with zipfile.ZipFile(source) as z:
                            for name in rows["member"]:
                                with z.open(name) as content:
                                    yield from opened(archive, name, content)
                    elif direct:
                        with tarfile.open(fileobj=source, mode="r:") as t:
                            for name in rows["member"]:
                                yield from opened(archive, name, t.extractfile(name))
                    else:
                        for name, content in _members(source):
                            if name in wanted_names:
                                yield from opened(archive, name, content)

    lines = work.mapInPandas(read, LINES)
    # Members of an inner archive are selected by their own names.
    leaf = F.regexp_extract(F.coalesce("inner", "member"), "([^/]+)$", 1)
    chosen = name_selected(leaf, all_files, log_files, txt_files)
    return lines.where(chosen).select(
        F.concat_ws("/", "archive", "member", "inner").alias("file_name"),
        "block_start", "line_seq", "value",
    )
