"""Copies of files between stores, byte for byte: a listing is dealt to tasks, each of which streams its files to a temporary name, compares what has arrived, and renames.

A store is a folder of any filesystem that both Hadoop and pyarrow know. Speech files lie in it as `<year>.jsonl` or in folders `year=<year>`;
both layouts keep their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are copied at a time, and tasks at most.
CHUNK, MOST_TASKS = 8 << 20, 10_000
_NAME = re.compile(r"(?:^|/)(?:year=(\d+)/[^/]+\.json[^/]*|(\d+)\.jsonl)$")


class Broken(IOError):
    """What arrived is not what was sent."""


def year_of(name: str) -> int | None:
    """The year of a speech file by its name below the store; none for other files."""
    found = _NAME.search(name)
    return int(found[1] or found[2]) if found else None


def listing(spark: SparkSession, folder: str, year: int | None = None) -> list[tuple[str, int]]:
    """(name below the folder, bytes) of its speech files, of one year or all: a few files for each year. A folder that is missing has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    base = fs.makeQualified(path).toUri().getPath().rstrip("/")
    files, out = fs.listFiles(path, True), []
    while files.hasNext():
        s = files.next()
        name = s.getPath().toUri().getPath()[len(base) + 1 :]
        own = year_of(name)
        if own is not None and year in (None, own) and not re.search(r"(^|/)[._]", name):
            out.append((name, s.getLen()))
    return sorted(out)


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    folder = re.sub("^s3[an]://", "s3://", folder)
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


def copy_file(source: tuple[pa.fs.FileSystem, str], target: tuple[pa.fs.FileSystem, str], size: int) -> str:
    """Copy one file and return its SHA-256. The target's name appears when all bytes are there and read back alike."""
    (there, name), (here, to) = source, target
    folder, _, last = to.rpartition("/")
    draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
    here.create_dir(folder, recursive=True)
    sent, n = hashlib.sha256(), 0
    with there.open_input_stream(name, compression=None) as stream, here.open_output_stream(draft, compression=None) as out:
        while data := stream.read(CHUNK):
            sent.update(data)
            n += len(data)
            out.write(data)
    came = hashlib.sha256()
    with here.open_input_stream(draft, compression=None) as stream:
        while data := stream.read(CHUNK):
            came.update(data)
    if n != size or came.digest() != sent.digest():
        here.delete_file(draft)
        raise Broken(f"{name}: {n} bytes of {size}, digests {'equal' if came.digest() == sent.digest() else 'differ'}")
    if here.get_file_info(to).type != pa.fs.FileType.NotFound:
        here.delete_file(to)
    here.move(draft, to)
    return sent.hexdigest()


def _copy(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, from_), (b, to) = _open(source), _open(target)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), batch.column("bytes").to_pylist()
            digests = [copy_file((a, f"{from_.rstrip('/')}/{n}"), (b, f"{to.rstrip('/')}/{n}"), s) for n, s in zip(names, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(digests)], names=["name", "bytes", "sha256"])

    return run


def mirror(spark: SparkSession, source: str, target: str, year: int | None = None) -> DataFrame:
    """Copy the speech files of a year, or of all, from one store to another: (name, bytes, sha256) of each. Files with the same names are replaced; of years that are
    copied, files that the source lacks go, so that nothing counts twice; other years stay."""
    found = listing(spark, source, year)
    rows = spark.createDataFrame(found, "name string, bytes long")
    if not found:
        return spark.createDataFrame([], "name string, bytes long, sha256 string")
    done = rows.repartition(min(len(found), MOST_TASKS)).mapInArrow(_copy(source, target), "name string, bytes long, sha256 string").collect()  # a row per file
    names, years = {n for n, _ in found}, {year_of(n) for n, _ in found}
    fs, to = _open(target)
    for name, _ in listing(spark, target):
        if name not in names and year_of(name) in years:
            fs.delete_file(f"{to.rstrip('/')}/{name}")
    return spark.createDataFrame([tuple(r) for r in done], "name string, bytes long, sha256 string")
