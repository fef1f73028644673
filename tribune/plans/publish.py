"""Files that several folders receive together: written aside, named in one manifest, then moved to their places, whatever happens in between.

    <aside>/<run>/<what>/...     what a run has written
    <aside>/<run>/MANIFEST       [[from, to], ...]: the run counts from here on

A run without a manifest never happened. One with a manifest is carried through by replay(), which moves what is not moved yet; that may be
repeated at any point, as every file has one name and moves once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Aside:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self.conf)

    def runs(self) -> list[str]:
        folder = self._path(self.folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def begin(self) -> str:
        return uuid.uuid4().hex

    def write(self, run: str, what: str, rows: DataFrame, by: str | None = None) -> None:
        """JSON lines of a run, in folders by a column."""
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).json(f"{self.folder}/{run}/{what}")

    def _files(self, folder: str, below: str = "") -> list[str]:
        """Names of the data files under a folder, with the folders between."""
        out = []
        for s in self.fs.listStatus(self._path(f"{folder}/{below}" if below else folder)):
            name = s.getPath().getName()
            if name[0] in "._":
                continue
            out += self._files(folder, f"{below}{name}/") if s.isDirectory() else [f"{below}{name}"]
        return sorted(out)

    def commit(self, run: str, targets: dict[str, str]) -> None:
        """The run counts: targets says where each of its folders goes. Files go in the order of targets, so that the last is a sign of the others."""
        moves = []
        for what, target in targets.items():
            for name in self._files(f"{self.folder}/{run}/{what}"):
                below, _, file = name.rpartition("/")
                to = f"{target.rstrip('/')}/{below + '/' if below else ''}{run}-{len(moves)}{file[file.find('.') :] if '.' in file else ''}"
                moves.append((f"{self.folder}/{run}/{what}/{name}", to))
        draft, final = self._path(f"{self.folder}/{run}/.draft"), self._path(f"{self.folder}/{run}/MANIFEST")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(moves).encode()))
        out.close()
        self.fs.rename(draft, final)

    def _move(self, source: str, target: str) -> None:
        source_, target_ = self._path(source), self._path(target)
        there = target_.getFileSystem(self.conf)
        if there.exists(target_) or not self.fs.exists(source_):
            return
        there.mkdirs(target_.getParent())
        if there.getUri().equals(self.fs.getUri()):
            self.fs.rename(source_, target_)
        else:  # between stores: under another name until it is whole
            draft = self._path(f"{target_.getParent().toString()}/.{target_.getName()}")
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, source_, there, draft, False, True, self.conf)
            there.rename(draft, target_)

    def replay(self) -> list[str]:
        """Carry through all runs that count and delete the debris of the others; returns the runs carried through. One caller at a time."""
        done = []
        for run in self.runs():
            manifest = self._path(f"{self.folder}/{run}/MANIFEST")
            if self.fs.exists(manifest):
                stream = self.fs.open(manifest)
                moves = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
                stream.close()
                for source, target in moves:  # a file for each year and ledger of a run
                    self._move(source, target)
                done.append(run)
            self._delete(run)
        return done

    def _delete(self, run: str) -> None:
        # the manifest last: while it is there, the run can be replayed
        for s in self.fs.listStatus(self._path(f"{self.folder}/{run}")):
            if s.getPath().getName() != "MANIFEST":
                self.fs.delete(s.getPath(), True)
        self.fs.delete(self._path(f"{self.folder}/{run}"), True)
