"""A data source that writes text files under names that rows carry.

Spark's own text sink names its files itself; report folders need
``{source}/{page}_{n}.csv`` and ``{source}/{page}.txt``.  A row is
``(file, piece)``: a path below the target folder and text to append to it.
Rows of one file must be neighbours of one partition (:func:`write_named`
sees to that).  A task streams each file under a hidden name and moves it to
its own once the next file begins, which shows that it is whole.  The last file of a
task has no such sign (a failed input can look like its end to the writer), so the job
moves these, one a task, when every task has succeeded.  A lost task thus leaves no half
file that a reader finds, and its retry replaces what it had finished with the same
contents.  The job writes ``_SUCCESS`` last.  One file name a task returns to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "tabloom_named_files"


def filesystem(path: str):
    """The file system of a path or URI, and the path inside it."""
    import os

    from pyarrow import fs

    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(path if not path.startswith("file:") else urlsplit(path).path)
    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    hidden: str
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        if overwrite:
            system, root = filesystem(self.path)
            system.delete_dir_contents(root, missing_dir_ok=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = filesystem(self.path)
        attempt = uuid.uuid4().hex
        name, hidden, out = None, None, None

        def publish() -> None:
            out.close()
            system.move(hidden, f"{root}/{name}")

        try:
            for batch in iterator:
                for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
                    if file != name:
                        if out is not None:
                            publish()
                        name = file
                        folder, _, base = file.rpartition("/")
                        system.create_dir(f"{root}/{folder}", recursive=True)
                        hidden = f"{root}/{folder}/.{base}.{attempt}"
                        out = system.open_output_stream(hidden)
                    out.write(piece.encode())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                system.delete_file(hidden)
            raise
        return _Written(hidden or "", name or "")

    def commit(self, messages: list) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.hidden:
                system.move(m.hidden, f"{root}/{m.name}")
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            if m is not None and m.hidden:
                system.delete_file(m.hidden)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, piece string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def folder_name(col: Column) -> Column:
    """A value as one folder name; a null, empty or hidden name or one with a slash ends the job."""
    ok = F.coalesce(~col.rlike(r"^$|^[._]|/|\x00"), F.lit(False))
    return F.when(ok, col).otherwise(F.raise_error(F.concat(F.lit("not a folder name: "), F.coalesce(col, F.lit("null")))))


def number_name(col: Column) -> Column:
    """A page or table number as text; a null one ends the job."""
    return F.coalesce(col.cast("string"), F.raise_error(F.lit("a page or table without a number")).cast("string"))


def write_named(rows: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """Write ``rows(file, piece, <order>)``: a file's pieces in that order; null pieces are empty.

    ``overwrite`` empties the folder first, ``append`` keeps the files that are not written anew.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    rows.sparkSession.dataSource.register(NamedFiles)
    (rows.repartition("file").sortWithinPartitions("file", *order)
     .select("file", F.coalesce("piece", F.lit("")).alias("piece"))
     .write.format(FORMAT).mode(mode).save(path))
