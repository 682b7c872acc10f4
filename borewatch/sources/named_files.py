"""A data source of text files by name: it writes one per name, with exactly that name, and reads them back.

Tasks write below a hidden attempt folder.  Only the commit step, which knows that all tasks are through, moves files to
their names, so a failed or repeated task leaves nothing behind, and running the job again gives the same names.  A reading
task takes many small files.  The driver holds 16 bytes for each file that is written, and the packed names of those to read.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "named_text"
# Files, and bytes of files, that one task reads, and bytes that it hands on together.
SLICE_FILES, SLICE_BYTES, BATCH_BYTES = 1024, 64 << 20, 4 << 20
# Entries of a folder that are looked at together.
ENTRIES_AT_ONCE = 10_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def entries_below(path: str, allow_not_found: bool = True) -> Iterator[tuple[str, int]]:
    """Name and bytes of the files of a folder, hidden ones and folders left out; a local folder is never held whole."""
    files, root = filesystem(path)
    if isinstance(files, pafs.LocalFileSystem):
        if allow_not_found and not os.path.exists(root):
            return
        with os.scandir(root) as found:
            for entry in found:
                if not entry.name.startswith((".", "_")) and entry.is_file():
                    yield entry.name, entry.stat().st_size
        return
    for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=allow_not_found)):
        if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")):
            yield f.base_name, f.size


def sorted_entries(path: str, allow_not_found: bool = True) -> Iterator[tuple[str, int]]:
    """As `entries_below`, by name: sorted as columns, which take little more than the names themselves."""
    names, sizes, found = [], [], entries_below(path, allow_not_found)
    while some := list(islice(found, ENTRIES_AT_ONCE)):
        names.append(pa.array([n for n, _ in some], pa.large_string()))
        sizes.append(pa.array([s for _, s in some], pa.int64()))
    if not names:
        return
    name, size = pa.concat_arrays(names), pa.concat_arrays(sizes)
    del names, sizes
    order = pc.sort_indices(name)
    for start in range(0, len(order), ENTRIES_AT_ONCE):
        part = order.slice(start, ENTRIES_AT_ONCE)
        yield from zip(name.take(part).to_pylist(), size.take(part).to_pylist())


def files_below(path: str) -> list[str]:
    """Names of the files of a folder, hidden ones and folders left out."""
    return [name for name, _ in sorted_entries(path)]


def digest(name: str) -> bytes:
    return hashlib.blake2b(name.encode("utf-8", "surrogateescape"), digest_size=16).digest()


@dataclass
class Written(WriterCommitMessage):
    """The attempt folder of a task, and a digest of each name written there."""

    attempt: str
    digests: bytes


class NamedTextWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows (name, text) of one task; those of a name follow each other and are put together."""
        files, root = filesystem(self.path)
        attempt = posixpath.join(root, f"_attempt-{uuid.uuid4().hex}")
        digests = bytearray()
        last, out = None, None
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a file name: {name!r}")
            if name != last:
                if out is not None:
                    out.close()
                files.create_dir(attempt, recursive=True)
                out = files.open_output_stream(posixpath.join(attempt, name))
                digests += digest(name)
                last = name
            out.write((row["text"] or "").encode("utf-8"))
        if out is not None:
            out.close()
        return Written(attempt, bytes(digests))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        done = [m for m in messages if m is not None and m.digests]
        written = np.sort(np.frombuffer(b"".join(m.digests for m in done), dtype="S16"))
        if (written[1:] == written[:-1]).any():
            self.abort(messages)
            raise ValueError("rows of one name were written by several tasks: partition them by name")
        files.create_dir(root, recursive=True)
        for message in done:
            # a move takes the place of a file of that name; a task has written a bounded share of all files
            for name, _ in list(entries_below(message.attempt)):
                files.move(posixpath.join(message.attempt, name), posixpath.join(root, name))
            files.delete_dir(message.attempt)
        while self.overwrite and (others := list(islice(self._others(written), ENTRIES_AT_ONCE))):
            for name in others:
                files.delete_file(posixpath.join(root, name))

    def _others(self, written: np.ndarray) -> Iterator[str]:
        """Files of the folder that have not been written now."""
        found = entries_below(self.path)
        while names := [name for name, _ in islice(found, ENTRIES_AT_ONCE)]:
            asked = np.array([digest(n) for n in names], dtype="S16")
            known = np.searchsorted(written, asked, "right") > np.searchsorted(written, asked, "left")
            yield from (n for n, k in zip(names, known) if not k)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = filesystem(self.path)
        for message in messages:
            if message is not None and message.digests:
                files.delete_dir(message.attempt)


@dataclass
class Slice(InputPartition):
    """The names of some files, packed."""

    packed: bytes

    @classmethod
    def of(cls, names: list[str]) -> "Slice":
        return cls(zlib.compress("\0".join(names).encode("utf-8", "surrogateescape")) if names else b"")

    @property
    def names(self) -> list[str]:
        return zlib.decompress(self.packed).decode("utf-8", "surrogateescape").split("\0") if self.packed else []


class NamedTextReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Slice]:
        slices: list[Slice] = []
        names: list[str] = []
        held = 0
        for name, size in sorted_entries(self.path, allow_not_found=False):
            if not size:
                continue
            if names and (len(names) == SLICE_FILES or held + size > SLICE_BYTES):
                slices.append(Slice.of(names))
                names, held = [], 0
            names.append(name)
            held += size
        return slices + [Slice.of(names)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(self.path)
        names: list[str] = []
        texts: list[str] = []
        held = 0
        for name in partition.names:
            with files.open_input_stream(posixpath.join(root, name)) as file:
                data = file.read()
            names.append(name)
            texts.append(data.decode("utf-8", "replace"))
            held += len(data)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "text"])
                names, texts, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "text"])


class NamedText(DataSource):
    """Option `path`; rows (name string, text string)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema) -> NamedTextReader:
        return NamedTextReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"], overwrite)


def write_named(df: DataFrame, folder: str, order: list[str] | None = None, overwrite: bool = True) -> None:
    """(name, text) -> files of these names in a folder; rows of one name are joined in the order of `order`.

    With `overwrite` files of other names go.  A file is written by one task, row by row, whatever its length.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedText)
    rows = df.repartition("name").sortWithinPartitions("name", *(order or []))
    mode = "overwrite" if overwrite else "append"
    rows.select("name", F.col("text").cast("string").alias("text")).write.format(FORMAT).mode(mode).option("path", folder).save()


def read_named(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of every file of a folder that holds anything."""
    spark.dataSource.register(NamedText)
    return spark.read.format(FORMAT).option("path", folder).load()
