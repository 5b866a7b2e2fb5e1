"""Members of zip archives as lines, read by ranges.

An archive's directory is read first, and then only the bytes of the members in question: a deflated one is inflated as a stream by
one task, a stored one is split between lines.  So neither archives nor members have to fit anywhere.
"""

from __future__ import annotations

import struct
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import Written, created, drafted, listed, opened, prepared_folder, settled
from .sinks import TextFormat, header_lines, text_lines
from .text import TextTable, from_lines

#: Endings of members that hold a table.
TABLES = (".csv", ".txt", ".dat", ".tsv")
#: Lines in a batch, bytes read at once, and bytes of a stored member that one task reads.
BATCH_LINES, CHUNK, SPLIT_BYTES = 20_000, 1 << 20, 64 << 20
#: Fixed values of the format: length of a member's own header, and where it has the lengths of name and extra field.
LOCAL_HEADER, LOCAL_LENGTHS = 30, 26


def _is_table(name: str) -> bool:
    last = name.rsplit("/", 1)[-1]
    return not name.endswith("/") and not name.startswith("__MACOSX") and not last.startswith(".") and last.lower().endswith(TABLES)


@dataclass
class Part(InputPartition):
    """Lines of a member: all of them (end None), or those that begin in a range of its stored bytes."""

    path: str
    member: str | None = None
    first: int = 0
    end: int | None = None


def _lines(chunks):
    """Lines of a stream of bytes, without their ends; the last one need not have one."""
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class ZipSource(DataSource):
    """``spark.read.format("zip_lines")`` with the options path, members (``first``, ``all`` or ``named``), member and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, size long" if self.options.get("members") == "listed" else "archive string, member string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(dict(self.options))


    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ZipWriter(self.options["path"], self.options.get("member", "table.csv"), self.options.get("head", ""), overwrite)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members, self.member = options["path"], options.get("members", "first"), options.get("member")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        """One for each member that is read, more for a large stored one; only directories are read for that."""
        archives = [p for p, _ in listed(self.path)]
        if self.members == "listed":
            return [Part(p) for p in archives]
        out = []
        with ThreadPoolExecutor(16) as pool:
            directories = list(pool.map(self._tables, archives))
        for path, tables in zip(archives, directories):
            for i in tables if self.members == "all" else tables[:1]:
                if i.compress_type == zipfile.ZIP_STORED and not i.flag_bits & 1 and i.file_size > self.split:
                    out += [Part(path, i.filename, a, min(a + self.split, i.file_size)) for a in range(0, i.file_size, self.split)]
                else:
                    out.append(Part(path, i.filename))
        return out or [Part("")]

    def _tables(self, path: str) -> list[zipfile.ZipInfo]:
        with opened(path) as file, zipfile.ZipFile(file) as z:
            return [i for i in z.infolist() if (i.filename == self.member if self.members == "named" else _is_table(i.filename))]

    def read(self, part: Part):
        if not part.path:
            return
        with opened(part.path) as file, zipfile.ZipFile(file) as z:
            if part.member is None:
                found = [(part.path, i.filename, i.file_size) for i in z.infolist() if _is_table(i.filename)]
                columns = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["archive", "member", "size"])
                return
            held = []
            for line in self._of_range(file, z.getinfo(part.member), part) if part.end is not None else self._of_stream(z, part.member):
                held.append(line.decode("utf-8", "replace"))
                if len(held) >= BATCH_LINES:
                    yield self._batch(part, held)
                    held = []
            if held:
                yield self._batch(part, held)

    @staticmethod
    def _of_stream(z: zipfile.ZipFile, member: str):
        with z.open(member) as raw:
            yield from _lines(iter(lambda: raw.read(CHUNK), b""))

    @staticmethod
    def _of_range(file, info: zipfile.ZipInfo, part: Part):
        """Lines that begin in the range: the one that its first byte stands in belongs to the range before, unless it begins there."""
        file.seek(info.header_offset)
        name, extra = struct.unpack_from("<HH", file.read(LOCAL_HEADER), LOCAL_LENGTHS)
        data, begin = info.header_offset + LOCAL_HEADER + name + extra, max(part.first - 1, 0)

        def chunks(at: int):
            file.seek(data + at)
            for k in range(at, info.file_size, CHUNK):
                yield file.read(min(CHUNK, info.file_size - k))

        whole = part.first == 0  # else the first line here is the end of one that began before
        for line in _lines(chunks(begin)):
            if begin >= part.end:
                return
            if whole:
                yield line
            whole, begin = True, begin + len(line) + 1

    @staticmethod
    def _batch(part: Part, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines)), pa.array([part.member] * len(lines)), pa.array(lines, pa.string())], names=["archive", "member", "value"])


class ZipWriter(DataSourceArrowWriter):
    """An archive for every task, with one member that is deflated as its lines come; each begins with the head."""

    def __init__(self, path: str, member: str, head: str, overwrite: bool):
        self.path, self.member, self.head = path, member, head
        prepared_folder(path, overwrite)

    def write(self, batches) -> Written:
        message, some = drafted(self.path, ".zip"), False
        with created(message.draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(self.member, "w", force_zip64=True) as raw:
            raw.write(self.head.encode())
            for batch in batches:
                some |= batch.num_rows > 0
                raw.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        if not some:
            settled([message], False)
        return message if some else Written(None, None)

    def commit(self, messages) -> None:
        settled(messages, True)

    def abort(self, messages) -> None:
        settled(messages, False)


def write_zip(df: DataFrame, path: str, columns: dict[str, str] | None = None, fmt: TextFormat | None = None, member: str = "table.csv", overwrite: bool = False) -> None:
    """Write a table as a folder of zip archives, one from each task, whose members are text tables with comments and header."""
    fmt, columns = fmt or TextFormat(), columns or {c: c for c in df.columns}
    df.sparkSession.dataSource.register(ZipSource)
    head = "".join(f"{line}\n" for line in header_lines(list(columns.values()), fmt))
    lines = text_lines(df, columns, fmt).write.format("zip_lines").option("member", member).option("head", head)
    lines.mode("overwrite" if overwrite else "append").save(path)


def _source(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_lines").options(**options).load(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size) of the tables in an archive, or in every archive of a folder."""
    return _source(spark, path, members="listed").select(F.col("archive").alias("path"), "member", "size")


def member_lines(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(archive, member, value): lines of one member of each archive, the named one or else the first table."""
    return _source(spark, path, members="named", member=member) if member else _source(spark, path, members="first")


def all_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, member, value): lines of all tables in the archives, each member by a task of its own, stored ones by several."""
    return _source(spark, path, members="all", splitBytes=split_bytes)


def read_zip(spark: SparkSession, path: str, member: str | None = None, **options) -> TextTable:
    """A zipped text table as a typed table; of several archives each one's member has a header of its own."""
    lines = member_lines(spark, path, member).select("value", F.concat_ws("!", "archive", "member").alias("file"))
    return from_lines(lines, file="file", **options)
