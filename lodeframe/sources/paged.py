"""Paged binary tables (``.dm``) with 4-byte or 8-byte words in either byte order, as a data source.

A file is split in byte ranges; each is read by itself, so neither a file's size nor the number of files bounds what can be read, and
only the columns that are asked for are decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import NumericType, StructType

from .files import Written, created, drafted, listed, opened, prepared_folder, settled

# Fixed values of the format: words of a page, words of a record area, first word of the field table, words per field, values beyond this are missing.
PAGE_WORDS, RECORD_WORDS, HEADER_WORDS, FIELD_WORDS, MISSING = 512, 508, 28, 7, 9.9e29
LAYOUTS = ((4, "<"), (4, ">"), (8, "<"), (8, ">"))


@dataclass
class Field:
    name: str
    numeric: bool
    stored_word: int
    part: int
    default: object


@dataclass
class Header:
    word: int
    order: str
    fields: list[Field]
    last_page: int
    last_record: int

    @property
    def record_words(self) -> int:
        return max((f.stored_word for f in self.fields), default=0)

    @property
    def per_page(self) -> int:
        return RECORD_WORDS // self.record_words if self.record_words else 0

    @property
    def records(self) -> int:
        return max(0, self.last_page - 2) * self.per_page + self.last_record

    def columns(self) -> dict[str, list[Field]]:
        """Text fields of more than one word come in parts under one name."""
        out: dict[str, list[Field]] = {}
        for f in self.fields:
            out.setdefault(f.name, []).append(f)
        return {k: sorted(v, key=lambda f: f.part) for k, v in out.items()}


def _text(word: bytes, size: int) -> str:
    # In 8-byte words only the first four bytes hold characters.
    return word[:4].decode("latin-1") if size == 8 else word.decode("latin-1")


def read_header(page: bytes) -> Header:
    """The layout and field table of a file's first page; layouts are tried until the field count and first name make sense."""
    for size, order in LAYOUTS:
        if len(page) < PAGE_WORDS * size:
            continue
        numbers = np.frombuffer(page[: PAGE_WORDS * size], f"{order}f{size}").astype(float)
        n = numbers[24]
        if not np.isfinite(n) or abs(n - round(n)) > 0.01 or not 1 <= round(n) <= 500:
            continue
        words = [page[k * size : (k + 1) * size] for k in range(PAGE_WORDS)]
        fields = []
        for k in range(round(n)):
            at = HEADER_WORDS + k * FIELD_WORDS
            if at + FIELD_WORDS > PAGE_WORDS:
                break
            name = (_text(words[at], size) + _text(words[at + 1], size)).strip()
            numeric = _text(words[at + 2], size).strip().upper()[:1] != "A"
            default = numbers[at + 6] if numeric else _text(words[at + 6], size)
            fields.append(Field(name, numeric, int(numbers[at + 3]), int(numbers[at + 4]) or 1, default))
        if fields and fields[0].name and fields[0].name.isprintable():
            return Header(size, order, fields, int(numbers[25]), int(numbers[26]))
    raise ValueError("not a paged binary table")


def _texts(cells: np.ndarray, parts: list[Field], size: int) -> pa.Array:
    """Text of every record; each distinct word is decoded once."""
    out = np.full(len(cells), "", object)
    for f in parts:
        if f.stored_word:
            words, at = np.unique(np.ascontiguousarray(cells[:, f.stored_word - 1]).view(f"V{size}"), return_inverse=True)
            out = out + np.array([_text(w.tobytes(), size) for w in words], object)[at.reshape(-1)]
        else:
            out = out + str(f.default)
    return pa.array([t.strip() or None for t in out], pa.string())


def decode_pages(content: bytes, header: Header, first: int, count: int, names: list[str] | None = None) -> dict[str, pa.Array]:
    """Columns of the ``count`` pages that ``content`` begins with, the first being page ``first`` of the file (data pages count from 1).

    Where content ends inside a page, the page gives the records that it holds.
    """
    size, per, width = header.word, header.per_page, header.record_words
    raw = np.frombuffer(content[: len(content) // size * size], np.dtype((np.void, size)))
    rows = []
    for p in range(count):
        at = p * PAGE_WORDS
        wanted = per if first + p < header.last_page - 1 else header.last_record
        have = max(0, min(wanted, (len(raw) - at) // width)) if width else 0
        rows.append(raw[at : at + have * width].reshape(have, width))
    cells = np.concatenate(rows) if rows else np.zeros((0, width), np.dtype((np.void, size)))
    out = {}
    for name, parts in header.columns().items():
        if names is not None and name not in names:
            continue
        if parts[0].numeric:
            f = parts[0]
            v = np.ascontiguousarray(cells[:, f.stored_word - 1]).view(f"{header.order}f{size}").astype(float) if f.stored_word else np.full(len(cells), float(f.default))
            out[name] = pa.array(v, mask=~(np.abs(v) <= MISSING))
        else:
            out[name] = _texts(cells, parts, size)
    return out


#: Bytes that one task reads of a file, a whole number of pages of either size, and pages decoded at a time.
PARTITION_BYTES, BATCH_PAGES = 64 << 20, 1024
#: Ranges above which they become larger than was asked for, up to ``PARTITION_BYTES``: a task costs more than to read a few pages.
MOST_RANGES = 256


@dataclass
class Range(InputPartition):
    path: str
    first: int
    end: int


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with the options ``path``, a file or a folder, and ``partitionBytes``.  A schema given by the user picks columns."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no file at {self.options['path']}")
        with opened(files[0][0]) as file:
            columns = read_header(file.read(PAGE_WORDS * 8)).columns()
        return ", ".join(f"`{n}` {'double' if f[0].numeric else 'string'}" for n, f in columns.items())

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options["path"], int(self.options.get("partitionbytes", PARTITION_BYTES)), [f.name for f in schema.fields])


    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PagedWriter(self.options["path"], int(self.options.get("word", 8)), int(self.options.get("textwords", 4)), schema, overwrite)


class PagedReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, names: list[str]):
        self.path, self.names = path, names
        self.bytes = max(1, partition_bytes // (PAGE_WORDS * 8)) * PAGE_WORDS * 8

    def partitions(self) -> list[Range]:
        files, page = listed(self.path), PAGE_WORDS * 8
        even = -(-sum(length for _, length in files) // (MOST_RANGES * page)) * page
        size = max(self.bytes, min(even, PARTITION_BYTES))
        return [Range(path, a, a + size) for path, length in files for a in range(0, max(length, 1), size)]

    def read(self, partition: Range):
        """The pages that begin inside the range.  Beyond the end of a truncated file there is nothing; its last page gives what it holds."""
        with opened(partition.path) as file:
            header = read_header(file.read(PAGE_WORDS * 8))
            page = PAGE_WORDS * header.word
            last = min(max(header.last_page, 2), partition.end // page)
            for first in range(max(1, partition.first // page), last, BATCH_PAGES):
                count = min(BATCH_PAGES, last - first)
                file.seek(first * page)
                content = file.read(count * page)
                if not content:
                    return
                found = decode_pages(content, header, first, -(-len(content) // page), self.names)
                yield pa.RecordBatch.from_arrays([found[n] for n in self.names], names=self.names)


#: Where the header has its numbers of fields, pages and records of the last page, and what stands for a missing number.
FIELDS_AT, LAST_PAGE_AT, LAST_RECORD_AT, NONE = 24, 25, 26, -1e30


class PagedWriter(DataSourceArrowWriter):
    """A file for every task.  Numbers become words, texts ``text_words`` words of four characters, cut there; missing values stay missing."""

    def __init__(self, path: str, word: int, text_words: int, schema: StructType, overwrite: bool):
        self.path, self.word, self.overwrite = path, word, overwrite
        self.fields = [(f.name, isinstance(f.dataType, NumericType), 1 if isinstance(f.dataType, NumericType) else text_words) for f in schema.fields]
        width, places = sum(n for _, _, n in self.fields), (PAGE_WORDS - HEADER_WORDS) // FIELD_WORDS
        if word not in (4, 8) or not 1 <= width <= min(places, RECORD_WORDS):
            raise ValueError(f"records of {width} words do not fit a header of {places} fields of 4 or 8 bytes")
        if any(len(name) > 8 for name, _, _ in self.fields):
            raise ValueError("names have eight characters at most")
        self.width, self.per_page = width, RECORD_WORDS // width
        prepared_folder(path, overwrite)

    def _words(self, texts: list[str], words: int) -> np.ndarray:
        raw = b"".join((t or "").encode("latin-1", "replace")[: 4 * words].ljust(4 * words) for t in texts)
        four = np.frombuffer(raw, "V4").reshape(-1, words)
        if self.word == 4:
            return four
        out = np.full((len(four), words, 8), ord(" "), np.uint8)
        out[:, :, :4] = four.view(np.uint8).reshape(len(four), words, 4)
        return out.view("V8").reshape(-1, words)

    def _header(self, records: int) -> bytes:
        number = np.dtype(f"<f{self.word}")
        num = lambda x: np.array([x], number).view(f"V{self.word}")
        out = np.zeros(PAGE_WORDS, number).view(f"V{self.word}").copy()
        pages = -(-records // self.per_page)
        for at, x in ((FIELDS_AT, self.width), (LAST_PAGE_AT, pages + 1), (LAST_RECORD_AT, records - (pages - 1) * self.per_page)):
            out[at : at + 1] = num(x)
        at, stored = HEADER_WORDS, 0
        for name, numeric, words in self.fields:
            for part in range(words):
                stored += 1
                out[at : at + 2] = self._words([name], 2)[0]
                out[at + 2 : at + 3] = self._words(["N" if numeric else "A"], 1)[0]
                out[at + 3 : at + 4], out[at + 4 : at + 5] = num(stored), num(part + 1)
                at += FIELD_WORDS
        return out.tobytes()

    def write(self, batches) -> Written:
        """Pages go out as they fill; the header, which tells how many there are, is written with the first bytes of a second pass over the draft."""
        held, records, message = np.zeros((0, self.width), f"V{self.word}"), 0, drafted(self.path, ".dm")
        body = f"{message.draft}.body"
        with created(body) as out:
            for batch in batches:
                cells = []
                for (_, numeric, words), column in zip(self.fields, batch.columns):
                    if numeric:
                        v = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
                        cells.append(np.where(np.isfinite(v), v, NONE).astype(f"<f{self.word}").view(f"V{self.word}").reshape(-1, 1))
                    else:
                        cells.append(self._words(column.to_pylist(), words))
                held = np.concatenate([held, np.concatenate(cells, 1)])
                records += batch.num_rows
                whole = len(held) // self.per_page * self.per_page
                out.write(self._pages(held[:whole]))
                held = held[whole:]
            if len(held):
                out.write(self._pages(held))
        if records:
            with created(message.draft) as out, opened(body) as pages:
                out.write(self._header(records))
                while chunk := pages.read(1 << 20):
                    out.write(chunk)
        settled([Written(body, None)], False)
        return message if records else Written(None, None)

    def _pages(self, cells: np.ndarray) -> bytes:
        pages = -(-len(cells) // self.per_page)
        out = np.zeros((pages * self.per_page, self.width), f"V{self.word}")
        out[: len(cells)] = cells
        full = np.zeros((pages, PAGE_WORDS), f"V{self.word}")
        full[:, : self.per_page * self.width] = out.reshape(pages, self.per_page * self.width)
        return full.tobytes()

    def commit(self, messages) -> None:
        settled(messages, True)

    def abort(self, messages) -> None:
        settled(messages, False)


def write_paged(df: DataFrame, path: str, word: int = 8, text_words: int = 4, overwrite: bool = False) -> None:
    """Write a table of numbers and texts as a folder of paged binary files, one from each task; files appear when all tasks are done."""
    df.sparkSession.dataSource.register(PagedSource)
    df.write.format("paged").option("word", word).option("textWords", text_words).mode("overwrite" if overwrite else "append").save(path)


def read_paged(spark: SparkSession, path: str, columns: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A paged binary file, or a folder of files of one layout, as a typed table; ``columns`` reads only those.

    Tasks read ranges of about ``partition_bytes``; of tables of more than ``MOST_RANGES`` such ranges, larger ones up to 64 MB.  A file that ends before its header says, inside a page or between two, gives the records
    that it holds, whatever its size.
    """
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("partitionBytes", partition_bytes)
    if columns is not None:
        kinds = {f.name: f for f in reader.load(path).schema.fields}
        reader = reader.schema(StructType([kinds[c] for c in columns]))
    return reader.load(path)
