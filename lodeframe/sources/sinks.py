"""Sinks: formatted text tables, bounding boxes and archives of small tables."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite


@dataclass
class TextFormat:
    """How a text table is written."""

    delimiter: str = ","
    quote: str = '"'
    line_end: str = "\n"
    null: str = ""
    precision: int | None = None
    decimal: str = "."
    header: bool = True
    comments: tuple[str, ...] = ()


def _field(c: Column, kind: str, fmt: TextFormat) -> Column:
    if kind in ("double", "float"):
        d = finite(c)
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        text = F.format_string(f"%.{fmt.precision}f", d) if fmt.precision is not None else F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
        c = F.when(d.isNotNull(), text if fmt.decimal == "." else F.replace(text, F.lit("."), F.lit(fmt.decimal)))
    c = F.coalesce(c.cast("string"), F.lit(fmt.null))
    special = F.contains(c, F.lit(fmt.delimiter)) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    if fmt.quote:
        special = special | F.contains(c, F.lit(fmt.quote))
        c = F.when(special, F.concat(F.lit(fmt.quote), F.replace(c, F.lit(fmt.quote), F.lit(fmt.quote * 2)), F.lit(fmt.quote))).otherwise(c)
    return c


def text_lines(df: DataFrame, columns: dict[str, str] | None = None, fmt: TextFormat | None = None) -> DataFrame:
    """(value): one line per row; columns: source column -> name in the header, in the order of output."""
    fmt, columns = fmt or TextFormat(), columns or {c: c for c in df.columns}
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws(fmt.delimiter, *[_field(F.col(f"`{c}`"), kinds[c], fmt) for c in columns]).alias("value"))


def header_lines(columns: list[str], fmt: TextFormat) -> list[str]:
    quoted = [f"{fmt.quote}{c.replace(fmt.quote, fmt.quote * 2)}{fmt.quote}" if fmt.quote and any(x in c for x in (fmt.delimiter, fmt.quote, "\n", "\r")) else c for c in columns]
    return [f"# {c}" for c in fmt.comments] + ([fmt.delimiter.join(quoted)] if fmt.header else [])


def write_text(df: DataFrame, path: str, columns: dict[str, str] | None = None, fmt: TextFormat | None = None, single: bool = False) -> None:
    """Write part files of a text table; comments and header open every part file, so that each is a table of its own.

    single: one file, for small results only.
    """
    fmt, columns = fmt or TextFormat(), columns or {c: c for c in df.columns}
    lines = text_lines(df, columns, fmt)
    if single:
        lines = lines.coalesce(1)
    head = header_lines(list(columns.values()), fmt)

    def with_head(batches):
        first = True
        for batch in batches:
            if first and head:
                yield pa.RecordBatch.from_arrays([pa.array(head)], schema=batch.schema)
            first = False
            yield batch

    lines.mapInArrow(with_head, "value string").write.option("lineSep", fmt.line_end).text(path)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: TextFormat | None = None) -> None:
    """Several tables, such as those of a set of drillholes, each as text in a folder of its own name."""
    for name, df in tables.items():
        write_text(df, f"{path.rstrip('/')}/{name}", fmt=fmt)


def bounding_box_obj(df: DataFrame, axes: dict[str, str], padding: dict[str, float] | None = None) -> str:
    """Wavefront OBJ text of the box around all finite coordinates, padded by half a block per axis if given."""
    row = df.agg(*[f(finite(F.col(c))).alias(f"{k}{a}") for a, c in axes.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    pad = padding or {}
    ends = {a: (row["lo" + a] - pad.get(a, 0) / 2, row["hi" + a] + pad.get(a, 0) / 2) for a in axes}
    corners = [(x, y, z) for z in ends["z"] for y in ends["y"] for x in ends["x"]]
    faces = ((1, 3, 4, 2), (5, 6, 8, 7), (1, 2, 6, 5), (3, 7, 8, 4), (1, 5, 7, 3), (2, 4, 8, 6))
    return "".join(f"v {x:g} {y:g} {z:g}\n" for x, y, z in corners) + "".join("f " + " ".join(map(str, f)) + "\n" for f in faces)


def write_archive(path: str, files: dict[str, str | bytes]) -> None:
    """Pack small texts (recipes, report tables) into one zip file on the driver."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
