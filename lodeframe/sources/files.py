"""Files of any store as seekable inputs, for readers that take byte ranges instead of whole files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/", path):
        path = "file:///" + path.split(":", 1)[1].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, keep: Callable[[str], bool] = lambda name: True) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder in order of name; hidden ones are passed over."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name[0] not in "._" and keep(i.base_name)]
    return [(prefix + i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


def opened(path: str):
    """A seekable input; only what is asked for is read."""
    system, inner = located(path)
    return system.open_input_file(inner)


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its file, and what it is called once all tasks are done; a task without rows has none."""

    draft: str | None
    final: str | None


def drafted(folder: str, ending: str) -> Written:
    """Names for a task's file: hidden while it is written, so that a task that is lost or run twice leaves nothing to be read."""
    name = f"part-{uuid.uuid4().hex}{ending}"
    return Written(f"{folder.rstrip('/')}/.{name}", f"{folder.rstrip('/')}/{name}")


def prepared_folder(folder: str, overwrite: bool) -> None:
    system, inner = located(folder)
    if overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
        system.delete_dir_contents(inner)
    system.create_dir(inner, recursive=True)


def created(path: str):
    system, inner = located(path)
    return system.open_output_stream(inner)


def settled(messages: list[Written | None], keep: bool) -> None:
    """Give the files of finished tasks their names, or delete them."""
    for m in messages:
        if m is not None and m.draft:
            system, inner = located(m.draft)
            if keep:
                system.move(inner, located(m.final)[1])
            else:
                system.delete_file(inner)
