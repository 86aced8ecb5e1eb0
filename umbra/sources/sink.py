"""Files as a sink: targets are checked before any work, and a file appears whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from umbra.sources.lists import output_name


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def check_target(path: str, inputs: list[str], force: bool = False) -> str:
    """``path`` if a file may be written there: not onto an input or a folder, and onto a file only by force."""
    system, place = _open(path)
    if any(_open(x)[1] == place for x in inputs):
        raise ValueError(f"{path} is an input")
    found = system.get_file_info(place).type
    if found == fs.FileType.Directory:
        raise ValueError(f"{path} is a folder")
    if found == fs.FileType.File and not force:
        raise ValueError(f"{path} exists")
    folder = place.rpartition("/")[0]
    if folder and system.get_file_info(folder).type != fs.FileType.Directory:
        raise ValueError(f"the folder of {path} does not exist")
    return path


def plan_outputs(inputs: list[str], suffix: str = "_redacted", output: str | None = None, force: bool = False) -> dict[str, str]:
    """The target of every input, checked: next to it with a suffix, or ``output`` for a single one."""
    if output is not None and len(inputs) != 1:
        raise ValueError("one output for several inputs")
    plan = {x: output if output is not None else output_name(x, suffix) for x in inputs}
    if len(set(plan.values())) < len(plan):
        raise ValueError("two inputs have one output")
    for target in plan.values():
        check_target(target, inputs, force)
    return plan


def write_whole(path: str, content: bytes, force: bool = False) -> None:
    """Writes a file under another name beside its place and moves it there, so that none is ever seen in part."""
    system, place = _open(path)
    part = f"{place}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            out.write(content)
        if not force and system.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists")
        system.move(part, place)
    finally:
        if system.get_file_info(part).type == fs.FileType.File:
            system.delete_file(part)


def write_files(files: DataFrame, force: bool = False) -> DataFrame:
    """(path, bytes, error) of files (path, content), each written whole; what can't be written doesn't stop the others.

    A task that runs again writes the same bytes again, so a file that holds them already is no error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, errors = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                error = None
                try:
                    system, place = _open(path)
                    there = system.get_file_info(place)
                    same = there.type == fs.FileType.File and there.size == len(content or b"") and system.open_input_stream(place).read() == (content or b"")
                    if not same:
                        write_whole(path, content or b"", force)
                except (ValueError, OSError, pa.ArrowException) as e:
                    error = str(e)
                paths.append(path)
                sizes.append(None if error else len(content or b""))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["path", "bytes", "error"])

    return files.select("path", "content").mapInArrow(work, "path string, bytes long, error string")
