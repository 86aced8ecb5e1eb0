"""What a PDF file carries besides its drawn text: for the search for what should be gone, and for telling what was dropped.

Every file is one task's work, as with reading. A file that can't be read still gives its raw bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators import leaks
from umbra.sources.pdf import Damaged, Document, Lexer, Name, Operator, Ref, Stream, decode_string, scan, unpack

#: The keys of a trailer that a file needs; all others tell something about its making.
TRAILER = ("Size", "Root", "Prev", "Encrypt", "XRefStm")
_BROKEN = (Damaged, zlib.error, ValueError, KeyError, TypeError, RecursionError, IndexError)
SCHEMA = "carrier_id string, view int, content binary, text string"
_LITERAL = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]{2,}>", re.S)


def _strings(value) -> Iterator[tuple[int, str]]:
    """(view, text) of the strings and names in an object."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Stream):
            v = v.info
        if isinstance(v, Name):
            yield leaks.NAMES, str(v)
        elif isinstance(v, bytes):
            yield leaks.OBJECTS, decode_string(v)
        elif isinstance(v, dict):
            todo += [*map(Name, v), *v.values()]
        elif isinstance(v, list):
            todo += v


def raw_literals(data: bytes) -> Iterator[str]:
    """The strings that stand in bytes as literals or hex, whatever they belong to."""
    for m in _LITERAL.finditer(data):
        try:
            value = Lexer(m[0]).value()
        except _BROKEN:
            continue
        if isinstance(value, bytes) and value:
            yield decode_string(value)


def joined_literals(content: bytes) -> str:
    """All strings that a content stream shows, one behind the other, however they are parted."""
    lexer, out = Lexer(content), []
    while True:
        lexer.skip()
        if lexer.at >= len(content):
            return "".join(out)
        value = lexer.value()
        if isinstance(value, Operator):
            continue
        for part in value if isinstance(value, list) else [value]:
            if isinstance(part, bytes):
                out.append(decode_string(part))


def carriers_of(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(view, bytes, text) of all a file carries: its bytes and unpacked streams, and texts of every other view."""
    yield leaks.RAW, data, None
    for text in raw_literals(data):
        yield leaks.LITERALS, None, text
    try:
        document = Document(data)
    except _BROKEN:
        return
    for value in document.objects.values():
        if isinstance(value, Stream):
            try:
                body = unpack(document, value)
            except _BROKEN:
                body = value.raw
            yield leaks.STREAMS, body, None
        for view, text in _strings(value):
            yield view, None, text
    for view, text in _strings(document.trailer):
        yield view, None, text
    try:
        pages = document.pages()
    except _BROKEN:
        return
    for page in pages:
        try:
            yield leaks.JOINED, None, joined_literals(b"\n".join(document.content(page)))
            found = scan(document, page)
        except _BROKEN:
            continue
        yield leaks.DECODED, None, "".join(g["ch"] for g in found.glyphs)
        for text in found.marked:
            yield leaks.DECODED, None, text


def carriers(files: DataFrame) -> DataFrame:
    """(carrier_id, view, content, text) of files (path, content); ``content`` for bytes, ``text`` for decoded texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(carriers_of(data or b""))
                for at in range(0, len(rows), 1000):
                    view, content, text = zip(*rows[at : at + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(view)), pa.array(view, pa.int32()), pa.array(content, pa.binary()), pa.array(text, pa.string())], ["carrier_id", "view", "content", "text"])

    return files.select("path", "content").mapInArrow(work, SCHEMA)


def search(files: DataFrame, needles: list[str]) -> DataFrame:
    """(carrier_id, view, needle_id, literal): every view of the files in which a needle is found.

    Bytes are searched under every encoding, texts literally and without white space. The views are read once: they are
    written to the shared folder.
    """
    from umbra.plans.storage import cut

    held = cut(carriers(files))
    raw = leaks.search_bytes(held.where("content IS NOT NULL").select("carrier_id", "view", "content"), needles).select("carrier_id", "view", "needle_id", F.lit(True).alias("literal"))
    texts = leaks.search_text(held.where("text IS NOT NULL").select("carrier_id", "view", F.col("text").alias("content")), needles)
    return raw.unionByName(texts).groupBy("carrier_id", "view", "needle_id").agg(F.bool_or("literal").alias("literal"))


def tallies(data: bytes) -> dict[str, int]:
    """How many pieces of what tells about a file it has: all of these are dropped when it is written anew."""
    document = Document(data)
    get = document.get
    root = get(document.trailer.get("Root")) or {}

    def outline(value, seen: set) -> int:
        n = 0
        while isinstance(value, Ref) and value[0] not in seen:
            seen.add(value[0])
            item = get(value) or {}
            n += 1 + outline(item.get("First"), seen)
            value = item.get("Next")
        return n

    def named(tree, seen: set) -> int:
        tree = get(tree)
        if not isinstance(tree, dict) or id(tree) in seen:
            return 0
        seen.add(id(tree))
        return len(get(tree.get("Names")) or []) // 2 + sum(named(kid, seen) for kid in get(tree.get("Kids")) or [])

    dicts = [x.info if isinstance(x, Stream) else x for x in document.objects.values() if isinstance(x, (Stream, dict))]
    names = get(root.get("Names")) or {}
    return {
        "info": len(get(document.trailer.get("Info")) or {}),
        "metadata": sum("Metadata" in x for x in dicts),
        "outline": outline((get(root.get("Outlines")) or {}).get("First"), set()),
        "attachments": named(names.get("EmbeddedFiles"), set()) + sum(x.get("Subtype") == "FileAttachment" for x in dicts),
        "scripts": named(names.get("JavaScript"), set()) + sum(k in x for x in dicts for k in ("OpenAction", "AA")),
        "private": sum("PieceInfo" in x for x in dicts),
        "trailer": sum(k not in TRAILER and k != "Info" for k in document.trailer),
    }
