"""Small inputs that steer a run: booking lists, manual regions, settings, texts to look for.

They are read by the driver, with a limit on their size: they become literals or broadcast dimensions of a plan.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession

from umbra.functions import geometry as G
from umbra.operators.booking import Entry

MAX_AUXILIARY_BYTES, MAX_CONFIG_BYTES, MAX_INPUT_BYTES = 16 << 20, 1 << 20, 512 << 20
MAX_PAGE_EXTENT = 200_000.0
_TRUE, _FALSE = ("true", "1", "yes", "ja"), ("false", "0", "no", "nein")
#: The keys that a settings file may have.
SETTINGS = [
    "min_confidence", "padding", "action", "replace_with", "patterns", "disable_patterns", "booking_list", "max_candidates",
    "max_decompressed_mb", "max_parsed_mb", "max_image_mb", "max_input_mb", "output_suffix",
]


def read_bounded(spark: SparkSession, path: str, most: int = MAX_AUXILIARY_BYTES) -> bytes:
    """A whole file through Spark's file systems, or an error if it is larger than ``most``."""
    info = spark.read.format("binaryFile").load(path).select("length")
    sizes = [r.length for r in info.collect()]
    if len(sizes) != 1 or sizes[0] > most:
        raise ValueError(f"{path}: not one file of at most {most} bytes")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def booking_list(data: bytes) -> list[Entry]:
    """Entries of a CSV list; the columns' names in any case, further columns and blank rows are passed over."""
    text = data.removeprefix(b"\xef\xbb\xbf").decode()
    rows = csv.reader(io.StringIO(text))
    header = [h.strip().lower() for h in next(rows, [])]
    missing = [c for c in ("id", "list_type", "pattern") if c not in header]
    if missing:
        raise ValueError(f"line 1: missing columns {', '.join(missing)}")
    out, seen = [], set()
    for row in rows:
        cells = {h: (v.strip() or None) for h, v in zip(header, row, strict=False)}
        if not any(cells.values()):
            continue
        where = f"line {rows.line_num}"
        for need in ("id", "list_type", "pattern"):
            if not cells.get(need):
                raise ValueError(f"{where}: the column {need} is empty")
        kind, flag = cells["list_type"].lower(), (cells.get("is_regex") or "false").lower()
        if kind not in ("positive", "negative"):
            raise ValueError(f"{where}: unknown list type {cells['list_type']!r}")
        if flag not in _TRUE + _FALSE:
            raise ValueError(f"{where}: is_regex is neither true nor false")
        if cells["id"] in seen:
            raise ValueError(f"{where}: the id {cells['id']!r} comes twice")
        seen.add(cells["id"])
        out.append(Entry(cells["id"], kind, cells["pattern"], cells.get("context_before"), cells.get("context_after"), flag in _TRUE))
    return out


def manual_regions(spark: SparkSession, data: bytes) -> DataFrame:
    """(doc_id, item, page, reason, text, rectangle) of a JSON list of regions, the rectangles put the right way round."""
    rows = []
    for item, r in enumerate(json.loads(data)):
        page = r["page"]
        if not isinstance(page, int) or not 0 <= page < 1 << 32:
            raise ValueError(f"region {item}: {page!r} is no page")
        corners = [float(r["rect"][c][a]) for c in ("ll", "ur") for a in ("x", "y")]
        reason = (r.get("source") or {}).get("manual", {}).get("reason", "manual")
        rows.append((r.get("doc_id", 0), item, page, reason, r.get("text"), *corners))
    schema = "doc_id long, item int, page long, reason string, text string, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame(rows, schema)
    fixed = G.from_corners(df.x0, df.y0, df.x1, df.y1)
    return df.select("doc_id", "item", "page", "reason", "text", *fixed.named())


def needle_list(text: str) -> list[str]:
    return [line.strip() for line in text.splitlines() if line.strip()]


def plain_yaml(text: str) -> dict:
    """A strict small part of YAML: nested maps and lists by indentation, scalars, single or double quotes.

    Only ``true`` and ``false`` are booleans, and merge keys are ordinary keys.
    """
    rows = []
    for number, raw in enumerate(text.splitlines(), 1):
        body = re.sub(r"""^((?:[^'"#]|'[^']*'|"[^"]*")*?)(?:(?<!\S)#.*)?$""", r"\1", raw).rstrip()
        if body.strip() and body.strip() != "---":
            rows.append((len(body) - len(body.lstrip()), body.strip(), number))

    def scalar(s: str):
        if s.startswith('"'):
            return json.loads(s)
        if s.startswith("'"):
            return s[1:-1].replace("''", "'")
        if s in ("null", "~", ""):
            return None
        if s in ("true", "false"):
            return s == "true"
        if s == "[]":
            return []
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x.strip()) for x in s[1:-1].split(",")]
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    def block(at: int, depth: int):
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out = []
            while at < len(rows) and rows[at][0] == depth and rows[at][1].startswith("-"):
                inner = rows[at][1][1:].lstrip()
                shift = len(rows[at][1]) - len(inner)
                if re.match(r"[\w.-]+:(\s|$)", inner):
                    rows[at] = (depth + shift, inner, rows[at][2])
                    value, at = block(at, depth + shift)
                else:
                    value, at = scalar(inner), at + 1
                out.append(value)
            return out, at
        out = {}
        while at < len(rows) and rows[at][0] == depth:
            key, colon, rest = rows[at][1].partition(":")
            if not colon or key in out:
                raise ValueError(f"line {rows[at][2]} can't be read")
            at += 1
            if rest.strip():
                out[key] = scalar(rest.strip())
            elif at < len(rows) and (rows[at][0] > depth or rows[at][0] == depth and rows[at][1].startswith("- ")):
                out[key], at = block(at, rows[at][0])
            else:
                out[key] = None
        if at < len(rows) and rows[at][0] > depth:
            raise ValueError(f"line {rows[at][2]} is indented too far")
        return out, at

    if not rows:
        return {}
    value, at = block(0, rows[0][0])
    if at != len(rows):
        raise ValueError(f"line {rows[at][2]} can't be read")
    return value


def settings(text: str) -> dict:
    """A settings file's values, with unknown keys and values out of range as errors."""
    values = plain_yaml(text)
    unknown = sorted(set(values) - set(SETTINGS))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    if not 0 <= values.get("min_confidence", 0.5) <= 1:
        raise ValueError("min_confidence must be between 0 and 1")
    padding = values.get("padding", 1.0)
    if not math.isfinite(padding) or abs(padding) > MAX_PAGE_EXTENT:
        raise ValueError("the padding is out of range")
    return values


def output_name(path: str, suffix: str = "_redacted") -> str:
    """The path next to an input under which its result goes."""
    if not suffix or re.search(r"[/\\\x00-\x1f]|\.\.", suffix):
        raise ValueError(f"the suffix {suffix!r} can't be used")
    folder, slash, name = path.rpartition("/")
    stem, dot, ending = name.rpartition(".")
    return f"{folder}{slash}{stem or ending}{suffix}{dot if stem else ''}{ending if stem else ''}"


def gather(spark: SparkSession, paths: list[str], ending: str = ".pdf", suffix: str = "_redacted") -> list[str]:
    """Files of the given files and folders, sorted, without results of earlier runs."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(paths).select("path").collect()
    return sorted({r.path for r in found if not r.path[: -len(ending)].endswith(suffix)})
