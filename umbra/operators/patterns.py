"""Detection of identifiers by context-sensitive patterns.

A pattern may have the groups ``target`` (what is protected; else the whole match) and ``context`` (a word before it
that makes the match trustworthy). Spark finds all matches but not where they are, so every match is rewritten with
marks around prefix and target; the text between the marks gives the positions, without leaving the JVM.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import validators
from umbra.functions.arrays import let, running_totals
from umbra.sources.runs import span_rect

DEFAULT_MIN_CONFIDENCE, VALIDATED = 0.5, 0.99


@dataclass(frozen=True)
class Pattern:
    id: str
    regex: str
    description: str = ""
    confidence: float = 0.8
    confidence_without_context: float | None = None
    enabled: bool = True
    validator: str | None = None


def _with_context(words: str, target: str) -> str:
    return rf"(?:(?<context>{words})[:.]?[ \t]*(?:[^\S \t][ \t]*){{0,4}})?(?<target>{target})"


# The expressions and confidences of the twelve built-in patterns.
BUILTIN = [
    Pattern("iban_de", r"(?<![0-9A-Za-z])(?i:DE)\s?[0-9]{2}(?:\s{0,2}[0-9]){18}(?![0-9])", "German IBAN", 0.95, None, True, "iban"),
    Pattern("iban_intl", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\s{0,2}[0-9A-Z]){11,30}(?![0-9A-Za-z])", "IBAN of any country", 0.9, None, False, "iban"),
    Pattern("glaeubiger_id", r"(?<![0-9A-Za-z])(?i:[A-Z]{2}[0-9]{2}[0-9A-Z]{3}[0-9A-Z]{6,28})(?![0-9A-Za-z])", "SEPA creditor identifier", 0.95, None, True, "creditor_id"),
    Pattern(
        "konto_nr",
        _with_context(
            r"(?i:[a-zäöüß]{0,24}konto(?:nummer|[- ]?(?:nr\.?|nummer))?|kto\.?(?:-?nr\.?)?)",
            r"(?<![0-9A-Za-z])(?:[0-9]{4,10}(?:\s[0-9]{2,6})+|[0-9]{6,10})(?![0-9A-Za-z])",
        ),
        "account number after a keyword", 0.85, 0.3,
    ),
    Pattern("blz", _with_context(r"(?i:blz|bankleitzahl)", r"(?<![0-9A-Za-z])(?:[0-9]{8}|[0-9]{3}\s[0-9]{3}\s[0-9]{2})(?![0-9A-Za-z])"), "bank code after a keyword", 0.8, 0.25),
    Pattern(
        "bic",
        _with_context(
            r"(?i:bic(?:[ ]?/[ ]?swift)?(?:-?code)?|swift(?:-?code)?)|(?=[A-Z]{6}[A-Z0-9]{0,4}[0-9][A-Z0-9]{0,4}\b|[A-Z]{8}XXX\b)",
            r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
        ),
        "BIC after a keyword, with a digit or with XXX", 0.8, 0.3, True, "bic",
    ),
    Pattern("amount_eur", r"(?<![0-9.,])[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2} ?(?:€|EUR)(?![A-Za-z])", "amount in euros", 0.7, None, False),
    Pattern("date_de", r"\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b", "German date", 0.6, None, False),
    Pattern(
        "credit_card",
        r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\s-][0-9]{4}){3}(?:[\s-][0-9]{3})?|[0-9]{4}[\s-][0-9]{6}[\s-][0-9]{4,5})(?![0-9A-Za-z])",
        "payment card number", 0.9, None, True, "luhn",
    ),
    Pattern(
        "steuer_id",
        _with_context(
            r"(?i:steuer-?(?:id|nr\.?|nummer|identifikationsnummer)|steuerliche[ ]+identifikationsnummer|identifikationsnummer|id-?nr\.?)",
            r"(?<![0-9A-Za-z])(?:[0-9]{11}|[0-9]{2}\s[0-9]{3}\s[0-9]{3}\s[0-9]{3})(?![0-9A-Za-z])",
        ),
        "tax number after a keyword", 0.9, 0.25,
    ),
    Pattern("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])", "e-mail address", 0.9),
    Pattern(
        "phone_de",
        _with_context(
            r"(?i:telefonnummer|telefon|tel\.?|mobil|handy|fax|fon)|(?=\+49|0049)",
            r"(?<![0-9A-Za-z+])(?:(?:\+49|0049)[ /-]?(?:\(0\)[ /-]?)?[1-9][0-9 /-]{5,14}[0-9]|0[1-9][0-9 /-]{5,14}[0-9]|\(0[1-9][0-9]{1,4}\)[ /-]?[0-9][0-9 /-]{3,12}[0-9])(?![0-9A-Za-z])",
        ),
        "German telephone number", 0.85, 0.35,
    ),
]
IDS = [p.id for p in BUILTIN]


def select(ids: list[str]) -> list[Pattern]:
    """The named built-in patterns, switched on; all of them as they are if none is named."""
    if not ids:
        return list(BUILTIN)
    known = {p.id: p for p in BUILTIN}
    for name in ids:
        if name not in known:
            raise ValueError(f"unknown pattern {name!r}; known: {', '.join(IDS)}")
    return checked([replace(known[name], enabled=True) for name in ids])


def without(patterns: list[Pattern], ids: list[str]) -> list[Pattern]:
    """``patterns`` with the named ones switched off."""
    for name in ids:
        if name not in {p.id for p in patterns}:
            raise ValueError(f"unknown pattern {name!r}")
    return [replace(p, enabled=p.enabled and p.id not in ids) for p in patterns]


def resolve(config: dict) -> list[Pattern]:
    """Built-in patterns merged with a configuration: fields given replace others, a null takes a weak confidence or validator away."""
    unknown = set(config) - {"extend_builtins", "min_confidence", "patterns"}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = {p.id: p for p in BUILTIN} if config.get("extend_builtins", True) else {}
    for entry in config.get("patterns", []):
        name = (entry.get("id") or "").strip()
        if not name:
            raise ValueError("a pattern without an id")
        unknown = set(entry) - set(Pattern.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown keys of {name!r}: {sorted(unknown)}")
        if name not in out and not entry.get("regex"):
            raise ValueError(f"the new pattern {name!r} needs a regex")
        nullable = ("confidence_without_context", "validator")
        given = {k: v for k, v in entry.items() if k != "id" and (v is not None or k in nullable)}
        out[name] = replace(out.get(name, Pattern(name, "")), **given)
    return checked(list(out.values()))


def load_config(path: str, text: str) -> dict:
    """A configuration from YAML (by the name's ending; a plain subset) or else JSON."""
    if path.lower().endswith((".yaml", ".yml")):
        from umbra.sources.lists import plain_yaml

        return plain_yaml(text)
    return json.loads(text)


def checked(patterns: list[Pattern]) -> list[Pattern]:
    if len({p.id for p in patterns}) < len(patterns):
        raise ValueError("a pattern id comes twice")
    for p in patterns:
        if not 0 <= p.confidence <= 1 or not 0 <= (p.confidence_without_context or 0) <= 1:
            raise ValueError(f"the confidence of {p.id!r} is not between 0 and 1")
        if p.confidence_without_context is not None and "(?<context>" not in p.regex and "(?P<context>" not in p.regex:
            raise ValueError(f"{p.id!r} has a confidence without context but no context group")
        if p.validator is not None and p.validator not in validators.VALIDATORS:
            raise ValueError(f"unknown validator {p.validator!r}")
    return patterns


def _parts(regex: str) -> tuple[str, str, str]:
    """(before, target, after) of an expression; the target group must not stand inside another one."""
    regex = regex.replace("(?P<", "(?<")
    at = regex.find("(?<target>")
    if at < 0:
        return "", regex, ""
    depth, k, in_class = 0, at, False
    while k < len(regex):
        c = regex[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                break
        k += 1
    before = regex[:at]
    if len(re.findall(r"(?<!\\)\((?!\?[:=!<])", before)) and before.count("(") != before.count(")"):
        raise ValueError("the target group stands inside another group")
    return before, regex[at + len("(?<target>") : k], regex[k + 1 :]


def hits_of(pattern: Pattern, text: Column) -> Column:
    """All hits of one pattern in a line, as an array of (start, text, has_context)."""
    before, target, after = _parts(pattern.regex)
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002\u0003", "   "), rf"(?U)(?<pre>{before})(?<target>{target})(?<post>{after})", "\u0003${pre}\u0001${target}\u0002${post}")
    shape = re.search(r"\|(\(\?=.*?\))\)\[:\.\]\?", before) if "(?<context>" in before else None

    def hit(pieces: Column, totals: Column, k: Column) -> Column:
        # Before hit k stand k pieces with one mark of the third kind each and k - 1 of the second.
        ahead = F.get(totals, k - 1) - 2 * k + 1
        found = F.substring_index(F.get(pieces, k), "\u0002", 1)
        lead = F.length(found) - F.length(F.regexp_replace(found, r"(?U)^\s+", ""))
        named = ~F.get(pieces, k - 1).endswith("\u0003") if "(?<context>" in before else F.lit(False)
        if shape:
            named = named | found.rlike("(?U)^" + shape[1])
        return F.struct((ahead + lead).alias("start"), F.regexp_replace(found, r"(?U)^\s+|\s+$", "").alias("text"), named.alias("has_context"))

    def hits(pieces: Column) -> Column:
        totals = running_totals(F.transform(pieces, F.length))
        every = let(totals, lambda t: F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: hit(pieces, t, k)))
        return F.when(F.size(pieces) > 1, F.filter(every, lambda h: h["text"] != ""))

    return let(F.split(marked, "\u0001"), hits)


def confidence_of(pattern: Pattern, text: Column, has_context: Column) -> Column:
    """A hit's confidence; null where a validator rejects it. A passed one lifts it, unless the context is missing."""
    weak = F.lit(False) if pattern.confidence_without_context is None else ~has_context
    base = F.when(weak, F.lit(pattern.confidence_without_context)).otherwise(F.lit(pattern.confidence))
    if pattern.validator is None:
        return base
    lifted = F.when(weak, base).otherwise(F.greatest(base, F.lit(VALIDATED)))
    return F.when(validators.VALIDATORS[pattern.validator](text), lifted)


def find(runs: DataFrame, patterns: list[Pattern] | None = None, min_confidence: float = DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """Regions (doc_id, page, run_seq, def_seq, start, pattern_id, confidence, text and rectangle) of all hits.

    ``def_seq`` is the pattern's place in the list; ordered by run, def_seq and start the hits are in reading order.
    Disabled patterns take no part in the plan. All patterns share one scan of the lines.
    """
    if not 0 <= min_confidence <= 1:
        raise ValueError("the least confidence must be between 0 and 1")
    patterns = checked(list(BUILTIN if patterns is None else patterns))
    def located(k: int, p: Pattern):
        return lambda h: F.struct(
            F.lit(k).alias("def_seq"), F.lit(p.id).alias("pattern_id"), h["start"].cast("long").alias("start"), h["text"].alias("hit"), confidence_of(p, h["text"], h["has_context"]).alias("confidence")
        )

    found = [F.transform(hits_of(p, F.col("text")), located(k, p)) for k, p in enumerate(patterns) if p.enabled]
    empty = F.array().cast("array<struct<def_seq:int,pattern_id:string,start:bigint,hit:string,confidence:double>>")
    every = F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())) if found else empty
    opened = runs.select("doc_id", "page", "run_seq", "lly", F.inline_outer(F.filter(every, lambda h: h["confidence"] >= min_confidence)))
    # The outer form keeps the optimiser from searching each line a second time, for a filter on the number of hits.
    opened = opened.where(F.col("pattern_id").isNotNull())
    return opened.select("doc_id", "page", "run_seq", "def_seq", "start", "pattern_id", "confidence", F.col("hit").alias("text"), *span_rect(F.col("start"), F.length("hit"), F.col("lly")))


def notice(patterns: list[Pattern]) -> str:
    """Which patterns a run does not search for."""
    off = [p.id for p in patterns if not p.enabled]
    return f"not searched for: {', '.join(off)}" if off else "all patterns are searched for"


def listing(spark, patterns: list[Pattern] | None = None) -> DataFrame:
    rows = [(p.id, p.enabled, float(p.confidence), p.description) for p in (BUILTIN if patterns is None else patterns)]
    return spark.createDataFrame(rows, "pattern_id string, enabled boolean, confidence double, description string")
