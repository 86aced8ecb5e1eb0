"""License scans by an exact set-similarity join of text blocks and license templates.

A block is any run of words, wherever the lines break, that is no longer than the template's words divided by
``THRESHOLD``; it matches if it holds the share ``THRESHOLD`` of the template's different tokens. Tokens are ordered by
their frequency over all documents, rarest first. A text can hold a match only if it has one of the template's first
|T| - ceil(share * |T|) + 1 tokens, so only these are indexed (prefix filter). A text with fewer different words than
ceil(share * |T|) is passed over (length filter), as is one whose rarest common token stands so far back that too few
are left (positional filter). What remains is counted exactly, by two pointers over the template's tokens in the text.
``matches`` lists the blocks of every template, one for those that lie in each other; for ``labels`` a block doesn't
count that lies in a block which holds more of another template, or as much of a larger one.

Besides, the places of three fixed phrases are counted exactly; their labels always stay.

Defined cases: a null text counts as empty: no words, no places, no labels, score 0; texts of any length are read
whole; repeated rows repeat; an empty table stays empty. Columns of the input stay, but those named like a result are
replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from umbra.llm.common import slices, table
from umbra.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: More templates than this are refused: they are broadcast.
MAX_TEMPLATES = 10_000
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Bytes of words as they are (capitals as small letters), all others as spaces.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


@dataclass(frozen=True, slots=True)
class Match:
    """A block, as its first and last word's places, and the share of the template's tokens that stand in it."""

    template: int
    first: int
    last: int
    share: float


class Templates:
    """The index over the templates' prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int]):
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(words_of(text)) for _, text in templates]
        self.least = [ceil(THRESHOLD * len(s) - 1e-9) for s in self.sets]
        self.most = [floor(len(words_of(text)) / THRESHOLD + 1e-9) for _, text in templates]
        self.index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, s in enumerate(self.sets):
            for k, token in enumerate(sorted(s, key=lambda x: (frequency.get(x, 0), x))[: len(s) - self.least[t] + 1]):
                self.index[token].append((t, k))
        self.seeds = frozenset(self.index)
        self.tokens = frozenset().union(*self.sets)

    def candidates(self, block: frozenset[bytes]) -> list[int]:
        """The templates that a block of these tokens, or a part of it, can hold: prefix, positional and length filter."""
        first: dict[int, int] = {}
        for token in self.seeds & block:
            for t, k in self.index[token]:
                first[t] = min(k, first.get(t, k))
        return sorted(t for t, k in first.items() if len(block) >= self.least[t] <= len(self.sets[t]) - k)

    def blocks(self, t: int, hits: list[tuple[int, bytes]]) -> Iterator[Match]:
        """The blocks that hold the template's share, from the text's hits (place, token).

        Two pointers go over the hits: the longest block that begins at each, cut to the hit that completes it. Of two
        of which one lies in the other, the one with the higher share is given, of equal shares the inner one.
        """
        own, least, most = self.sets[t], self.least[t], self.most[t]
        hits = [x for x in hits if x[1] in own]
        inside: dict[bytes, int] = defaultdict(int)
        end, best = 0, None
        for k, (first, token) in enumerate(hits):
            while end < len(hits) and hits[end][0] - first < most:
                inside[hits[end][1]] += 1
                end += 1
            last = self._completed(hits, k, end, len(inside)) if len(inside) >= least else None
            if last is not None:
                found = Match(t, first, last, len(inside) / len(own))
                if best is None or found.last > best.last:
                    if best:
                        yield best
                    best = found
                elif found.share >= best.share:
                    best = found
            inside[token] -= 1
            if not inside[token]:
                del inside[token]
        if best:
            yield best

    def _completed(self, hits: list[tuple[int, bytes]], k: int, end: int, size: int) -> int | None:
        """The place of the hit with which ``size`` different tokens have been met from hit ``k`` on.

        None if the first token comes again before, as then a block that begins later holds as much.
        """
        met = set()
        for x in range(k, end):
            place, token = hits[x]
            if x > k and token == hits[k][1]:
                return None
            met.add(token)
            if len(met) == size:
                return place
        return None

    def matches(self, words: list[bytes]) -> list[Match]:
        """All templates' blocks in a text, by their places."""
        present = frozenset(words) if not self.seeds.isdisjoint(words) else frozenset()
        wanted = [t for t in self.candidates(present) if len(self.sets[t] & present) >= self.least[t]]
        if not wanted:
            return []
        hits = [(k, word) for k, word in enumerate(words) if word in self.tokens]
        return sorted((m for t in wanted for m in self.blocks(t, hits)), key=lambda m: (m.first, m.last, m.template))

    def named(self, matches: list[Match]) -> set[str]:
        """The labels of matches, but not of a block that lies in one which holds more of another template.

        Of equal shares the larger template's counts, so a notice of one licence isn't one of its near relatives too.
        """
        grade = lambda m: (round(m.share, 9), len(self.sets[m.template]))
        labels, open_ = set(), []
        for m in sorted(matches, key=lambda m: (m.first, -m.last, *(-x for x in grade(m)))):
            open_ = [x for x in open_ if x.last >= m.first]
            if not any(x.last >= m.last and grade(x) > grade(m) for x in open_):
                labels.add(self.labels[m.template])
            if not any(x.last >= m.last and grade(x) >= grade(m) for x in open_):
                open_.append(m)
        return labels


def places(words: list[bytes], phrase: str) -> list[int]:
    """The word positions, from 0, where the phrase's words stand one after the other."""
    whole, wanted = b" " + b" ".join(words) + b" ", b" " + phrase.encode() + b" "
    out, at = [], whole.find(wanted)
    while at >= 0:
        out.append(whole.count(b" ", 0, at))
        at = whole.find(wanted, at + 1)
    return out


def scan_text(text: str | None, templates: Templates) -> tuple:
    words = words_of(text)
    base, at = set(), []
    if b"license" in words:
        for phrase, label in PHRASES:
            if some := places(words, phrase):
                base.add(label)
                at += some
    found = templates.matches(words)
    labels = base | templates.named(found)
    score = max([float(bool(base)), *(m.share for m in found)])
    listed = [{"label": templates.labels[m.template], "first": m.first, "last": m.last, "share": m.share} for m in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, listed


def token_frequency(df: DataFrame, tokens: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many of all documents each of the templates' tokens stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for value in batch.column("_text").to_pylist():
                for token in tokens.intersection(words_of(value)):
                    total[token] += 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["token", "n"])

    counted = df.select(F.col(text).alias("_text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in counted.collect()}  # one row a token of the templates at most


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text") -> DataFrame:
    """``df`` with the words, places, labels, score and matches (label, first and last word, share) of each whole text."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    frequency = token_frequency(df, frozenset().union(*(words_of(t) for _, t in templates)), text)
    shared = df.sparkSession.sparkContext.broadcast((templates, frequency))
    listed = "array<struct<label:string,first:bigint,last:bigint,share:double>>"
    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("matches", listed)]
    match = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), listed: pa.list_(match)}
    kept = [x for x in df.columns if x not in dict(fields)]
    schema = df.select(kept).schema
    for name, kind in fields:
        schema = schema.add(name, kind if kind != listed else StructType.fromDDL(f"x {listed}")["x"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(*shared.value)
        for batch in slices(batches):
            made = list(zip(*(scan_text(x, index) for x in batch.column(text).to_pylist()), strict=True)) or [()] * len(fields)
            arrays = [pa.array(values, kinds[kind]) for values, (_, kind) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, *dict(fields)])

    return df.mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "matches")
