"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded by itself. A segment tree over the piece's byte positions holds, for every
live position, the rank of the pair that starts there; its root is the leftmost smallest pair. A merge updates the
merged position and its left neighbour and clears the swallowed one, each in logarithmic time, so that a piece of n
bytes takes O(n log n) however long it is. The pieces of a batch of rows that have not been met before are merged in
step, one array operation doing the same update in all their trees.

Defined cases: a null text counts as empty and gives no ids; texts of any length are encoded whole; repeated rows give
repeated results; ids that are null, unknown to the vocabulary or cut off decode to null; an empty table gives an empty
result with the same columns. Columns of the input keep their names;
``ids_le`` and ``decoded`` replace input columns of those names.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import slices, table
from umbra.llm.text_hashes import give_back

#: Entries a worker remembers in each of two generations, and the characters of the longest key among
#: them, so that its memory is bounded.
REMEMBERED, LONGEST = 60_000, 64
#: Rows that are encoded together: the more, the fewer words are met again, but all their words are held at a time. The
#: query takes more, as it has its workers for itself.
ROWS, QUERY_ROWS = 500, 1000
#: Leaves of the segment trees that are merged in step, and the number of trees from which that is worth it.
TOGETHER, LEAST_TOGETHER = 1 << 17, 24
#: A vocabulary file larger than this is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
NONE = 1 << 62


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """Ids of one piece: pairs are joined by ascending rank, the leftmost first among equals.

    A piece that is a token by itself stays whole, unless ``whole`` is false.
    """
    if whole and piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    mask = (1 << shift) - 1
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for x in range(size - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a < b else b
    after = list(range(1, n + 2))
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        x = size + i
        tree[x] = value
        x >>= 1
        while x:
            a, b = tree[2 * x], tree[2 * x + 1]
            least = a if a < b else b
            if tree[x] == least:
                return
            tree[x] = least
            x >>= 1

    while (root := tree[1]) != NONE:
        i = root & mask
        gone = after[i]
        right = after[gone]
        after[i] = right
        put(gone, NONE)
        if right < n:
            before[right] = i
            rank = get(piece[i : after[right]])
            put(i, NONE if rank is None else rank << shift | i)
        else:
            put(i, NONE)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:right])
            put(left, NONE if rank is None else rank << shift | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairRanks:
    """Ranks of joined tokens by the two tokens' ids, in an open-addressed table that answers for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        keys, joined = self._key(np.array(left, np.int64), np.array(right, np.int64)), np.array(joined, np.int64)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.ranks[at[here]] = joined[here]
            keys, joined, at = keys[~here], joined[~here], (at[~here] + 1) & (len(self.keys) - 1)

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, or -1."""
        keys = self._key(left, right)
        at = self._slot(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.ranks[at], -1)
        open_ = np.flatnonzero((met != keys) & (met != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            met = self.keys[at[open_]]
            same = met == keys[open_]
            out[open_[same]] = self.ranks[at[open_[same]]]
            open_ = open_[~same & (met != -1)]
        return out


def merge_many(pieces: list[bytes], pairs: PairRanks) -> list[bytes]:
    """Ids of pieces of at least two bytes, as ``merge`` gives them: one segment tree a piece, all merged in step.

    All trees are as wide as the longest piece needs, so pieces of like length belong together.
    """
    count, n = len(pieces), np.array([len(p) for p in pieces])
    size = 1 << (int(n.max()) - 1).bit_length()
    shift = size.bit_length()
    raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(count, size)
    ids = pairs.single[raw]
    place = np.arange(size)
    tree = np.full((count, 2 * size), NONE, np.int64)
    first = pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size - 1)
    tree[:, size:-1] = np.where((first >= 0) & (place[1:] < n[:, None]), first << shift | place[:-1], NONE)
    x = size
    while x > 1:
        tree[:, x // 2 : x] = np.minimum(tree[:, x : 2 * x : 2], tree[:, x + 1 : 2 * x : 2])
        x //= 2
    # Flat views; a position behind a piece's end is ``size``, so neighbours have a column more.
    after, before = np.tile(np.arange(1, size + 2), (count, 1)), np.tile(np.arange(-1, size), (count, 1))
    flat, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
    live = np.flatnonzero(tree[:, 1] != NONE)

    def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
        base, x = rows * (2 * size), i + size
        flat[base + x] = value
        while x[0] > 1:  # all leaves are equally deep
            x = x >> 1
            two = base + 2 * x
            flat[base + x] = np.minimum(flat[two], flat[two + 1])

    def joined(left: np.ndarray, right: np.ndarray, i: np.ndarray) -> np.ndarray:
        rank = pairs.of(left, right)
        return np.where(rank >= 0, rank << shift | i, NONE)

    while len(live):
        root = tree[live, 1]
        i, rank = root & ((1 << shift) - 1), root >> shift
        edge, own = live * (size + 1), live * size
        gone = flat_after[edge + i]
        right = flat_after[edge + gone]
        flat_after[edge + i] = right
        flat_before[edge + right] = i
        flat_ids[own + i] = rank
        put(live, gone, NONE)
        inside = right < n[live]
        put(live, i, np.where(inside, joined(rank, flat_ids[own + np.where(inside, right, 0)], i), NONE))
        left = flat_before[edge + i]
        has = left >= 0
        if has.any():
            rows, left = live[has], left[has]
            put(rows, left, joined(flat_ids[rows * size + left], rank[has], left))
        live = live[tree[live, 1] != NONE]
    # A position is live if its left neighbour points at it; the rest has been swallowed.
    alive = np.zeros((count, size + 2), bool)
    alive[:, 0] = True
    row, at = np.arange(count), np.zeros(count, np.int64)
    while len(row):
        at = after[row, at]
        more = at < n[row]
        row, at = row[more], at[more]
        alive[row, at] = True
    alive = alive[:, :size]
    little = ids[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1)) * 4
    return [little[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class _Memory:
    """What has been computed for short keys: two generations of a bounded number of entries, the older one is dropped."""

    def __init__(self):
        self.new, self.old = {}, {}

    def known(self, keys: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """What is known of ``keys``, and those that aren't."""
        hit, rest = self.new.keys() & keys, keys.difference(self.new)
        found = dict(zip(hit, map(self.new.__getitem__, hit), strict=True))
        older = {k: self.old[k] for k in rest.intersection(self.old)}
        found.update(older)
        self.add(older)
        return found, rest.difference(older)

    def get(self, key: str) -> bytes | None:
        return self.new.get(key) or self.old.get(key)

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def add(self, values: dict[str, bytes]) -> None:
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        self.new.update((k, v) for k, v in values.items() if len(k) <= LONGEST)


class Codec:
    """Encodes texts to ids and ids to bytes. Ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = parse_ranks(data)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs = PairRanks(self.ranks)
        self.runs = {"": _Memory(), " ": _Memory()}
        # Between two characters that are not white space, a single space always opens a new match of these patterns.
        self.spaces = [c for c in map(chr, range(0x3001)) if c.isspace() or regex.match(r"\s", c)]
        self.between = regex.compile(r"(?<=\S) (?=\S)").split
        self.spaced = all(x in pattern for x in (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)"))

    def forget(self) -> None:
        """Drops what was remembered, as a worker may stay idle beside other stages' tasks."""
        for memory in self.runs.values():
            memory.forget()

    def _words(self, text: str) -> list[str]:
        """``text`` cut where a space opens a match; that space is left out."""
        if not self.spaced:
            return [text]
        if any(c in text and (f" {c}" in text or f"{c} " in text) for c in self.spaces):
            return self.between(text)
        return text.split(" ")

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        raw = {x: x.encode() for x in pieces}
        out, classes = {}, defaultdict(list)
        for x, piece in raw.items():
            rank = self.ranks.get(piece)
            if rank is not None:
                out[x] = rank.to_bytes(4, "little")
            else:
                classes[(len(piece) - 1).bit_length()].append(x)
        for width, some in classes.items():
            step = max(1, TOGETHER >> width)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                if len(part) >= LEAST_TOGETHER and self.pairs.single.min() >= 0:
                    out.update(zip(part, merge_many([raw[x] for x in part], self.pairs), strict=True))
                else:
                    out.update((x, array("I", merge(raw[x], self.ranks)).tobytes()) for x in part)
        return out

    def _encoded(self, runs: set[str], lead: str = "") -> dict[str, bytes]:
        """The ids of runs of text, each by itself and with ``lead`` before it."""
        memory = self.runs[lead]
        found, open_ = memory.known(runs)
        cut = {x: self.find(lead + x) for x in open_}
        # A piece behind a space is a run of its own, so it may be remembered as one.
        spaced = self.runs[" "]
        pieces, lacking = {}, set()
        for x in set(chain.from_iterable(cut.values())):
            ids = spaced.get(x[1:]) if x[0] == " " and self.spaced else None
            if ids is None:
                lacking.add(x)
            else:
                pieces[x] = ids
        pieces.update(self._merged(lacking))
        made = {x: b"".join(map(pieces.__getitem__, some)) for x, some in cut.items()}
        memory.add(made)
        found.update(made)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(x) for x in texts]
        first = self._encoded({words[0] for words in cut})
        ids = self._encoded(set().union(*(words[1:] for words in cut)), " ").__getitem__
        return [b"".join([first[words[0]], *map(ids, words[1:])]) for words in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes | None:
        """The tokens' bytes; None if an id is unknown or cut off."""
        try:
            return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))
        except (KeyError, TypeError):
            return None


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (hash(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def _with_binaries(df: DataFrame, path: str, pattern: str, names: list[str], step, rows: int = ROWS) -> DataFrame:
    """``df`` with binary columns ``names``, made by ``step(codec, batch)`` for each batch of rows."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)
    kept = [x for x in df.columns if x not in names]
    schema = df.select(kept).schema
    for name in names:
        schema = schema.add(name, "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        try:
            for batch in slices(batches, rows):
                made = step(codec, batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *(pa.array(x, pa.binary()) for x in made)], [*kept, *names])
        finally:
            codec.forget()
            give_back()

    return df.mapInArrow(work, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with the ids of each whole text as ``ids_le``."""
    return _with_binaries(df, path, pattern, ["ids_le"], lambda codec, batch: [codec.encode_all([x or "" for x in batch.column(text).to_pylist()])])


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``df`` with the bytes that ``ids_le`` stand for as ``decoded``; null and unknown ids give null."""
    named = df.withColumn("_ids", F.col("ids_le"))
    step = lambda codec, batch: [[None if x is None else codec.decode(x) for x in batch.column("_ids").to_pylist()]]
    return _with_binaries(named, path, pattern, ["decoded"], step).drop("_ids")


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", rows: int = ROWS) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows."""

    def step(codec: Codec, batch: pa.RecordBatch) -> list[list[bytes]]:
        ids = codec.encode_all([x or "" for x in batch.column(text).to_pylist()])
        return [ids, [codec.decode(x) for x in ids]]

    return _with_binaries(df, path, pattern, ["ids_le", "decoded"], step, rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rows=QUERY_ROWS)
    return coded.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
