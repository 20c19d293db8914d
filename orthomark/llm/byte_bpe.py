"""Byte-level BPE by a table of ranks: texts to ids and ids to bytes.

Each match of the pattern is merged on its own. A segment tree over its byte positions holds, for
the part that begins at a position, the rank of its pair with the next part together with the
position; the root is the leftmost pair of smallest rank. A merge joins two parts and updates
three leaves and their ancestors: the pair itself, the part that vanished, the part before.

Short matches are merged side by side: the trees of all new ones of a size are rows of one
array, and a step performs one merge in every row. Long ones have a tree of their own, so that a match
of n bytes takes n log n steps. A bounded table remembers the ids of matches within a task.

Null and empty texts have no ids. Texts of any length are worked off in segments that end before
a lone blank between non-blanks, where a match always ends; only texts without such a place are
taken whole. Rows that repeat are encoded alike, and no rows give none. Only the columns named in
``keep`` are read beside the text; they may have any names but those of the results.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomark.llm.tokens import tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Matches of at most this many bytes are merged side by side.
SHORT = 64
#: Matches, and their characters, that a task remembers; a full table is emptied.
REMEMBERED, REMEMBERED_CHARS = 500_000, 1 << 26
#: Characters worked off at a time, and the ids decoded at a time.
STEP = 1 << 20
NONE = np.int32(2**31 - 1)
NO_RANK = 1 << 62


class Ranks:
    """Ranks of byte strings; a rank is the id of its token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # Every way to write a token as two tokens, sorted by the two ids.
        pairs = [(left << 32 | right, rank) for token, rank in self.ranks.items() for cut in range(1, len(token))
                 if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None]
        keys, ids = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = np.append(keys[order], NO_RANK), np.append(ids[order], NONE).astype(np.int32)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE without one; -1 is no part."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, wanted)
        return np.where(self.pair_keys[at] == wanted, self.pair_ids[at], NONE)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match by a segment tree of its own."""
    count = len(piece)
    leaves = 1 << (count - 1).bit_length()
    following, before = array("q", range(1, count + 1)), array("q", range(-1, count - 1))
    tree = array("q", [NO_RANK]) * (2 * leaves)
    for at in range(count - 1):
        rank = ranks.get(piece[at:at + 2])
        if rank is not None:
            tree[leaves + at] = rank * leaves + at
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, value: int) -> None:
        node = leaves + at
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            value = value if value < other else other
            if tree[node] == value:
                return
            tree[node] = value

    def pair(at: int) -> int:
        """Value of the leaf of the part at ``at``, from the bytes up to the end of the next part."""
        middle = following[at]
        rank = ranks.get(piece[at:following[middle]]) if middle < count else None
        return NO_RANK if rank is None else rank * leaves + at

    while tree[1] != NO_RANK:
        at = tree[1] % leaves
        gone = following[at]
        after = following[at] = following[gone]
        if after < count:
            before[after] = at
        update(gone, NO_RANK)
        update(at, pair(at))
        if at:
            update(before[at], pair(before[at]))
    ids, at = [], 0
    while at < count:
        ids.append(ranks[piece[at:following[at]]])
        at = following[at]
    return ids


def merge_short(pieces: Sequence[bytes], leaves: int, table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of matches of at most ``leaves`` bytes (a power of two), one after the other, and how many each has."""
    rows, bits = len(pieces), leaves.bit_length() - 1
    sizes = np.fromiter(map(len, pieces), np.int64, rows)
    inside = np.arange(leaves) < sizes[:, None]
    part = np.full((rows, leaves + 1), -1, np.int32)  # the last column stands for no part, before the first and after the last
    part[:, :-1][inside] = table.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    following = np.tile(np.arange(1, leaves + 2), (rows, 1))
    following[np.arange(rows), sizes - 1] = leaves
    before = np.tile(np.arange(-1, leaves), (rows, 1))
    before[:, 0] = leaves
    tree = np.full((rows, 2 * leaves), NONE, np.int32)
    first = table.joined(part[:, :-2], part[:, 1:-1])
    tree[:, leaves:-1] = np.where(first == NONE, NONE, first << bits | np.arange(leaves - 1, dtype=np.int32))
    width = leaves
    while width > 1:
        tree[:, width // 2:width] = np.minimum(tree[:, width:2 * width:2], tree[:, width + 1:2 * width:2])
        width //= 2
    row = np.arange(rows)
    while True:
        least = tree[row, 1]
        row, least = row[least != NONE], least[least != NONE]
        if not len(row):
            break
        at, made = (least & (leaves - 1)).astype(np.int64), least >> bits
        gone = following[row, at]
        after, ahead = following[row, gone], before[row, at]
        part[row, at], part[row, gone] = made, -1
        following[row, at] = after
        before[row, after] = at
        inside[row, gone] = False
        right, left = table.joined(made, part[row, after]), table.joined(part[row, ahead], made)
        right = np.where(right == NONE, NONE, right << bits | at)
        left = np.where(left == NONE, NONE, left << bits | ahead)
        starts = ahead == leaves  # nothing before: the pair itself again
        nodes = np.stack([at, gone, np.where(starts, at, ahead)]) + leaves
        tree[row, nodes] = np.stack([right, np.full(len(row), NONE), np.where(starts, right, left)])
        for _ in range(bits):
            nodes >>= 1
            tree[row, nodes] = np.minimum(tree[row, 2 * nodes], tree[row, 2 * nodes + 1])
    return part[:, :-1][inside], inside.sum(axis=1)


class _Numbers(dict):
    """Numbers of matches in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.table, self.matches, self.cuts = ranks_of(path), regex.compile(pattern).findall, regex.compile(r"(?<=\S) (?=\S)")
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        #: Ids of all known matches one after the other, where each begins, and how many it has.
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of matches that were numbered since the last call, in the order of their numbers."""
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        sizes: dict[int, list[tuple[int, bytes]]] = {}
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            if (rank := self.table.ranks.get(raw)) is not None:
                found[k] = np.array([rank], np.uint32)
            elif len(raw) > SHORT:
                found[k] = np.array(merge_long(raw, self.table.ranks), np.uint32)
            else:
                sizes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((k, raw))
        for leaves, group in sizes.items():
            ids, counts = merge_short([raw for _, raw in group], leaves, self.table)
            ends = np.cumsum(counts).tolist()
            ids = ids.astype(np.uint32)
            for (k, _), start, end in zip(group, [0, *ends], ends):
                found[k] = ids[start:end]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths, self.ids = np.append(self.lengths, lengths), np.concatenate([self.ids, *found])
        self.chars += sum(map(len, pieces))

    def segments(self, text: str) -> Iterator[str]:
        """The text in segments of about STEP characters, cut where a match always ends."""
        start = 0
        while len(text) - start > STEP and (cut := self.cuts.search(text, start + STEP)):
            yield text[start:cut.start()]
            start = cut.start()
        if start < len(text):
            yield text[start:]

    def segment(self, texts: Sequence[str]) -> list[np.ndarray]:
        """uint32 ids of every text."""
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        number = self.numbers.__getitem__
        known = len(self.numbers)
        numbers, bounds = array("q"), [0]
        for text in texts:
            numbers.extend(map(number, self.matches(text)))
            bounds.append(len(numbers))
        if len(self.numbers) > known:
            self._learn(list(self.numbers)[known:])
        pieces = np.frombuffer(numbers, np.int64)
        lengths = self.lengths[pieces]
        ends = np.append(0, np.cumsum(lengths))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[pieces] - ends[:-1], lengths)]
        return [ids[start:end] for start, end in pairwise(ends[bounds].tolist())]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """uint32 ids of every text, of any length."""
        parts = [list(self.segments(text)) for text in texts]
        short = iter(self.segment([p[0] for p in parts if len(p) == 1]))
        return [next(short) if len(p) == 1 else np.concatenate([np.zeros(0, np.uint32), *(self.segment([s])[0] for s in p)]) for p in parts]


def _by_size(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with the values of a column as Python objects, of about STEP characters or bytes each."""
    for at in range(0, batch.num_rows, rows):
        block = batch.slice(at, min(rows, batch.num_rows - at))
        held, total, first = [], 0, 0
        for k in range(block.num_rows):
            held.append(block.column(column)[k].as_py())
            total += len(held[-1] or "")
            if total >= STEP or k + 1 == block.num_rows:
                yield block.slice(first, len(held)), held
                held, total, first = [], 0, k + 1


def _added(batch: pa.RecordBatch, name: str, values: list[bytes], drop: int) -> pa.RecordBatch:
    columns = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if k != drop]
    return pa.RecordBatch.from_arrays([*[c for _, c in columns], pa.array(values, pa.binary())], names=[*[n for n, _ in columns], name])


def _mapped(df: DataFrame, keep: Sequence[str], name: str, task) -> DataFrame:
    if name in keep:
        raise ValueError(f"a column to keep has the name of the result: {name}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(task, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"{name} binary"]))


def encode(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for rows, texts in _by_size(batch, batch.num_columns - 1):
                ids = encoder.encode([t or "" for t in texts])
                yield _added(rows, "ids", [i.astype("<u4").tobytes() for i in ids], batch.num_columns - 1)

    return _mapped(docs.select(*keep, F.col(text).cast("string").alias("_text")), keep, "ids", task)


def decode(encoded: DataFrame, keep: Sequence[str] = ("doc_id", "ids"), path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``decoded``: the bytes that the ids in the column ``ids`` stand for."""
    path = path or tokenizer_path(VOCABULARY)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = ranks_of(path).tokens.__getitem__
        for batch in batches:
            for rows, packed in _by_size(batch, batch.num_columns - 1):
                ids = [np.frombuffer(p or b"", "<u4") for p in packed]
                texts = [b"".join(b"".join(map(token, i[at:at + STEP].tolist())) for at in range(0, len(i), STEP)) for i in ids]
                yield _added(rows, "decoded", texts, batch.num_columns - 1)

    return _mapped(encoded.select(*keep, F.col("ids").alias("_ids")), keep, "decoded", task)
