"""Secrets found by one deterministic automaton for all rules.

``compile_rules`` turns the regexes of all rules into one automaton over bytes: a small syntax is
read into a nondeterministic automaton, made deterministic by subset construction and minimised
by partition refinement. It reads every byte of a text once, unanchored. A state tells for every
rule whether a match may end here and whether a match may be under way. A task lays its texts
side by side as ``LANES`` lanes that advance together, one table lookup for each byte and lane; a
lane that was entered in the middle of a possible match is read again from there.

Where a rule accepts, the bytes since the rule was last idle are the only ones a match can start
in. Inside these few bytes matches are taken leftmost first, longest, not overlapping, with the
automaton of that rule alone.

Defined results: a null or empty text has no spans; repeated rows are scanned alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.llm import words as W

#: Kind, pattern and least length of the base spans. A match is a whole run, taken by
#: the pattern and judged by its length afterwards (an assignment by its value); only for hex, whose
#: runs start in every other word, the pattern itself asks for the length, which comes to the same.
BASE_RULES = {
    "assign": (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
               r"[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9+/_.=-]+", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
#: Public formats of further credentials.
MORE_RULES = {
    "key_block": (r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", 27),
    "web_token": (r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 30),
    "host_token": (r"gh[pousr]_[A-Za-z0-9]+", 40),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]+", 15),
}
LANES = 2048


class _Parser:
    """Regex text to a nondeterministic automaton: classes, groups, |, ?, *, +, {n,}."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.edges[start].append((None, a))
            self.edges[b].append((None, end))
            if self.text[self.at:self.at + 1] != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            piece = self.at
            a, b = self.atom()
            times, least, more = self.repeat()
            for k in range(max(times, 1)):
                if k:  # the same piece once more
                    after, self.at = self.at, piece
                    a, b = self.atom()
                    self.at = after
                if least == 0:
                    self.edges[a].append((None, b))
                self.edges[end].append((None, a))
                end = b
            if more:
                self.edges[b].append((None, a))
        return start, end

    def repeat(self) -> tuple[int, int, bool]:
        """(copies, least, whether the last copy repeats)"""
        mark = self.text[self.at:self.at + 1]
        if mark and mark in "?*+":
            self.at += 1
            return 1, int(mark == "+"), mark != "?"
        if mark == "{":
            close = self.text.index(",}", self.at)
            count, self.at = int(self.text[self.at + 1:close]), close + 2
            return count, 1, True
        return 1, 1, False

    def atom(self) -> tuple[int, int]:
        mark = self.text[self.at]
        self.at += 1
        if mark == "(":
            inner = self.choice()
            self.at += 1
            # Own ends, so that repeating the group does not touch what is inside it.
            start, end = self.state(), self.state()
            self.edges[start].append((None, inner[0]))
            self.edges[inner[1]].append((None, end))
            return start, end
        chars = {ord(mark)}
        if mark == "[":
            close = self.text.index("]", self.at)
            body, self.at = self.text[self.at:close], close + 1
            chars, k = set(), 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    chars |= set(range(ord(body[k]), ord(body[k + 2]) + 1))
                    k += 3
                else:
                    chars.add(ord(body[k]))
                    k += 1
        start, end = self.state(), self.state()
        self.edges[start].append((frozenset(chars), end))
        return start, end


@dataclass
class Automaton:
    """``step[state, byte]``; bit k of ``accepts`` and ``idle`` stands for rule k; state 0 starts."""

    step: np.ndarray
    accepts: np.ndarray
    idle: np.ndarray


def compile_rules(patterns: list[str], search: bool) -> Automaton:
    """One minimal automaton for all patterns; ``search`` lets a match start at any byte."""
    edges: list[list[tuple[frozenset | None, int]]] = []
    starts, ends, owner = [], [], []
    for k, pattern in enumerate(patterns):
        parser = _Parser(pattern)
        start, end = parser.choice()
        base = len(edges)
        edges.extend([[(chars, to + base) for chars, to in out] for out in parser.edges])
        owner.extend([k] * len(parser.edges))
        starts.append(start + base)
        ends.append(end + base)

    def closure(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for chars, to in edges[todo.pop()]:
                if chars is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    # Bytes that no pattern tells apart share a class.
    sets = {chars for out in edges for chars, _ in out if chars is not None}
    classes: dict[tuple, int] = {}
    byte_class = np.array([classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)])
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(classes))]

    first = closure(starts)
    names, order, table = {first: 0}, [first], []
    for state in order:  # grows while new subsets are found
        row = []
        for byte in sample:
            moved = {to for s in state for chars, to in edges[s] if chars is not None and byte in chars}
            target = closure(moved | set(starts)) if search else closure(moved)
            if target not in names:
                names[target] = len(order)
                order.append(target)
            row.append(names[target])
        table.append(row)
    steps = np.array(table)
    accepts = np.array([sum(1 << k for k, end in enumerate(ends) if end in s) for s in order])
    progress = [{owner[x] for x in s - first} for s in order]
    idle = np.array([sum(1 << k for k in range(len(patterns)) if k not in p) for p in progress])

    # Refine by outputs, then by the blocks that each class of bytes leads to, until nothing splits.
    _, block = np.unique(np.stack([accepts, idle], axis=1), axis=0, return_inverse=True)
    while True:
        _, finer = np.unique(np.concatenate([block.reshape(-1, 1), block.ravel()[steps]], axis=1), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    block = block.ravel()
    # The starting block becomes state 0.
    block = np.where(block == block[0], -1, block)
    _, block = np.unique(block, return_inverse=True)
    _, one = np.unique(block, return_index=True)
    return Automaton(block[steps[one]][:, byte_class].astype(np.uint16), accepts[one], idle[one])


class Scanner:
    def __init__(self, rules: dict[str, tuple[str, int]]):
        self.kinds, self.least = list(rules), [least for _, least in rules.values()]
        patterns = [pattern for pattern, _ in rules.values()]
        self.all = compile_rules(patterns, search=True)
        self.single = [compile_rules([p], search=False) for p in patterns]

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state after every byte of ``data``."""
        flat = self.all.step.ravel()
        length = -(-len(data) // LANES)
        if length < 64:  # too short for lanes
            return self._read(data, 0)
        padded = np.zeros(length * LANES, np.uint8)
        padded[:len(data)] = data
        lanes = padded.reshape(LANES, length).T.astype(np.int32)
        out = np.empty((length, LANES), np.uint16)
        state = np.zeros(LANES, np.int32)
        for k in range(length):
            state = flat[(state << 8) + lanes[k]]
            out[k] = state
            state = state.astype(np.int32)
        states = out.T.ravel()
        # A lane was entered as if nothing were under way; where that is wrong, read on until both agree.
        for lane in range(1, LANES):
            at = lane * length
            before = int(states[at - 1])
            while before and at < len(states):
                before = int(self.all.step[before, padded[at]])
                if before == states[at]:
                    break
                states[at] = before
                at += 1
        return states[:len(data)]

    def _read(self, data: np.ndarray, state: int) -> np.ndarray:
        out, step = [], memoryview(self.all.step.ravel())
        for byte in data.tolist():
            state = step[state << 8 | byte]
            out.append(state)
        return np.array(out, np.uint16)

    def _longest(self, rule: int, data: bytes, at: int) -> int:
        """End of the longest match of one rule that starts at ``at``, or -1."""
        machine = self.single[rule]
        step, accepts, idle = memoryview(machine.step.ravel()), machine.accepts.tolist(), machine.idle.tolist()
        state, end = 0, -1
        for k in range(at, len(data)):
            state = step[state << 8 | data[k]]
            if accepts[state]:
                end = k + 1
            elif idle[state]:  # nothing of the rule is under way any more
                break
        return end

    def spans(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of ``data``."""
        states = self.states(data)
        found = []
        for rule in range(len(self.kinds)):
            hit = np.flatnonzero(((self.all.accepts >> rule) & 1).astype(bool)[states])
            if not len(hit):
                continue
            idle = np.flatnonzero(((self.all.idle >> rule) & 1).astype(bool)[states])
            # Accepting bytes to runs, each from the byte after the last idle one.
            cut = np.flatnonzero(np.diff(hit) > 1)
            runs = np.stack([hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])] + 1], axis=1)
            before = np.searchsorted(idle, runs[:, 0])
            starts = np.where(before > 0, idle[np.maximum(before - 1, 0)] + 1 if len(idle) else 0, 0)
            # Runs without an idle byte between them are one region.
            apart = np.concatenate([[True], starts[1:] >= runs[:-1, 1]])
            last = np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(runs) - 1]])
            for low, high in zip(starts[apart].tolist(), runs[last, 1].tolist()):
                piece, at = data[low:high].tobytes(), 0
                while at < len(piece):
                    to = self._longest(rule, piece, at)
                    if to >= 0:
                        found.append((low + at, low + to, rule))
                    at = to if to >= 0 else at + 1
        return sorted(found)


def _value(assign: bytes) -> bytes:
    """What an assignment assigns: the run of value bytes at its end, after the first : or =."""
    at = min(k for k in (assign.find(b":"), assign.find(b"=")) if k >= 0)
    return assign[at + 1:].lstrip(b" ").lstrip(b"\"'")


def scan(docs: DataFrame, rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, spans): per document an array of (kind, start, end), in code points, end exclusive, by
    start and then in the order of the rules."""
    rules = {**BASE_RULES, **MORE_RULES} if rules is None else rules
    scanner = Scanner(rules)
    kinds = list(rules)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at, to, raw, bounds in W.steps(batch.column(1)):
                # A zero byte, which no rule reads, after every text.
                spaced = np.zeros(len(raw) + len(bounds), np.uint8)
                spaced[np.arange(len(raw)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = raw
                ends = bounds + np.arange(len(bounds))
                rows: list[list] = [[] for _ in range(to - at)]
                points: dict[int, np.ndarray] = {}
                for start, end, rule in scanner.spans(spaced):
                    size = len(_value(spaced[start:end].tobytes())) if kinds[rule] == "assign" else end - start
                    if size < scanner.least[rule]:
                        continue
                    k = int(np.searchsorted(ends, start, side="right")) - 1
                    base = int(ends[k])
                    if k not in points:
                        points[k] = np.concatenate([[0], np.cumsum((spaced[base:ends[k + 1]] & 0xC0) != 0x80)])
                    rows[k].append({"kind": kinds[rule], "start": int(points[k][start - base]), "end": int(points[k][end - base])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(task, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
