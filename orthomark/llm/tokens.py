"""Token ids of whole texts by a public tokenizer, with every distinct piece encoded once a task.

Both tokenizers in use never join characters across a single blank between two non-blanks: the
word tokenizer drops white space, the byte tokenizer starts a new piece at the blank. A text is
therefore cut there, and where no marks stand side by side also before dots, commas and line
ends; a bounded table remembers the ids of the pieces. A piece made of Latin letters, digits,
ASCII marks (no apostrophe) and single line ends falls apart the same way under both tokenizers'
rules, into runs of one sort; the library's model encodes these runs. Any other piece, and a text
with other white space or with the string of an added token, goes through the whole library.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces remembered by a task, about 200 bytes each; a full table is emptied.
REMEMBERED = 500_000
RUNS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+|\n")


def _byte_class(b: int) -> str:
    """Class of a byte: s dot or comma, p other mark, n line end, w blank, c control, U no part of a Latin-1 letter, a other."""
    if b in (44, 46):
        return "s"
    if b in (10, 32):
        return "n" if b == 10 else "w"
    if b < 32 or b == 127:
        return "c"
    if b == 0xC2 or b >= 0xC4:
        return "U"
    return "a" if b >= 128 or chr(b).isalnum() else "p"


CLASSES = "".join(map(_byte_class, range(256))).encode()


def byte_letters() -> dict[int, int]:
    """The letter a byte-level model writes for each byte: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class _Table(dict):
    """Numbers of pieces; an unknown piece is encoded and gets the next number when it is asked for."""

    def __init__(self, encoder: Encoder, blank: str):
        self.lengths, self.ids = encoder.lengths, encoder.ids
        self.tokenize, self.letters, self.other = encoder.model.tokenize, encoder.letters, encoder.other_piece
        self.blank, self.lower = blank, not encoder.blanks_kept
        self.mark = "\u0120" if blank else ""

    def __missing__(self, word: str) -> int:
        if word.isalpha() and (word.isascii() or max(word) < "\u0100"):  # most pieces: letters of Latin-1
            written = word.lower() if self.lower else word
            if not word.isascii():
                written = written.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenize(self.mark + written)]
        else:
            ids = self.other(word, self.blank)
            if ids is None:
                self[word] = -1
                return -1
        number = self[word] = len(self.lengths)
        self.lengths.append(len(ids))
        self.ids.extend(ids)
        return number


class Encoder:
    def __init__(self, path: str, blanks_kept: bool):
        """``blanks_kept``: the tokenizer sees the blank before a piece (byte-level); else blanks vanish."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        #: Strings that the library turns into one id wherever they stand; after its normalizer any text may hold one.
        self.added = [t.content for t in added] if not any(t.normalized for t in added) else [""]
        self.model, self.letters, self.blanks_kept = self.library.model, byte_letters(), blanks_kept
        self.runs: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        #: Ids of all pieces, one after the other, and how many each has.
        self.ids, self.lengths = array("I"), array("q")
        #: Numbers of pieces that follow a blank, and of first ones; -1 if white space starts or ends it.
        self.known, self.first = _Table(self, " " if self.blanks_kept else ""), _Table(self, "")
        self.runs.clear()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _run(self, run: str) -> list[int]:
        ids = self.runs.get(run)
        if ids is None:
            written = run.encode().decode("latin-1").translate(self.letters)
            ids = self.runs[run] = [t.id for t in self.model.tokenize(written)]
        return ids

    def _piece(self, word: str, blank: str) -> list[int]:
        runs = RUNS.findall(word)
        if "".join(runs) != word or word[0] == "\n" or word[-1] == "\n" or "\n\n" in word:
            return self.whole(blank + word)
        out: list[int] = []
        for run in runs:
            if self.blanks_kept:
                out += self._run(blank + run)
                blank = ""
            elif run.isdigit():
                for digit in run:
                    out += self._run(digit)
            elif run != "\n":
                out += self._run(run.lower())
        return out

    def other_piece(self, word: str, blank: str) -> list[int] | None:
        """Ids of a piece that is no plain word; None if white space starts or ends it."""
        before: list[int] = []
        if word[:1] == "\1":  # cut off before a dot or comma
            word, blank = word[1:], ""
        elif word[:1] == "\2":  # cut off before a line end
            word, blank, before = word[1:], "", self._run("\n")
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return [*before, *self._piece(word, blank)]

    def _words(self, text: str) -> list[str]:
        raw = text.encode()
        classes = raw.translate(CLASSES)
        alone = not (b"ss" in classes or b"sp" in classes or b"ps" in classes or b"c" in classes or b"U" in classes
                     or b"\xc3\x97" in raw or b"\xc3\xb7" in raw)
        if not self.blanks_kept:
            if b"U" not in classes:
                text = text.lower()
            if alone:
                text = text.replace(".", " .").replace(",", " ,").replace("\n", " ")
            return list(filter(None, text.split(" ")))
        # Dots, commas and line ends that stand alone between other characters.
        if alone and not (b"nn" in classes or b"wn" in classes or b"nw" in classes or classes[:1] in b"ns" or b"ws" in classes or b"ns" in classes or classes[-1:] == b"n"):
            text = text.replace(".", " \1.").replace(",", " \1,").replace("\n", " \2")
        return text.split(" ")

    def _numbers(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text; -1 where one is not remembered as such."""
        if "\1" in text or "\2" in text or any(a in text for a in self.added):  # the marks of cuts themselves, added tokens
            return np.array([-1])
        words = self._words(text)
        own = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.blanks_kept:  # the first piece has no blank before it
            own[0] = self.first[words[0]]
        return own

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """uint32 ids of every text."""
        if len(self.known) + len(self.first) > REMEMBERED:
            self._forget()
        # Nothing here is part of a cycle, and the collector would walk over the words of the texts again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            numbers = [self._numbers(text) for text in texts]
        finally:
            if collecting:
                gc.enable()
        # The ids of all pieces of these texts in one go; a text with a piece -1 goes through the library.
        known_lengths, ids = np.append(np.array(self.lengths), 0), np.array(self.ids)
        firsts = np.concatenate([[0], np.cumsum(known_lengths)])
        pieces = np.concatenate([*numbers, np.zeros(0, np.int64)])
        lengths = known_lengths[pieces]
        ends = np.cumsum(lengths)
        joined = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[pieces] - (ends - lengths), lengths)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int64)]
        for text, own, start, end in zip(texts, numbers, bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.array(self.whole(text), np.uint32) if -1 in own else joined[start:end]


def some_at_a_time(column, rows: int = 256) -> Iterator[str]:
    """Texts of an Arrow column, null as empty, few of them as Python strings at once."""
    for at in range(0, len(column), rows):
        yield from (t or "" for t in column.slice(at, rows).to_pylist())


def batches_of(texts: Iterable[str], size: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in lists of about ``size`` characters."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
