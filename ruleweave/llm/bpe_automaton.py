"""Byte-pair encoding by a deterministic automaton over tokens.

Start with one state that loops on every byte. A merge of u and v into w is worked in as a
gadget: the arcs labelled u get a target of their own, a copy of the old one without its arc
v, and wherever u and then v could be read, an arc w leads to where v led. After all merges
the automaton reads exactly the token sequences that merging produces, so a text has one
accepted path, and for each of its prefixes that path's last token is unique too.

All arcs with one label lead to one state, so the automaton is a table ``target[token]``
plus, per state, what it was copied from and which arc it lost. Whether a state has an arc
follows from that: an arc made by a merge after the state was born stands where the arc of
the merge's left part stands; an older arc was copied, unless it is the one that was lost.
Numbering the tree of copies makes that a look-up.

Encoding a pre-split word follows arcs from the first state, longest labels first, and steps
back from positions that lead nowhere. Words met before are remembered. Decoding writes out
the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and arcs remembered per worker; the memory is emptied when it is full.
REMEMBERED = 400_000

#: The splitting pattern of byte-level byte-pair encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, Automaton] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the others for letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """States, arcs and labels made from a vocabulary and its merges, in their order."""

    def __init__(
        self,
        labels: dict[bytes, int],
        merges: list[tuple[bytes, bytes]],
        added: dict[str, int] | None = None,
        pattern: str = PATTERN,
        remembered: int = REMEMBERED,
    ):
        import regex

        self.ids, self.added, self.remembered = labels, dict(added or {}), remembered
        self.labels = {i: label for label, i in labels.items()}
        self.labels.update({i: text.encode() for text, i in self.added.items()})
        self.longest = max(map(len, labels), default=1)
        self.splitter = regex.compile(pattern)
        self.stops = (
            regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)))
            if self.added
            else None
        )
        #: Two white-space characters in a row; else every word begins at a blank or a line.
        self.runs = regex.compile(r"\s\s")
        self.words: dict[str, bytes] = {}
        # State 0 is the first one; a token's born is the number of the merge that made it.
        self.born = {i: 0 for label, i in labels.items() if len(label) == 1}
        self.left: dict[int, int] = {}
        self.target = dict.fromkeys(self.born, 0)
        self.state_born, self.copied, self.lost = [0], [-1], [-1]
        for nth, (u, v) in enumerate(merges, 1):
            self._merge(nth, labels[u], labels[v], labels[u + v])
        self._seen: dict[tuple[int, int], bool] = {}
        self._tabulate()

    def _merge(self, nth: int, u: int, v: int, w: int) -> None:
        """Work in one merge; one that can no longer happen changes nothing."""
        if w in self.born or u not in self.target or v not in self.target:
            return
        old = self.target[u]
        if not self._arc_so_far(old, v):
            return
        self.state_born.append(nth)
        self.copied.append(old)
        self.lost.append(v)
        self.born[w], self.left[w] = nth, u
        self.target[w] = self.target[v]
        self.target[u] = len(self.lost) - 1

    def _arc_so_far(self, state: int, token: int) -> bool:
        """Whether a token may follow in a state, by the chain of copies."""
        born = self.born
        while True:
            if born[token] >= self.state_born[state] and token in self.left:
                token = self.left[token]
            elif state == 0:
                return True
            elif token == self.lost[state]:
                return False
            else:
                state = self.copied[state]

    def _tabulate(self) -> None:
        """Number the tree of copies, so that one look-up tells whether a state lost an arc.

        A state and all copies below it have numbers in one interval. An arc is lost once on
        the way down to a state, so the intervals of a label do not overlap.
        """
        below: list[list[int]] = [[] for _ in self.lost]
        for state in range(1, len(self.lost)):
            below[self.copied[state]].append(state)
        self.first, self.past = [0] * len(self.lost), [0] * len(self.lost)
        todo, number = [(0, False)], 0
        while todo:
            state, done = todo.pop()
            if done:
                self.past[state] = number
                continue
            self.first[state] = number
            number += 1
            todo.append((state, True))
            todo.extend((child, False) for child in below[state])
        losses: dict[int, list[tuple[int, int]]] = {}
        for state in range(1, len(self.lost)):
            losses.setdefault(self.lost[state], []).append((self.first[state], state))
        self.losses = {
            token: ([n for n, _ in sorted(found)], [state for _, state in sorted(found)])
            for token, found in losses.items()
        }

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a token may follow in a state: neither its arc nor that of its left part,
        and so on, was lost on the way to the state before the token was made."""
        here, limit = self.first[state], len(self.lost)
        while True:
            if token in self.losses:
                numbers, states = self.losses[token]
                nth = bisect_right(numbers, here) - 1
                if nth >= 0 and here < self.past[states[nth]] and self.state_born[states[nth]] <= limit:
                    return False
            if token not in self.left:
                return True
            limit, token = self.born[token], self.left[token]

    def encode_word(self, raw: bytes) -> array:
        """The accepted path for the bytes of one pre-split word.

        From each position the longest token that the state lets through is tried first.
        A prefix has one path only, so a position that led nowhere never needs another try.
        """
        ids, target, seen, longest = self.ids, self.target, self._seen, self.longest
        size, at, state = len(raw), 0, 0
        path: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        while at < size:
            for end in range(min(size, at + longest), at, -1):
                token = ids.get(raw[at:end])
                if token is None or token not in target or end in dead:
                    continue
                fits = seen.get((state, token))
                if fits is None:
                    fits = seen[state, token] = self.has_arc(state, token)
                if fits:
                    path.append(token)
                    ends.append(end)
                    at, state = end, target[token]
                    break
            else:
                if not path:
                    raise ValueError(f"no path for {raw!r}")
                dead.add(at)
                path.pop()
                ends.pop()
                at, state = (ends[-1], target[path[-1]]) if path else (0, 0)
        return array("i", path)

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart from each other.

        Where no two white-space characters meet, a word begins with each blank, and a line
        end stands alone; cutting there is quick and splits no word. Else the pattern cuts.
        """
        if "\x00" in text or self.runs.search(text):
            return self.splitter.findall(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, text: str | None) -> array:
        """Ids of a whole text; null counts as empty. Strings of added tokens are those tokens."""
        if not text:
            return array("i")
        if self.stops is not None and self.stops.search(text):
            out, at = array("i"), 0
            for stop in self.stops.finditer(text):
                out += self._plain(text[at : stop.start()])
                out.append(self.added[stop.group()])
                at = stop.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> array:
        if not text:
            return array("i")
        pieces, words = self._pieces(text), self.words
        if len(words) > self.remembered or len(self._seen) > self.remembered:
            words.clear()
            self._seen.clear()
        try:
            return array("i", b"".join(map(words.__getitem__, pieces)))
        except KeyError:
            pass
        for piece in dict.fromkeys(pieces):
            if piece in words:
                continue
            parts = []
            for word in self.splitter.findall(piece):
                if word not in words:
                    words[word] = self.encode_word(word.encode()).tobytes()
                parts.append(words[word])
            words[piece] = b"".join(parts)
        return array("i", b"".join(map(words.__getitem__, pieces)))

    def decode(self, ids) -> str:
        """Labels of the ids, joined; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def from_file(path: str) -> Automaton:
    """The automaton of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    raw = {token: bytes(map(letters.__getitem__, token)) for token in spec["model"]["vocab"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Automaton(
        {raw[token]: i for token, i in spec["model"]["vocab"].items()},
        [(raw[u], raw[v]) for u, v in pairs],
        {t["content"]: t["id"] for t in spec["added_tokens"]},
    )


def automaton(path: str) -> Automaton:
    """This worker's automaton for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = from_file(path)
    return _LOADED[path]


def encoded(text: Column, tokenizer: str) -> Column:
    """Ids of a text column, as array<int>; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(tokenizer)
        for batch in texts:
            ids, ends = array("i"), [0]
            for value in batch.to_pylist():
                ids += machine.encode(value)
                ends.append(len(ids))
            yield pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32), pa.int32())
            )

    return encode(text)


def decoded(ids: Column, tokenizer: str) -> Column:
    """Text of an array<int> column of ids; null gives null. Unknown ids are an error."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(tokenizer)
        for batch in batches:
            values, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_pylist()
            known = batch.is_valid().to_pylist()
            # One text's ids at a time become Python numbers.
            yield pa.array(
                [
                    machine.decode(values[start:end].tolist()) if valid else None
                    for valid, start, end in zip(known, ends, ends[1:], strict=False)
                ],
                pa.string(),
            )

    return decode(ids)


def encode_documents(
    docs: DataFrame, tokenizer: str, text_col: str = "text", ids: str = "ids", text: str = "decoded"
) -> DataFrame:
    """Add the ids of every text and the text they decode to.

    Null text counts as empty: no ids, empty text. Every row is encoded by itself, so nulls
    elsewhere, repeated rows and other columns do not matter, but columns that bear the
    names of the two results are replaced.
    """
    with_ids = docs.withColumn(ids, encoded(F.col(text_col), tokenizer))
    return with_ids.withColumn(text, decoded(F.col(ids), tokenizer))
