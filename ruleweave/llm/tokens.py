"""Token ids of texts by a public tokenizer file, as buffers of little-endian uint32.

The tokenizers library does the encoding. For a tokenizer that drops white space, a text's
ids are those of its white-space separated pieces, one after another; pieces met before are
taken from a bounded memory, and plain words are encoded once for all their spellings. ``Encoder`` runs inside tasks; its tokenizer file is read once
per Python worker. Tokenizers that keep white space are refused.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memories import claim

#: Pieces remembered per worker; the memory is emptied when it is full.
REMEMBERED = 1_000_000
#: Longer pieces (base64, say) are encoded each time they come.
LONG = 200
#: New pieces encoded as one line.
LINE = 256
#: Bytes of texts whose pieces are looked up together.
CHUNK = 2 << 20
#: Texts that show whether a tokenizer drops white space.
_SPACED = (("a", "b"), ("word,", "Word"), ("1", ".", "x9"))
#: Letters that NFC leaves alone, each with one small letter, and marks without the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Normalizer and splitter for which those letters, made small, are one word and the marks another.
_LOWERED = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {
        "type": "Split", "behavior": "Removed", "invert": True,
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of a text's white-space separated pieces, joined."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {b"": b""}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends: dict[str, bool] = {}  # letter and mark -> whether the mark is a word of its own
        for words in _SPACED:
            apart = b"".join(map(self.whole, words))
            if any(self.whole(gap.join(words)) != apart for gap in (" ", "  ", "\n")):
                raise ValueError("the tokenizer keeps white space, pieces cannot be encoded apart")
        self.words = None  # the same model for small letters and marks, a word between two spaces
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        if spec["normalizer"] == _LOWERED and spec["pre_tokenizer"] == _SPLIT:
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(False, use_regex=False)]
            )

    def whole(self, text: str) -> bytes:
        """Ids of a text by one call of the library."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def stands_alone(self, end: str) -> bool:
        """Whether a full stop or comma after this letter is a word of its own.

        Some letters end in a mark once they are normalized, and then both are one word.
        """
        known = self.ends.get(end)
        if known is None:
            letter, mark = end
            normal = self.tokenizer.normalizer.normalize_str(letter) if self.tokenizer.normalizer else letter
            known = letter.isalpha() and normal[-1:].isalpha() and (
                self.whole(end) == self.whole(letter) + self.whole(mark)
            )
            self.ends[end] = known
        return known

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that are not known yet, many as one line of the tokenizer.

        Pieces of plain letters, with marks behind them or not, are put together from their
        words. Of the others, ids belong to the piece in which their place begins; those that
        end in a full stop or comma are put together from two where that is right, and those
        that may hold the string of an added token are encoded by themselves.
        """
        known, plain, words, parted = self.known, [], {}, []
        texts = b" ".join(pieces).decode().split(" ") if pieces else []
        some_added = any(added in piece for added in self.added for piece in texts)
        for piece, text in zip(pieces, texts, strict=True):
            if some_added and any(added in text for added in self.added):
                known[piece] = self.whole(text)
            elif self.words and len(piece) <= LONG and (form := _PLAIN.fullmatch(text)):
                body, marks = form[1].lower().encode(), form[2].encode()
                words[body] = words[marks] = None
                if body != piece:
                    parted.append((piece, body, marks))
            elif text[-1] in ".," and len(text) > 1 and self.stands_alone(text[-2:]):
                parted.append((piece, piece[:-1], piece[-1:]))
                plain += [piece[:-1], piece[-1:]]
            else:
                plain.append(piece)
        for found, encode in ((words, self._words), (dict.fromkeys(plain), self._line)):
            new = [piece for piece in found if piece not in known]
            for start in range(0, len(new), LINE):
                encode(new[start : start + LINE])
        known.update((piece, known[body] + known[marks]) for piece, body, marks in parted)

    def _words(self, group: list[bytes]) -> None:
        found = self.words.encode(b" ".join(group).decode(), add_special_tokens=False)
        ids = array("I", found.ids).tobytes()
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(group))
        ends = (4 * np.cumsum(sizes)).tolist()
        self.known.update((word, ids[a:b]) for word, a, b in zip(group, [0, *ends], ends))

    def _line(self, group: list[bytes]) -> None:
        texts = [piece.decode() for piece in group]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids, places = array("I", found.ids).tobytes(), found.offsets
        at, count, end = 0, len(places), -1
        for piece, text in zip(group, texts, strict=True):
            end += len(text) + 1
            first = at
            while at < count and places[at][0] < end:
                at += 1
            self.known[piece] = ids[4 * first : 4 * at]

    def _ids(self, pieces: list[bytes]) -> list[bytes] | None:
        """Ids of each of some distinct pieces; None if too many of them are new."""
        found = list(map(self.known.get, pieces))
        missing = [piece for piece, ids in zip(pieces, found, strict=True) if ids is None]
        if not missing:
            return found
        if len(missing) > self.remembered // 4:
            return None
        if len(self.known) + 3 * len(missing) > self.remembered:
            self.known.clear()
            self.known[b""] = b""
            if len(pieces) <= self.remembered // 4:
                self.known.update((p, ids) for p, ids in zip(pieces, found, strict=True) if ids is not None)
        self.learn(missing)
        known = self.known
        found = [known[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        for piece in missing:
            if len(piece) > LONG:
                known.pop(piece, None)
                known.pop(piece[:-1], None)
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian uint32; null counts as empty."""
        if not text:
            return b""
        pieces = text.encode().split()
        distinct = list(dict.fromkeys(pieces))
        ids = self._ids(distinct)
        if ids is None:
            return self.whole(text)
        return b"".join(map(dict(zip(distinct, ids, strict=True)).__getitem__, pieces))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every whole text of a column of strings, as ``encode`` gives them."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = np.cumsum(sizes) // CHUNK
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)]).tolist()
        for start, end in zip(starts, [*starts[1:], len(chunk)]):
            part, ids = texts.slice(start, end - start), None
            if sizes[start:end].sum() <= 2 * CHUNK:  # else one of them is long
                pieces = pc.ascii_split_whitespace(pc.fill_null(part, ""))
                coded = pieces.flatten().dictionary_encode()
                ids = self._ids(pc.cast(coded.dictionary, pa.binary()).to_numpy(zero_copy_only=False).tolist())
            if ids is None:
                yield from map(self.encode, part.to_pylist())
                continue
            places, bounds = coded.indices.to_numpy().tolist(), pieces.offsets.to_numpy().tolist()
            for a, b in zip(bounds, bounds[1:]):
                yield b"".join(map(ids.__getitem__, places[a:b]))


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    claim("tokens", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
