"""Toxic texts by a learned lexicon, Levenshtein automata and the context of each hit.

The classifier is fitted on a bounded sample of labelled rows. It counts in how many toxic
and how many other texts a word or word beginning occurs; those that lean clearly to toxic
texts form the lexicon, and a beginning stands for all words it begins. A few texts are
enough for a term, whatever the size of the sample, so terms of a language with few texts
and rare terms enter. Among rare terms some lean by chance; how far to trust hits is
therefore learned on texts that had no part in the lexicon they are matched with.

Matching intersects two automata while walking down the trie of the lexicon: the trie, and
for the word at hand a Levenshtein automaton. Its state is one set of places in the word per
number of edits, held as bits; a letter of the trie moves all of them at once, with swapped
neighbours counted as one edit. Branches with no place left are cut, so misspelled terms are
found without comparing the word with every entry. Digits and signs that stand for letters
are one edit like any other. Beginnings have a trie of their own, whose ends accept as soon
as some beginning of the word is near enough. Misspelled beginnings and terms of four
letters meet many innocent words; they count apart, as weak hits with a weight of their own.

Each hit is judged in a window of words around it: inside quotation marks, or near words
that report speech, it counts as quotation and is weighed apart from plain use. A logistic
model over the counts and weights of such hits gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .memories import claim

#: Labelled rows the classifier is fitted on, about at most.
FIT_ROWS = 40_000
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6)
#: An entry occurs in this many toxic texts of the sample and leans by this log ratio. The
#: lexicon is bounded by the sample alone: each of its entries uses up that many places in it.
MIN_TEXTS, MIN_LEAN = 4, 3.0
#: Parts of the sample; the features of each are taken with a lexicon of the other parts.
FOLDS = 5
#: Words on either side of a hit that tell quotation from use.
WINDOW = 6
#: Words that report speech, and quotation marks.
REPORTING = frozenset(
    "said says say saying wrote writes quote quoted quotes quoting called calls word words term terms phrase "
    "reported reports according sagte sagt schrieb zitat wort nannte dit disait cite mot appelle dijo dice cita "
    "palabra llama".split()
)
QUOTES = "\"“”„«»‹›"
#: Stripped from both ends of a word.
EDGES = " .,;:!?()[]{}<>*_~`'’‘\"“”„«»‹›…-–—/\\|#"

FEATURES = (
    "hits", "weight", "stem_hits", "near_hits", "quoted_hits", "quoted_share", "kinds", "density", "strongest",
    "weak_hits", "weak_density",
)


@dataclass(frozen=True)
class Entry:
    """A term of the lexicon, or a beginning of terms, and how far it leans to toxic texts."""

    text: str
    stem: bool
    lean: float


def budget(length: int) -> int:
    """Edits allowed for a term of this length."""
    return 0 if length < 4 else 1 if length < 9 else 2


def weak(entry: Entry, edits: int) -> bool:
    """Misspellings that meet many innocent words."""
    return edits > 0 and (entry.stem or len(entry.text) < 5)


def shortened(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters."""
    found = {word}
    now = [word]
    for _ in range(most):
        now = list({w[:j] + w[j + 1 :] for w in now for j in range(len(w))})
        found.update(now)
    return found


#: In a node of a trie, the terms below it; no word holds this letter.
BELOW = "\n"
#: Odd numbers that spread letters and pairs over bits.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def letter_bits(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps, sizes) of words: 128 bits of their letters and 128 of their pairs of letters.

    Letters fall into 32 groups, whose first, second, third and fourth letter have a bit
    each, so that differing bits are at most as many as differing letters. Pairs, with the
    ends of a word, have a bit each.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    if not len(words):
        return np.zeros((0, 4), np.uint64), sizes
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    pairs = codes[:-1] * np.uint64(_MIX[0]) ^ codes[1:] * np.uint64(_MIX[1])
    pairs = (pairs * np.uint64(_MIX[2])) >> np.uint64(57)
    groups = ((codes[1:] * np.uint64(_MIX[0])) >> np.uint64(59)).astype(np.int64)
    of = np.repeat(np.arange(len(words)), sizes + 1)
    key = of * 32 + groups
    by = np.argsort(key, kind="stable")
    first = np.r_[True, key[by][1:] != key[by][:-1]]
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    letters = (groups * 4 + np.minimum(nth, 3)).astype(np.uint64)
    letter = codes[1:] != ord("\n")
    halves = []
    for numbers, counts in ((letters, letter), (pairs, None)):
        bit = np.uint64(1) << (numbers & np.uint64(63))
        for side in (False, True):
            keep = (numbers >= 64) == side
            halves.append(np.bitwise_or.reduceat(np.where(keep if counts is None else keep & counts, bit, np.uint64(0)), starts))
    return np.stack(halves, axis=1), sizes


def letter_codes(words: Sequence[str]) -> np.ndarray:
    """A row of code points per word, with zeros behind its end."""
    width = max(map(len, words), default=0)
    if not width:
        return np.zeros((len(words), 1), np.uint32)
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def edit_distances(words: Sequence[str], terms: np.ndarray) -> np.ndarray:
    """Edit distances, swaps included, of words to the terms beside them, given as codes.

    One bit per letter of the word, all pairs at once, a letter of the terms after another.
    Words must have fewer than 64 letters; longer ones are as far as can be.
    """
    codes = letter_codes([w[:63] for w in words])
    sizes = np.array([len(w) for w in words], np.int64)
    one = np.uint64(1)
    powers = one << np.arange(codes.shape[1], dtype=np.uint64)
    end = one << (np.clip(sizes, 1, 63) - 1).astype(np.uint64)
    up, down = np.full(len(words), ~np.uint64(0)), np.zeros(len(words), np.uint64)
    same, before, distance = down.copy(), down.copy(), sizes.copy()
    for j in range(terms.shape[1]):
        letter = terms[:, j]
        runs = letter != 0
        meets = ((codes == letter[:, None]) * powers).sum(axis=1, dtype=np.uint64)
        swapped = ((~same & meets) << one) & before
        next_same = swapped | (((meets & up) + up) ^ up) | meets | down
        more, less = down | ~(next_same | up), next_same & up
        change = ((more & end) != 0).astype(np.int64) - ((less & end) != 0)
        distance += np.where(runs, change, 0)
        more, less = (more << one) | one, less << one
        up = np.where(runs, less | ~(next_same | more), up)
        down = np.where(runs, more & next_same, down)
        same, before = np.where(runs, next_same, same), np.where(runs, meets, before)
    return np.where(sizes < 64, distance, 1 << 30)


class Lexicon:
    """Tries of terms and of beginnings, intersected with the Levenshtein automaton of a word."""

    def __init__(self, entries: Sequence[Entry]):
        self.root: dict = {}
        self.short_root: dict = {}
        self.stem_root: dict = {}
        self.stems = {e.text: e for e in entries if e.stem}
        self.terms = {e.text: e for e in entries if not e.stem}
        self.stem_lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.longest = max((len(e.text) for e in entries), default=0) + 2
        # What is left of terms without some letters, by the edits allowed; saves time only.
        self.shortened: dict[int, set[str]] = {1: set(), 2: set()}
        self.short_shortened: set[str] = set()
        self.stems_shortened: set[str] = set()
        fuzzy = [e.text for e in entries if not e.stem and budget(len(e.text))]
        numbers = {text: i for i, text in enumerate(fuzzy)}
        self.prefixes: dict[str, bool] = {}
        self.fuzzy_bits, self.fuzzy_sizes = letter_bits(fuzzy)
        self.fuzzy_codes = letter_codes(fuzzy)
        self.fuzzy_edits = np.array([budget(len(t)) for t in fuzzy], np.int64)
        for entry in entries:
            edits = budget(len(entry.text))
            if not edits:
                continue
            if entry.stem:
                node, kept = self.stem_root, self.stems_shortened
            elif weak(entry, edits):
                node, kept = self.short_root, self.short_shortened
            else:
                node, kept = self.root, self.shortened[edits]
            kept |= shortened(entry.text, edits)
            # Every node knows which terms are below it, as the bits of a number.
            number = 0 if entry.stem else 1 << numbers[entry.text]
            for letter in entry.text:
                node = node.setdefault(letter, {BELOW: 0})
                node[BELOW] |= number
            node[""] = entry

    def candidates(self, words: Sequence[str]) -> dict[int, int]:
        """Terms that a word is near to: number of the word -> bits of the terms.

        An edit changes two letters and four pairs of letters at most, or six pairs if it
        swaps two letters, so no misspelled term is missed; what these counts leave over is
        held against the edit distance. This saves time only: what is searched for in the
        tries is the same.
        """
        near: dict[int, int] = {}
        if not len(self.fuzzy_edits):
            return near
        for start in range(0, len(words), 1024):
            part = words[start : start + 1024]
            bits, sizes = letter_bits(part)
            differ = np.bitwise_count(bits[:, 0, None] ^ self.fuzzy_bits[:, 0])
            differ += np.bitwise_count(bits[:, 1, None] ^ self.fuzzy_bits[:, 1])
            word, term = np.nonzero(differ <= 2 * self.fuzzy_edits.astype(np.uint8))
            differ = np.bitwise_count(bits[word, 2:] ^ self.fuzzy_bits[term, 2:]).sum(axis=1)
            fits = differ <= 6 * self.fuzzy_edits[term]
            fits &= np.abs(sizes[word] - self.fuzzy_sizes[term]) <= self.fuzzy_edits[term]
            word, term = word[fits], term[fits]
            if not len(word):
                continue
            close = edit_distances([part[i] for i in word], self.fuzzy_codes[term]) <= self.fuzzy_edits[term]
            for i, t in zip((start + word[close]).tolist(), term[close].tolist(), strict=True):
                near[i] = near.get(i, 0) | 1 << t
        return near

    def match(self, word: str, sure_first: bool = False, among: int | None = None) -> tuple[Entry, int] | None:
        """(entry, edits) of the best entry for a word: exact, then a stem, then misspelled.

        Misspelled terms are looked for ``among`` those with these bits only, if given.

        Of misspelled terms, the one with fewer edits and more lean is best; with
        ``sure_first``, those that are not weak come before. Misspelled stems come last.
        """
        entry = self.terms.get(word)
        if entry is not None:
            return entry, 0
        for n in self.stem_lengths:
            entry = self.stems.get(word[:n])
            if entry is not None:
                return entry, 0
        size = len(word)
        if size < 3:
            return None
        most = 2 if size >= 8 else 1
        sure = short = None
        # Each edit takes a letter at most from either side, so what is left is the same.
        if among is None and size <= self.longest and not (
            self.shortened[1].isdisjoint(shortened(word, 1))
            and (not self.shortened[2] or self.shortened[2].isdisjoint(shortened(word, most)))
        ) or among:
            sure = self._misspelled(word, self.root, most, among)
            if sure and sure_first:
                return sure
        if size <= 5 and (among or among is None and not self.short_shortened.isdisjoint(shortened(word, 1))):
            short = self._misspelled(word, self.short_root, 1, among)
        if sure or short:
            return min(filter(None, (sure, short)), key=lambda x: (x[1], -x[0].lean))
        if self.stem_lengths and self._near_stem(word[: self.stem_lengths[0]]):
            # Stems allow one edit, so no more letters than these come into it.
            return self._misspelled(word[: self.stem_lengths[0] + 1], self.stem_root, 1)
        return None

    def _near_stem(self, prefix: str) -> bool:
        """Whether a stem may begin a word, with an edit; words share their beginnings."""
        near = self.prefixes.get(prefix)
        if near is None:
            if len(self.prefixes) > 50_000:
                self.prefixes.clear()
            near = any(not self.stems_shortened.isdisjoint(shortened(prefix[:n], 1)) for n in self.stem_lengths)
            self.prefixes[prefix] = near
        return near

    @staticmethod
    def _misspelled(word: str, root: dict, most: int, among: int | None = None) -> tuple[Entry, int] | None:
        size = len(word)
        masks: dict[str, int] = {}
        for j, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << j
        full, end = (2 << size) - 1, 1 << size
        best: tuple[int, float, Entry] | None = None
        # Bit j of states[e]: the letters so far match the first j of the word with e edits.
        start = tuple((2 << e) - 1 for e in range(most + 1))
        todo = [(root, start, None, 0)]
        while todo:
            node, states, before, last = todo.pop()
            for letter, child in node.items():
                if letter == BELOW:
                    continue
                if letter == "":
                    for e in range(1, budget(len(child.text)) + 1):
                        # A beginning may end anywhere in the word.
                        if e <= most and (states[e] if child.stem else states[e] & end):
                            if best is None or (e, -child.lean) < best[:2]:
                                best = (e, -child.lean, child)
                            break
                    continue
                if among is not None and not child[BELOW] & among:
                    continue
                mask = masks.get(letter, 0)
                moved = [(states[0] & mask) << 1]
                for e in range(1, most + 1):
                    under = states[e - 1]
                    now = (states[e] & mask) << 1 | under << 1 | under | moved[e - 1] << 1
                    if before is not None:  # this letter and the one before it swapped
                        now |= ((before[e - 1] & mask) << 1 & last) << 1
                    moved.append(now & full)
                if any(moved):
                    todo.append((child, tuple(moved), states, mask))
        return (best[2], best[0]) if best else None


#: Words a worker remembers, and their letters.
REMEMBERED, REMEMBERED_LETTERS = 150_000, 2_500_000
#: Texts whose new words are matched together.
TOGETHER = 64
_MATCHERS: dict[tuple[Entry, ...], Matcher] = {}


def matcher(entries: tuple[Entry, ...]) -> Matcher:
    """This worker's matcher for a lexicon, with the words it has met."""
    claim("toxicity", _MATCHERS.clear)
    if entries not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[entries] = Matcher(entries)
    return _MATCHERS[entries]


class Matcher:
    """Features of texts; words met before are remembered, within bounds."""

    def __init__(self, entries: Sequence[Entry], remembered: int = REMEMBERED):
        self.lexicon, self.remembered = Lexicon(entries), remembered
        self.known: set[str] = set()
        self.letters = 0
        self.found: dict[str, tuple[Entry, int]] = {}

    def learn(self, words: Sequence[str]) -> None:
        """Match words that are not known yet, each once."""
        bare = [w.strip(EDGES) for w in words]
        near = self.lexicon.candidates(bare)
        for i, (word, core) in enumerate(zip(words, bare, strict=True)):
            entry = self.lexicon.match(core, True, near.get(i, 0))
            if entry is not None:
                self.found[word] = entry
        self.known.update(words)  # a text's own words are needed at once, however long
        self.letters += sum(map(len, words))

    def all_features(self, texts: Sequence[str | None]) -> list[list[float]]:
        """Features of some texts; the words that are new in several of them are learned
        together."""
        out: list[list[float]] = []
        for start in range(0, len(texts), TOGETHER):
            part = [(text or "").lower() for text in texts[start : start + TOGETHER]]
            if len(self.known) > self.remembered or self.letters > REMEMBERED_LETTERS:
                self.known.clear()
                self.found.clear()
                self.letters = 0
            new: set[str] = set()
            for text in part:
                new.update(text.split())
            self.learn(sorted(new - self.known))
            out += map(self._features, part)
        return out

    def features(self, text: str | None) -> list[float]:
        return self.all_features([text])[0]

    def _features(self, text: str) -> list[float]:
        words = text.split()
        found = self.found
        hits = [(at, *found[word]) for at, word in enumerate(words) if word in found]
        if not hits:
            return [0.0] * len(FEATURES)
        plain = weight = stems = near = quoted = faint = 0.0
        strongest = 0.0
        open_before = self._open_quotes(words) if any(q in text for q in QUOTES) else None
        strong = [hit for hit in hits if not weak(*hit[1:])]
        for at, entry, edits in hits:
            is_weak = weak(entry, edits)
            if self._is_quoted(words, at, open_before):
                quoted += not is_weak
                continue
            if is_weak:
                faint += 1
                continue
            # A misspelled term counts as a hit; how far to trust it is learned apart.
            near += edits > 0
            stems += entry.stem
            plain += not entry.stem
            value = entry.lean / (1 + edits / 4)
            weight += value
            strongest = max(strongest, value)
        kinds = len({entry.text for _, entry, _ in strong})
        return [
            math.log1p(plain), math.log1p(weight), math.log1p(stems), math.log1p(near), math.log1p(quoted),
            quoted / max(1, len(strong)), math.log1p(kinds), math.sqrt(len(strong) / len(words)), strongest,
            math.log1p(faint), math.sqrt(faint / len(words)),
        ]

    @staticmethod
    def _open_quotes(words: list[str]) -> list[bool]:
        """Whether a quotation is open before each word."""
        state, out = False, []
        for word in words:
            out.append(state)
            if sum(word.count(q) for q in QUOTES) % 2:
                state = not state
        return out

    @staticmethod
    def _is_quoted(words: list[str], at: int, open_before: list[bool] | None) -> bool:
        around = words[max(0, at - WINDOW) : at + WINDOW + 1]
        reported = any(w.strip(EDGES) in REPORTING for w in around)
        if open_before is None:
            return False
        marked = open_before[at] or any(q in words[at] for q in QUOTES)
        return marked and (reported or open_before[at] or words[at].count('"') == 2)


@dataclass(frozen=True)
class Model:
    """The lexicon and the weights of the logistic model: bias first, then the features."""

    entries: tuple[Entry, ...]
    weights: tuple[float, ...]


def entries_of(text: str | None) -> set[tuple[str, bool]]:
    """(word or word beginning, whether it is a beginning) of a text, each once."""
    words = {w.strip(EDGES) for w in set((text or "").lower().split())}
    found = {(w, False) for w in words if len(w) >= 3}
    for n in STEMS:
        found.update((w[:n], True) for w in words if len(w) > n)
    return found


def text_counts(texts: DataFrame, among: DataFrame | None = None, name: str = "n") -> DataFrame:
    """(entry, stem, n0, n1, ...): texts of each fold with a word or beginning; only those ``among``, if given.

    Counts are added up inside each task before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in range(FOLDS)]

        def closed() -> Iterator[pa.RecordBatch]:
            for fold, counts in enumerate(held):
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                        pa.array([fold] * len(keys), pa.int32()), pa.array(list(counts.values()), pa.int64()),
                    ],
                    names=["entry", "stem", "fold", "n"],
                )
                counts.clear()

        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[fold].update(entries_of(text))
                if sum(map(len, held)) > 400_000:
                    yield from closed()
        yield from closed()

    partial = texts.select("text", "fold").mapInArrow(count, "entry string, stem boolean, fold int, n bigint")
    if among is not None:
        partial = partial.join(among.select("entry", "stem"), ["entry", "stem"], "left_semi")
    return partial.groupBy("entry", "stem").agg(
        *(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"{name}{f}") for f in range(FOLDS))
    )


def learn_lexicons(
    texts: DataFrame, min_texts: int = MIN_TEXTS, min_lean: float = MIN_LEAN
) -> tuple[list[Entry], list[list[Entry]]]:
    """The lexicon of (text, label, fold), and for each fold that of all others.

    What leans too little for each of them is left out before the driver takes the counts.
    """
    toxic, other = [0] * FOLDS, [0] * FOLDS
    for r in texts.groupBy(F.col("label") == 1, "fold").count().collect():
        (toxic if r[0] else other)[r["fold"]] = r["count"]
    if not sum(toxic) or not sum(other):
        return [], [[] for _ in range(FOLDS)]
    held = [[f for f in range(FOLDS) if f != out] for out in (None, *range(FOLDS))]

    def total(name: str, folds: list[int]) -> Column:
        return sum((F.col(f"{name}{f}") for f in folds[1:]), F.col(f"{name}{folds[0]}"))

    def leans(folds: list[int]) -> Column:
        """The driver decides; the margin leaves it what rounds differently."""
        n, m = total("n", folds), total("m", folds)
        rates = ((n + 0.5) / (sum(toxic[f] for f in folds) + 1)) / ((m + 0.5) / (sum(other[f] for f in folds) + 1))
        return (n >= min_texts) & (F.log(rates) >= min_lean - 1e-6)

    often = materialize(text_counts(texts.where("label = 1")).where(total("n", held[0]) >= min_texts))
    both = often.join(text_counts(texts.where("label <> 1"), often, "m"), ["entry", "stem"], "left").na.fill(0)
    kept = both.where(reduce(or_, map(leans, held))).collect()

    def lexicon(folds: list[int]) -> list[Entry]:
        return merged(
            {
                (r["entry"], r["stem"]): (sum(r[f"n{f}"] for f in folds), sum(r[f"m{f}"] for f in folds))
                for r in kept
            },
            sum(toxic[f] for f in folds), sum(other[f] for f in folds), min_texts, min_lean,
        )

    return lexicon(held[0]), [lexicon(folds) for folds in held[1:]]


def merged(
    counts: dict[tuple[str, bool], tuple[int, int]], toxic: int, other: int, min_texts: int, min_lean: float
) -> list[Entry]:
    """Words and beginnings that lean to toxic texts, from the toxic and other texts that hold each.

    A beginning is used only where no shorter one is. Words stay beside the beginnings they
    have, as only whole words tell most misspellings.
    """
    leans = {
        key: math.log((n + 0.5) / (toxic + 1.0)) - math.log((m + 0.5) / (other + 1.0))
        for key, (n, m) in counts.items() if n >= min_texts
    }
    leans = {key: lean for key, lean in leans.items() if lean >= min_lean}
    most: Counter = Counter()
    for text, stem in leans:
        if not stem:
            for n in STEMS:
                most[text[:n]] = max(most[text[:n]], counts[text, stem][0])
    chosen: list[Entry] = []
    taken: set[str] = set()
    for text, stem in sorted(leans, key=lambda k: (not k[1], len(k[0]), k[0])):
        if stem:
            if any(text[:n] in taken for n in STEMS):
                continue
            # A beginning whose texts nearly all hold one word is that word.
            if most[text] >= 0.9 * counts[text, stem][0]:
                continue
            taken.add(text)
        chosen.append(Entry(text, stem, leans[text, stem]))
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton's method, the bias first and not penalized."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(texts: DataFrame, lexicons: Sequence[Sequence[Entry]]) -> DataFrame:
    """(features, label) of every (text, label, fold), matched with the lexicon of its fold."""
    held = [tuple(entries) for entries in lexicons]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[int, Matcher] = {}
        for batch in batches:
            texts, folds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found: list = [None] * len(texts)
            for fold in sorted(set(folds)):
                if fold not in matchers:
                    matchers[fold] = Matcher(held[fold], 30_000)
                mine = [i for i, f in enumerate(folds) if f == fold]
                for i, row in zip(mine, matchers[fold].all_features([texts[i] for i in mine]), strict=True):
                    found[i] = row
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["features", "label"]
            )

    return texts.select("text", "label", "fold").mapInArrow(features, "features array<double>, label int")


def learn(labelled: DataFrame) -> Model:
    """Learn from (id, text, label), a table that holds the sample to fit on.

    Rows with a null label are left out. Without rows of both labels the model knows no
    terms and scores everything near the one label there is, near 0 if there is none.
    """
    rows = labelled.select(
        "text", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    ).where("label is not null")
    entries, others = learn_lexicons(rows)
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    found = _featured(spread, others).collect()
    y = np.array([float(r["label"] == 1) for r in found])
    if not len(y) or y.min() == y.max():
        bias = 8.0 if len(y) and y.min() == 1 else -8.0
        return Model(tuple(entries), (bias, *[0.0] * len(FEATURES)))
    x = np.array([r["features"] for r in found])
    return Model(tuple(entries), tuple(float(w) for w in fit_logistic(x, y)))


def scored(text: Column, model: Model) -> Column:
    """Score of a text column between 0 and 1; null counts as empty."""
    entries, weights = tuple(model.entries), np.array(model.weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = matcher(entries)
        for batch in batches:
            texts = batch.to_pylist()
            x = np.array([[1.0, *f] for f in known.all_features(texts)]).reshape(-1, len(weights))
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return score(text)


def score_documents(
    docs: DataFrame, model: Model, text_col: str = "text", name: str = "score"
) -> DataFrame:
    """Add the toxicity score of every text.

    The text alone decides: null counts as empty, equal texts score alike, a column that
    bears the name is replaced, and empty tables stay empty.
    """
    return docs.withColumn(name, scored(F.col(text_col), model))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(text, label) of a sample of the labelled documents that may be learned from, written.

    Labelled ids are drawn by a hash of the id, so that about ``fit_rows`` at most come
    into the sample; all of them do if there are no more. A document with contradicting
    labels counts as toxic, and rows that repeat an id are all used.
    """
    known = materialize(
        labels.where(~held_out(F.col(id_col))).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id__")).agg(F.max(label_col).cast("int").alias("label"))
    )
    share = min(1.0, fit_rows / max(1, known.count()))
    parts = 1 << 20
    drawn = known.where(F.pmod(F.xxhash64(F.col("id__").cast("string")), F.lit(parts)) < share * parts)
    # The sample is bounded by ``fit_rows``.
    texts = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text"))
    # Copies would count as evidence of their own; of equal texts one is enough.
    return materialize(
        texts.join(F.broadcast(drawn), "id__").groupBy("text").agg(F.max("label").alias("label"))
    )
