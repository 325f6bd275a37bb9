"""n-gram statistics of a batch of text pairs, as array arithmetic inside one task."""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters handled at a time (or one row): bounds a task's memory whatever the batch holds.
CHUNK_CHARS = 1 << 16
# Words whose tokens a task remembers between chunks.
KNOWN_WORDS = 100_000

PUNCTUATION = frozenset(string.punctuation)

# The mteval-v13a patterns and entities, as in functions.text.
PATTERNS = [
    (re.compile(r"([!-&(-+:-@\[-`{-~/])"), r" \1 "),
    (re.compile(r"([^0-9])([.,])"), r"\1 \2 "),
    (re.compile(r"([.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
# Marks that always stand alone at the end of a word.
ENDS = PUNCTUATION - {"-", "'"}


def clipped_matches(codes: np.ndarray, lengths: np.ndarray, max_order: int) -> np.ndarray:
    """Matches per pair and order.

    ``codes`` holds the symbols (dense ids) of hyp 0, ref 0, hyp 1, ref 1, ... one after the
    other, ``lengths`` the number of symbols of each of these sequences.
    Returns an int64 array of shape (pairs, max_order).
    """
    n_pairs = len(lengths) // 2
    if len(codes) == 0:
        return np.zeros((n_pairs, max_order), dtype=np.int64)
    bits = int(codes.max() + 1).bit_length()
    if n_pairs.bit_length() + bits * max_order + 1 <= 63:
        return _sorted_once(codes, lengths, max_order, bits)
    return _sorted_by_order(codes, lengths, max_order)


def _grams(symbols: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The gram of ``order`` symbols at each place, as one number: two halves side by side, and a last symbol if it is odd."""
    if order == 1:
        return symbols
    half = _grams(symbols, order // 2, bits)
    gram = (half[: len(half) - order // 2] << (bits * (order // 2))) | half[order // 2 :]
    return (gram[:-1] << bits) | symbols[order - 1 :] if order % 2 else gram


def _sorted_once(codes: np.ndarray, lengths: np.ndarray, max_order: int, bits: int) -> np.ndarray:
    """The longest gram of every position as one number (pair, symbols, side); sorted, grams of every order are runs of a common
    prefix, so one sort serves all orders."""
    n_pairs = len(lengths) // 2
    out = np.zeros((n_pairs, max_order), dtype=np.int64)
    # Symbols count from 1; zeros after each sequence fill the grams that reach over its end.
    sequence = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    at = np.arange(len(codes), dtype=np.int64) + sequence * (max_order - 1)
    padded = np.zeros(len(codes) + len(lengths) * (max_order - 1), dtype=np.int64)
    padded[at] = codes + 1
    gram = _grams(padded, max_order, bits)
    keys = np.sort((((sequence >> 1) << (bits * max_order) | gram[at]) << 1) | (sequence & 1))
    refs_before = np.zeros(len(keys) + 1, dtype=np.int64)
    np.cumsum(keys & 1, out=refs_before[1:])
    keys >>= 1
    change = keys[1:] ^ keys[:-1]
    cuts = np.flatnonzero(change)
    change = change[cuts]
    ends = np.cumsum(lengths[0::2] + lengths[1::2])  # places of a pair; all its grams lie together
    over = np.flatnonzero(keys & ((1 << bits) - 1) == 0)  # grams that reach over an end, of the longest order and below
    for order in range(max_order, 0, -1):
        below = bits * (max_order - order)
        if order < max_order:
            held = np.flatnonzero(change >= (1 << below))
            cuts, change = cuts[held], change[held]
            over = over[(keys[over] >> below) & ((1 << bits) - 1) == 0]
        runs = np.empty(len(cuts) + 2, dtype=np.int64)
        runs[0], runs[-1] = 0, len(keys)
        np.add(cuts, 1, out=runs[1:-1])
        refs = refs_before[runs]
        refs = refs[1:] - refs[:-1]
        found = np.minimum(refs, runs[1:] - runs[:-1] - refs)
        found[np.searchsorted(runs, over, side="right") - 1] = 0
        clipped = np.zeros(len(runs), dtype=np.int64)
        np.cumsum(found, out=clipped[1:])
        out[:, order - 1] = np.diff(clipped[np.searchsorted(runs, ends)], prepend=0)
    return out


def _sorted_by_order(codes: np.ndarray, lengths: np.ndarray, max_order: int) -> np.ndarray:
    """The same for alphabets too large for that: grams of one order are numbered and sorted after the other."""
    n_pairs = len(lengths) // 2
    out = np.zeros((n_pairs, max_order), dtype=np.int64)
    alphabet = int(codes.max()) + 1
    sequence = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    side = sequence & 1
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # symbols to the end
    # The gram starting at each position, as a number ordered by pair first. Grams that would
    # reach into the next sequence are numbered too but left out of the counting.
    gram, span = (sequence >> 1) * alphabet + codes, n_pairs * alphabet
    for order in range(1, max_order + 1):
        if order > 1:
            if span * alphabet >= 1 << 62:  # renumber, in the same order, before an overflow
                gram = np.unique(gram, return_inverse=True)[1].astype(np.int64)
                span = len(gram)
            gram = gram[:-1] * alphabet + codes[order - 1 :]
            span *= alphabet
        whole = left[: len(gram)] >= order
        sorted_ids = np.sort((gram << 1 | side[: len(gram)])[whole])
        if len(sorted_ids) == 0:
            break
        ids = sorted_ids >> 1
        runs = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
        refs = np.diff(np.concatenate(([0], np.cumsum(sorted_ids & 1)))[runs])
        clipped = np.concatenate(([0], np.cumsum(np.minimum(refs, np.diff(runs) - refs))))
        # Grams are ordered by pair, so each pair is a stretch of whole runs.
        per_sequence = np.maximum(lengths - (order - 1), 0)
        ends = np.cumsum(per_sequence[0::2] + per_sequence[1::2])
        out[:, order - 1] = np.diff(clipped[np.searchsorted(runs, ends)], prepend=0)
    return out


def _dense(symbols: np.ndarray) -> np.ndarray:
    """Symbols renumbered 0..k-1."""
    if len(symbols) == 0:
        return symbols
    seen = np.zeros(int(symbols.max()) + 1, dtype=bool)
    seen[symbols] = True
    found = np.flatnonzero(seen)
    rank = np.empty(len(seen), dtype=np.int64)
    rank[found] = np.arange(len(found))
    return rank[symbols]


def char_sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32).astype(np.int64), lengths


def peel(words: list[str]) -> list[str]:
    """One trailing ASCII punctuation mark split off each word, else one leading."""
    out: list[str] = []
    for word in words:
        if word[-1] in PUNCTUATION and len(word) > 1:
            out += word[:-1], word[-1]
        elif word[0] in PUNCTUATION and len(word) > 1:
            out += word[0], word[1:]
        else:
            out.append(word)
    return out


def tokens_13a(word: str) -> list[str]:
    """mteval-v13a tokens of one word; no pattern reaches over white space."""
    if word.isalnum():
        return [word]
    if word[-1] in ENDS and word[:-1].isalnum():
        return [word[:-1], word[-1]]
    word = f" {word} "
    for entity, char in ENTITIES:
        word = word.replace(entity, char)
    for pattern, replacement in PATTERNS:
        word = pattern.sub(replacement, word)
    return word.split()


def words_13a(text: str) -> list[str]:
    """Words of a text once what reaches over white space is done (as in ``functions.text.mark_13a``)."""
    if "-\n" in text or "<skipped>" in text:
        text = text.rstrip().replace("<skipped>", "").replace("-\n", "")
    return text.split()


def _appended(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` written from place ``used`` on; grows by doubling."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.empty(used + 2 * len(more), dtype=np.int64)])
    held[used : used + len(more)] = more
    return held


class Tokens:
    """Tokens of numbered words, as numbers: how many a word has, and from where in ``flat`` on."""

    def __init__(self) -> None:
        self.words, self.places = 0, 0
        self.first, self.count, self.flat = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, spelt: list[tuple[int, ...]]) -> None:
        count = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt))
        ends = np.cumsum(count) + self.places
        self.first = _appended(self.first, self.words, ends - count)
        self.count = _appended(self.count, self.words, count)
        size = int(count.sum())
        self.flat = _appended(self.flat, self.places, np.fromiter(chain.from_iterable(spelt), dtype=np.int64, count=size))
        self.words, self.places = self.words + len(spelt), self.places + size

    def sequences(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of sequences of words that lie one after the other, and the number of each sequence's."""
        count = self.count[words]
        ends = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(count, out=ends[1:])
        places = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(self.first[words] - ends[:-1], count)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[places], np.diff(ends[bounds])


class Words(dict):
    """word -> its number, given when it is first seen; then its tokens of each kind are made."""

    def __init__(self, kinds) -> None:
        self.kinds = [*kinds]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.numbers: dict[str, int] = {}  # token -> number, for all kinds
        self.tokens = {kind: Tokens() for kind in self.kinds}

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def _alike(self, word: str) -> tuple[int, ...] | None:
        """Tokens of a word that all kinds cut alike."""
        number = self.numbers.setdefault
        if word.isalnum():
            return (number(word, len(self.numbers)),)
        if word[-1] in ENDS and word[:-1].isalnum():
            return number(word[:-1], len(self.numbers)), number(word[-1], len(self.numbers))
        return None

    def numbered(self, word_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, one list after the other, and the lists' lengths."""
        lengths = np.fromiter(map(len, word_lists), dtype=np.int64, count=len(word_lists))
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(word_lists)), dtype=np.int64, count=int(lengths.sum()))
        alike, number = [*map(self._alike, self.fresh)], self.numbers.setdefault
        for kind, tokens in self.tokens.items():
            cut = CUTS[kind]
            tokens.add([a or tuple([number(t, len(self.numbers)) for t in cut(w)]) for a, w in zip(alike, self.fresh)])
        self.fresh.clear()
        return found, lengths


# How a word is cut, by kind.
CUTS = {"words": tokens_13a, "peeled": lambda word: peel([word])}


def known_words(kinds: list[str]) -> dict[str, Words]:
    """One list of words for all ``kinds``, by kind."""
    return dict.fromkeys(kinds, Words(kinds))


def _picked(codes: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences ``wanted``, one after the other, as dense ids."""
    starts, sizes = (np.cumsum(lengths) - lengths)[wanted], lengths[wanted]
    places = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return _dense(codes)[places], sizes


def _statistics(codes: np.ndarray, lengths: np.ndarray, wanted: np.ndarray, max_order: int) -> np.ndarray:
    """Per pair: hyp n-grams, ref n-grams and matches, each for orders 1..max_order."""
    codes, lengths = _picked(codes, lengths, wanted)
    matches = clipped_matches(codes, lengths, max_order)
    totals = np.maximum(lengths[:, None] - np.arange(max_order), 0).reshape(-1, 2 * max_order)
    return np.hstack([totals, matches])


def _chunk_statistics(hyps: list[str], refs: list[str], orders: dict[str, int], known: dict[str, Words]) -> dict[str, np.ndarray]:
    """Equal texts, such as one reference of many candidates, are split once, and their words looked up once for all kinds."""
    places: dict[str, int] = {}
    wanted = np.array([places.setdefault(t, len(places)) for pair in zip(hyps, refs) for t in pair], dtype=np.int64)
    split = [t.split() for t in places]
    own = np.arange(len(split))
    if "words" in orders:  # texts whose words for BLEU differ have a second list, at the end
        marked = [i for i, t in enumerate(places) if "-\n" in t or "<skipped>" in t]
        texts = [*places] if marked else []
        own[marked] = len(split) + np.arange(len(marked))
        both = split + [words_13a(texts[i]) for i in marked]
    else:
        both = split
    words = next((known[kind] for kind in orders if kind in known), None)
    numbered = None if words is None else words.numbered(both)
    out = {}
    for kind, max_order in orders.items():
        if kind == "chars":
            sequences = char_sequences(["".join(words_of) for words_of in split])
        else:
            sequences = words.tokens[kind].sequences(*numbered)
        out[kind] = _statistics(*sequences, own[wanted] if kind == "words" else wanted, max_order)
    return out


def _lengths(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        return pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.fromiter(map(len, column), dtype=np.int64, count=len(column))


def _texts(column, start: int, stop: int) -> list[str]:
    part = column[start:stop]
    return part.to_pylist() if isinstance(part, pa.Array) else [*part]


def batch_statistics(columns: list, orders: dict[str, int], known: dict[str, Words] | None = None) -> dict[str, np.ndarray]:
    """One row of statistics per pair, for each kind in ``orders``.

    ``columns``: hyp and ref texts, and texts for "words" after them where these differ; of Arrow columns only a chunk at a time
    becomes Python texts. ``known``: the words a task remembers, the same for all kinds.
    """
    known = {} if known is None else known
    wanted = [kind for kind in CUTS if kind in orders]
    if set(wanted) - set(known):
        known.update(known_words(wanted))
    sizes = sum(map(_lengths, columns))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_CHARS)) + 1
    own = {kind: n for kind, n in orders.items() if kind != "words" or len(columns) == 2}
    rows: dict[str, list[np.ndarray]] = {kind: [np.zeros((0, 3 * n), dtype=np.int64)] for kind, n in orders.items()}
    for start, stop in zip([0, *cuts], [*cuts, len(sizes)]):
        for kinds, sides in ((own, columns[:2]), ({k: n for k, n in orders.items() if k not in own}, columns[2:])):
            if kinds:
                for kind, found in _chunk_statistics(*[_texts(side, start, stop) for side in sides], kinds, known).items():
                    rows[kind].append(found)
        for words in known.values():
            if len(words) > KNOWN_WORDS:
                words.forget()
    return {kind: np.concatenate(found) for kind, found in rows.items()}
