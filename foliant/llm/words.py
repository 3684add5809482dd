"""Exact fast encoding with the word-level BPE vocabulary, one library call per distinct word.

The vocabulary's normaliser turns white space into one space and its pre-tokeniser drops that space, so no token and no
normalisation step reaches across ASCII white space, and special strings contain none. The ids of a text are therefore
the ids of its words one after another, whatever a word contains.
"""

from __future__ import annotations

import re

import numpy as np

from foliant.llm.arrow import per_process

#: Words kept by one worker before it starts afresh; bounds its memory to some 300 MB.
MAX_WORDS = 1_000_000
_GROUP = 512
# A line is letters and punctuation that follows them, which never share a token, or any other word. No apostrophe, digit,
# part of a special string, or letter that becomes two characters in lower case is in the first two groups.
_LINE = re.compile(r"^([A-Za-zÀ-ÖØ-öø-\u012f\u0131-ſ]+)([.,;:!?*#%&$]*)$|^(.*)$", re.M)


def words_of(text: str) -> list[str]:
    """The parts of a text between single ASCII white space characters; may hold empty strings."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class _Index(dict):
    """word -> number; an unknown word gets the next number and is noted in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class _Pool:
    """Token ids of numbered words, flat."""

    def __init__(self) -> None:
        self.starts, self.counts, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        n, used = self.n + len(counts), self.used + len(flat)
        if n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(n, np.int64)])
            self.counts = np.concatenate([self.counts, np.zeros(n, np.int64)])
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.int32)])
        self.counts[self.n:n] = counts
        self.starts[self.n:n] = self.used + np.cumsum(counts) - counts
        self.flat[self.used:used] = flat
        self.n, self.used = n, used

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words in order, and how many each has."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.starts[numbers] - ends + counts, counts)
        return self.flat[places], counts


class WordEncoder:
    """Numbers words, encodes the new ones with the tokenizers library, and strings ids together."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(vocabulary.values()) + 1)
        for name, number in vocabulary.items():
            self.names[number] = name
        self.last = np.array([name.endswith("</w>") for name in self.names])
        self.cleared = 0
        self.clear()

    def clear(self) -> None:
        self.cleared += 1
        self.index, self.cores, self.pool, self.core_pool = _Index(), _Index(), _Pool(), _Pool()
        self.cores[""]  # number 0 stands for nothing
        self.cores.fresh.clear()
        self.core_pool.add(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def make_room(self, words: int | None = None) -> None:
        """Start afresh above so many words, by default MAX_WORDS. To be called between batches, while no word numbers are in use."""
        if len(self.index) > (MAX_WORDS if words is None else words):
            self.clear()

    def numbers(self, text: str) -> np.ndarray:
        """Word numbers of a text; cut at white space."""
        return self.numbers_of(words_of(text))

    def numbers_of(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, parts), np.int32, len(parts))

    def number(self, word: str) -> int:
        return self.index[word]

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words by number, and the count of each word."""
        self._learn()
        return self.pool.take(numbers)

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        if not fresh:
            return
        cores, tails, others = zip(*_LINE.findall("\n".join(fresh)), strict=True)
        cores = "\n".join(cores).lower().split("\n")  # as the normaliser does to these letters, each of which stays one
        parts = np.zeros((len(fresh), 3), np.int64)
        for column, words in enumerate((cores, tails, others)):
            parts[:, column] = np.fromiter(map(self.cores.__getitem__, words), np.int64, len(words))
            new, self.cores.fresh = self.cores.fresh, []
            for first in range(0, len(new), _GROUP * 64):
                self._encode(new[first:first + _GROUP * 64], together=column < 2)
        flat, counts = self.core_pool.take(parts.ravel())
        self.pool.add(flat, counts.reshape(-1, 3).sum(axis=1))

    def _encode(self, words: list[str], together: bool) -> None:
        """Groups of words go through the library as one text: every word gives at least one token that ends a word, so as
        many such tokens as words means that each word has exactly one, its last. Otherwise words are encoded singly."""
        groups = [words[i:i + _GROUP] for i in range(0, len(words), _GROUP)] if together else [words]
        encoded = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if together else [None]
        for group, whole in zip(groups, encoded, strict=True):
            ids = np.array(whole.ids if whole else [], np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if whole and len(ends) == len(group):
                self.core_pool.add(ids, np.diff(ends, prepend=0))
            else:
                singly = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(group, add_special_tokens=False)]
                self.core_pool.add(np.concatenate(singly), np.array([len(x) for x in singly]))


def word_encoder(path: str, words: int | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file, which keeps up to ``words`` words, MAX_WORDS by default."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = per_process(f"words:{path}", lambda: WordEncoder(path))
    encoder.make_room(words)
    return encoder


def encode_texts(encoder: WordEncoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts and the end of each text in them."""
    numbered = [encoder.numbers(text) for text in texts]
    words = np.array([len(n) for n in numbered])
    ids, counts = encoder.ids(np.concatenate(numbered) if numbered else np.zeros(0, np.int32))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, ends[np.cumsum(words)]
