"""Token ids of whole texts, encoded word by word with a cache.

The tokenizer splits at white space before it does anything that looks across characters, so the
ids of a text are those of its words in order. Words repeat; each process keeps the ids of words
it has met, in one growing array, and starts afresh at ``CACHED`` words to bound memory.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import words

TOKENIZER = "word_bpe_49k.json"
CACHED = 400_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text encoded at once. With 8 million a task took 200 MB beyond its input, with 2 million 78 MB, in the same time.
CHUNK = 2_000_000
LOW = 24
WHOLE = -1


def runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of an array one after the other, and where each begins in the result (one entry more)."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


def strings(values: pa.Array) -> list[str]:
    """As Python strings. By way of numpy it takes a tenth of the time of ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts with a tokenizer whose words are independent of each other."""

    _made: dict[str | None, WordEncoder] = {}

    @classmethod
    def of(cls, path: str | None = None) -> WordEncoder:
        """The process's encoder for a vocabulary file; None: the public word BPE."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Drops all words met so far."""
        # where a string's ids begin, and in the low bits how many there are; WHOLE: not to be encoded without what follows it
        self.cores: dict[str, int] = {}
        self.rests: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Appends ids; where they begin."""
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn_each(self, new: list[str], into: dict[str, int]) -> None:
        """Encodes strings one by one."""
        for i in range(0, len(new), 1000):
            own = new[i : i + 1000]
            for w, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                into[w] = (self._keep(np.array(e.ids, np.uint32)) << LOW) + len(e.ids)

    def _learn_cores(self, new: list[str]) -> None:
        """Encodes strings of letters. They end at their only end-of-word id, so many are one text."""
        letters = []
        for w in new:
            if w.isalpha() and w.lower().isalpha():  # a lower case with a mark of its own meets the punctuation after it
                letters.append(w)
            else:
                self.cores[w] = WHOLE
        for i in range(0, len(letters), 1000):
            own = letters[i : i + 1000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(own):
                starts = self._keep(ids) + np.concatenate([[0], cuts[:-1]])
                self.cores.update(zip(own, ((starts << LOW) + np.diff(cuts, prepend=0)).tolist(), strict=True))
            else:  # a letter that the tokenizer splits or drops
                self._learn_each(own, self.cores)

    def _forms(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words begin and how many there are, in two columns: those of a word's letters, then of its rest.

        Letters and the punctuation after them are encoded apart, as many words differ only in that and in
        case; Arrow tells them apart, so Python meets each string of letters once. Of other words all is rest.
        """
        if len(self.cores) + len(self.rests) + len(forms) > CACHED:
            self.forget()
        core = pc.ascii_lower(pc.ascii_rtrim(forms, PUNCTUATION))
        tail = pc.subtract(pc.binary_length(forms), pc.binary_length(core)).to_numpy(zero_copy_only=False)
        coded = core.dictionary_encode()
        distinct = strings(coded.dictionary)
        own = list(map(self.cores.get, distinct))
        lacking = [i for i, p in enumerate(own) if p is None]
        self._learn_cores([distinct[i] for i in lacking])
        for i in lacking:
            own[i] = self.cores[distinct[i]]
        place = np.array(own, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        whole = place == WHOLE
        rows = np.flatnonzero(whole | (tail > 0))
        # the last 0 characters of a word, as Python slices, are all of it
        rests = [w[-n:] for w, n in zip(strings(forms.take(pa.array(rows))), np.where(whole, 0, tail)[rows].tolist(), strict=True)]
        self._learn_each([w for w in dict.fromkeys(rests) if w not in self.rests], self.rests)
        places = np.zeros((len(forms), 2), np.int64)
        places[:, 0] = np.where(whole, 0, place)
        places[rows, 1] = [self.rests[w] for w in rests]
        return places >> LOW, places & ((1 << LOW) - 1)

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        coded, starts = words(texts)
        if not len(coded):
            return np.zeros(len(texts), np.int64)
        length = self._forms(coded.dictionary)[1].sum(1)
        return np.diff(np.concatenate([[0], np.cumsum(length[coded.indices.to_numpy(zero_copy_only=False)])])[starts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one entry more). Null: none."""
        coded, starts = words(texts)
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        at, n = self._forms(coded.dictionary)
        ids, _ = runs(self.ids, at.ravel(), n.ravel())  # of the distinct words, in a row
        length, word = n.sum(1), coded.indices.to_numpy(zero_copy_only=False)
        ids, ends = runs(ids, (np.cumsum(length) - length)[word], length[word])
        return ids, ends[starts]
