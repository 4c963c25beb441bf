"""Encoding with a tokenizers-library file whose pre-tokenizer never joins text across white space.

Such a tokenizer gives for a text the concatenation of what it gives for its words. So each distinct word is encoded
once; texts are split, their words numbered and their ids assembled by array operations.
"""

from __future__ import annotations

import os
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that stay one letter each in lower case and take part in no composition, and ASCII marks but the apostrophe.
#: A word of only the ones or only the others is one piece for the pre-tokenizer, which always cuts between them.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ҁ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")
_BORDER = f"([{_LETTERS}])([{_MARKS}])"


def _byte_letters() -> np.ndarray:
    """Code point that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from
    256 on; the space stays, as it parts words here."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u4")
    table[own] = own
    others = np.flatnonzero(table == 0)
    table[others] = 256 + np.arange(len(others))
    table[32] = 32
    return table


class _Index(dict):
    """Word to its number; unseen words get the next number and are noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """Ids of whole texts by words; keeps at most max_words distinct words between calls (then starts afresh)."""

    def __init__(self, path: str, max_words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.lean = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # For plain words, which are lower-cased and mapped to byte letters before.
        self.lean.normalizer, self.lean.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.max_words = max_words
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self._reset()

    @staticmethod
    def _flat(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has.

        Plain words are joined by spaces and encoded in one call; their ends are told by the ids that end a
        word. Where these don't add up, and for all other words, a word is a text by itself.
        """
        is_plain = list(map(_PLAIN.fullmatch, words))
        plain = np.fromiter(map(bool, is_plain), bool, len(words))
        joined = " ".join(compress(words, is_plain)).lower().encode()
        flat, _ = self._flat(self.lean, [self.letters[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le")])
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != plain.sum():
            return self._flat(self.tokenizer, words)
        other, other_sizes = self._flat(self.tokenizer, [w for w, m in zip(words, is_plain, strict=True) if not m])
        sizes = np.zeros(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(stops, prepend=0), other_sizes
        out, mine = np.zeros(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        out[mine], out[~mine] = flat, other
        return out, sizes

    def _reset(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self, known: int) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        for i in range(0, len(fresh), 50_000):
            flat, sizes = self.segment(fresh[i : i + 50_000])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while known + len(sizes) > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[known : known + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.size[known : known + len(sizes)] = sizes
            self.used += len(flat)
            known += len(sizes)

    def _numbers(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word of all texts, and how many words each text has."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not (self.special and pc.any(pc.match_substring_regex(texts, self.special)).as_py()):
            texts = pc.replace_substring_regex(texts, _BORDER, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        counts = np.asarray(pc.fill_null(pc.list_value_length(split), 0)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)], counts

    def _words(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.max_words:
            self._reset()
        known = len(self.index)
        numbers, counts = self._numbers(texts)
        self._learn(known)
        return numbers, counts

    def counts(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Number of ids of each text; null has none."""
        words, per_text = self._words(texts)
        total = np.concatenate([[0], np.cumsum(self.size[words])])
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and n+1 offsets."""
        words, per_text = self._words(texts)
        sizes = self.size[words]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.start[words] - (ends - sizes), sizes)
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.ids[take], at


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file, made on first use."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
