"""Token ids of whole texts by a public tokenizer, a batch of texts at a time.

White space ends every token of this kind of tokenizer, case is lost, and points and commas behind a letter begin a token, so
a text is cut there, and every distinct stretch between is encoded once per worker; the ids of a batch are then gathered by numpy. Stretches are remembered up to a
bound, beyond which the memory starts anew, so memory does not grow with the corpus.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 800_000
BATCH_CHARS = 1_000_000
#: A Latin letter that lower-casing and composition leave without a mark, and the points that begin a token behind it.
_LETTER_THEN_POINT = r"([a-z0-9ß-öø-ÿ\x{100}-\x{12F}\x{131}-\x{17F}])([.,!?;:]+)"
#: Stretches that are one token run of this vocabulary: letters of Latin-1, which composition leaves as they are.
_PLAIN = re.compile(r"[a-zß-öø-ÿÀ-ÖØ-Þ]+").fullmatch


def _byte_signs() -> dict[int, int]:
    """The signs by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> bool:
    """Drops the encoder of this process; whether there was one."""
    had = encoder.cache_info().currsize > 0
    encoder.cache_clear()
    return had


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``known`` numbers the remembered stretches; their ids lie in ``flat`` from ``starts`` on."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts = np.zeros(2, np.int64)

    def _add(self, new: list[str]) -> None:
        """Remembers stretches. Latin letters alone are one token's worth of bytes for the model; all else takes the whole way."""
        ids: list[int] = []
        lengths: list[int] = []
        odd: list[str] = []
        known, tokenize = self.known, self.model.tokenize
        for s in new:
            if _PLAIN(s):
                got = [t.id for t in tokenize(s.lower().encode().decode("latin-1").translate(_BYTE_SIGNS))]
                known[s] = len(known)
                ids += got
                lengths.append(len(got))
            else:
                odd.append(s)
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            for s, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[s] = len(known)
                ids += e.ids
                lengths.append(len(e.ids))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.empty_like(self.flat)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.r_[self.starts, self.used + np.cumsum(lengths, dtype=np.int64)]
        self.used += len(ids)

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        new = [s for s in distinct if s not in known]
        if new:
            self._add(new)
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text begins there, with the end."""
        column = pc.replace_substring_regex(pc.ascii_lower(pa.array(texts, pa.large_string())), _LETTER_THEN_POINT, r"\1 \2")
        lists = pc.ascii_split_whitespace(column)
        offsets = np.asarray(lists.offsets, np.int64)
        words = lists.flatten().dictionary_encode()
        number = self._numbers(words.dictionary.to_pylist())
        if not len(number):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        which = number[np.asarray(words.indices)]
        starts = self.starts[which]
        n = self.starts[which + 1] - starts
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(starts - ends + n, n)
        return self.flat[places], np.r_[0, ends][offsets]

    def batches(self, texts: list[str | None]):
        """(number of the first text, ids, begins) for runs of texts of bounded size together."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BATCH_CHARS or i == len(texts) - 1:
                yield first, *self.encode([x or "" for x in texts[first : i + 1]])
                first, size = i + 1, 0
