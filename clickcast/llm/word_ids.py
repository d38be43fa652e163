"""Token ids of texts, word by word, for vocabularies that drop white space.

White space ends every token of such a vocabulary, so the ids of a text are those
of its words one after the other.  Arrow splits a batch of texts and numbers its
distinct words; each distinct word is looked up once a batch, and numpy writes the
ids of all words in one pass.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the longest texts handled together, and of the words a worker remembers.
BATCH_CHARS = 1 << 20
CACHE_BYTES = 96 << 20
#: Words encoded in one text: the encoder's own record of a token is far larger than its id.
LEARN_WORDS = 2_000
#: What a remembered word costs besides its characters: dictionary entry, string header, table rows.
WORD_BYTES = 160


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(vocabulary: str):
    """The tokenizers library's own encoder, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``values[start[0]:start[0] + length[0]]``, then the next run, and so on."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - length), length) + np.arange(total)]


class WordIds:
    """Encodes texts; remembers the ids of about ``CACHE_BYTES`` of words.

    A word is looked up without its closing punctuation, whose ids follow: a letter always
    ends a token before punctuation.  Only plain Latin letters count here, since they stay
    single letters under the vocabulary's normal forms.
    """

    MARK = "\x01"
    STEM = r"^.*[A-Za-zÀ-ÖØ-öø-ÿ]"
    CLOSING = r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?]+$"

    def __init__(self, vocabulary: str):
        self.tokenizer = load_tokenizer(vocabulary)
        mark = self._direct([self.MARK])[0]
        if len(mark) != 1:
            raise ValueError("the vocabulary must encode the mark as one id")
        self.mark = int(mark[0])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.held = 0
        self.ids = np.empty(0, dtype="<u4")
        self.start = np.zeros(1, dtype=np.int64)
        self.length = np.zeros(1, dtype=np.int64)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in got]

    def _learn(self, new: list[str]) -> None:
        """Number the words of ``new``; plain ones are encoded in one text, a mark between them."""
        plain = [w for w in new if self.MARK not in w and "<|" not in w]
        rest = [w for w in new if self.MARK in w or "<|" in w]
        rows = []
        for at in range(0, len(plain), LEARN_WORDS):
            some = plain[at:at + LEARN_WORDS]
            ids = self._direct([f" {self.MARK} ".join(some)])[0]
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(some) - 1:
                rows += np.split(np.delete(ids, marks), marks - np.arange(len(marks)))
            else:
                rows += self._direct(some)
        rows += self._direct(rest) if rest else []
        self.index.update(zip([*plain, *rest], range(len(self.index), len(self.index) + len(new)), strict=True))
        length = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, *rows])
        self.start = np.concatenate([self.start, start])
        self.length = np.concatenate([self.length, length])
        self.held += WORD_BYTES * len(new) + 2 * sum(map(len, new)) + 4 * int(length.sum())

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, new ones learned."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.index]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.index.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return number[np.asarray(coded.indices, dtype=np.int64)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and len(texts) + 1 offsets into them."""
        if self.held > CACHE_BYTES:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, type=pa.large_string()))
        bounds = np.asarray(split.offsets, dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        if not len(coded.dictionary):
            return np.empty(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        words = coded.dictionary
        closed = pc.match_substring_regex(words, self.CLOSING)
        stems = pc.if_else(closed, pc.utf8_rtrim(words, ".,;:!?"), words)
        stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        tail = np.zeros(len(words), dtype=np.int64)
        tail[np.asarray(closed)] = self._numbers(pc.replace_substring_regex(words.filter(closed), self.STEM, ""))
        part = np.stack([self._numbers(stems), tail], axis=1)
        part = part[np.asarray(coded.indices, dtype=np.int64)].ravel()
        length = self.length[part]
        ends = np.concatenate([[0], np.cumsum(length)])
        return gather(self.ids, self.start[part], length), ends[2 * (bounds - bounds[0])]


#: One encoder a Python worker, so that its words outlive a task.
_ENCODERS: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = WordIds(vocabulary)
    return _ENCODERS[vocabulary]
