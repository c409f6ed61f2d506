"""Token ids of whole texts by a word-level BPE whose pre-tokenizer drops white space."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 400_000
_JOINED = 4_000


class WordEncoder:
    """Ids of batches of texts; each distinct word is encoded once while the cache of ``MOST_WORDS`` holds it.

    The tokenizer lowers case, drops white space and never joins a letter or a digit with the punctuation after
    it, so a text may be cut at both places and its words encoded by themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {"": 0}
        self.sizes = np.zeros(1, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Letters only make one pre-token, so many such words are encoded as one text; others one by one."""
        array = pa.array(words, pa.string())
        plain = pc.match_substring_regex(array, r"^\p{L}+$")
        simple, other = array.filter(plain).to_pylist(), array.filter(pc.invert(plain)).to_pylist()
        ids, sizes, known = [self.ids], [self.sizes], []
        for at in range(0, len(simple), _JOINED):
            part = simple[at : at + _JOINED]
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            counts = np.bincount(np.asarray(made.word_ids, np.int64), minlength=len(part))
            if len(counts) != len(part) or not counts.all():
                other += part  # normalisation has split a word
                continue
            known += part
            ids.append(np.asarray(made.ids, np.uint32))
            sizes.append(counts)
        for at in range(0, len(other), _JOINED):
            part = other[at : at + _JOINED]
            made = [x.ids for x in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            known += part
            ids.append(np.asarray([i for x in made for i in x], np.uint32))
            sizes.append(np.asarray([len(x) for x in made], np.int64))
        self.codes.update(zip(known, range(len(self.codes), len(self.codes) + len(known))))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; null has none.

        A text that holds the string of a special token, which is one id wherever it stands, is encoded whole.
        """
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode(texts)
        ids, sizes = self._encode(pc.if_else(pa.array(odd), "", texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for row in np.flatnonzero(odd).tolist():
            parts[row] = np.asarray(self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(part) for part in parts], np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(
            pc.ascii_lower(texts), pattern=r"([\p{L}\p{N}])([!-/:-@\[-`{-~])", replacement=r"\1 \2"
        )
        lists = pc.ascii_split_whitespace(cut)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.codes) + len(distinct) > MOST_WORDS:
            self._forget()
        new = [w for w in distinct if w not in self.codes]
        if new:
            self._learn(new)
        codes = np.fromiter((self.codes[w] for w in distinct), np.int64, len(distinct))
        codes = codes[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        sizes = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return self.ids[at], np.diff(ends[bounds.astype(np.int64)])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so its cache outlives a task."""
    return WordEncoder(path)
