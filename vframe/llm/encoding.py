"""Exact word-memoised encoding with a ``tokenizers`` file.

A tokenizer that drops white space and looks at each white-space-delimited
chunk alone gives the same ids for a text as for its chunks in turn; whether
it does is read from the file's normalizer and pre-tokenizer. For such files
Arrow splits a slice of texts into chunks and numbers the distinct ones, only
these are looked up among the chunks that a worker has met, and numpy gathers
the ids. Chunks that are met for the first time are encoded by the library.
Other files encode whole texts. Either way the ids come from the library.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Chunks kept by a worker; beyond it those met least are dropped.
MAX_WORDS = 600_000
#: Longer chunks are encoded but not kept.
MAX_WORD_BYTES = 64
#: Bytes of text, or a single text, that are encoded together.
SLICE_BYTES = 2_000_000
#: Marks that are taken off a chunk's end.
MARKS = b".,;:!?|"
#: Letters that normalizing leaves as they are, but for their case: of ASCII and two Latin blocks, but two.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")
#: Words of plain letters that are encoded in one text, and texts that are encoded in one call.
TOGETHER, CALL = 2048, 8

# Parts of tokenizer files under which chunks are independent.
_SPACES = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, _SPACES)
_SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _parts(step: dict | None, name: str) -> list[dict]:
    if step is None:
        return []
    return step[name] if step["type"] == "Sequence" else [step]


def by_chunk(file: dict) -> bool:
    """Whether a tokenizer file encodes each white-space-delimited chunk alone and drops white space."""
    normal = _parts(file["normalizer"], "normalizers")
    split = [{k: v for k, v in s.items() if k != "trim_offsets"} for s in _parts(file["pre_tokenizer"], "pretokenizers")]
    return (
        all(s in _NORMALIZERS for s in normal)
        and len(split) == 2
        and split[0] in [{"type": "Split", "pattern": {"Regex": p}, "behavior": "Removed", "invert": True} for p in _SPLITS]
        and split[1] == _BYTES
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in file["added_tokens"])
        and not file["truncation"]
        and not file["padding"]
    )


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``values`` one after another."""
    end = np.cumsum(length, dtype=np.int32)
    at = np.repeat((start - (end - length)).astype(np.int32, copy=False), length)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


class Encoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.by_word = by_chunk(file)
        self.folds = {"type": "Lowercase"} in _parts(file["normalizer"], "normalizers")
        model = file["model"]
        suffix = model.get("end_of_word_suffix") if model["type"] == "BPE" and not model.get("dropout") else None
        vocabulary = model["vocab"] if suffix else {}
        #: of each id, whether it ends a word: with such a mark, words of letters can be encoded in one text
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        #: for words of plain letters in lower case, which neither normalizing nor splitting changes
        self.quick = Tokenizer.from_str(self.tokenizer.to_str())
        self.quick.normalizer = normalizers.Sequence([])
        self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last: dict[str, bool] = {}
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.start, self.length, self.met = (np.zeros(1 << 14, dtype=np.int32) for _ in range(3))
        self.used = 0  # of ids

    def _ids(self, tokenizer: Tokenizer, texts: list[str], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts, in calls of a bounded size, for the library's results are large."""
        parts, n = [np.zeros(0, dtype="<u4")], []
        for i in range(0, len(texts), at_once):
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
            n += map(len, ids)
            parts.append(np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4", count=sum(map(len, ids))))
        return np.concatenate(parts), np.array(n, dtype=np.int64)

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids(self.tokenizer, [t.decode("utf-8", "replace") for t in texts], CALL * TOGETHER if self.by_word else 256)

    def _letter(self, c: str) -> bool:
        """Whether a mark after this letter is cut from it, whatever is before: not where it is decomposed."""
        if c not in self.last:
            text = self.tokenizer.normalizer.normalize_str(f"a{c}.") if self.tokenizer.normalizer else f"a{c}."
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            self.last[c] = c.isalpha() and len(pieces) == 2 and pieces[1][0] == "."
        return self.last[c]

    def _letters(self, word: bytes) -> bool:
        """Whether a word is one run of letters, however it is normalized."""
        if word.isascii():
            return word.isalpha()
        text = word.decode("utf-8", "replace")
        return PLAIN.fullmatch(text) is not None or all(map(self._letter, text))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of chunks, in turn; words of plain letters go together in texts of many."""
        if not self.ends.any():
            return self._whole(words)
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter((PLAIN.fullmatch(t) is not None for t in texts), dtype=bool, count=len(words))
        own = [t.lower() if self.folds else t for t, p in zip(texts, plain.tolist(), strict=True) if p]
        ids, _ = self._ids(self.quick, [" ".join(own[i : i + TOGETHER]) for i in range(0, len(own), TOGETHER)], CALL)
        end = np.flatnonzero(self.ends[ids]) + 1
        other, n_other = self._whole([w for w, p in zip(words, plain.tolist(), strict=True) if not p])
        start, length = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        start[plain], length[plain] = np.concatenate(([0], end))[: len(own)], np.diff(end, prepend=0)  # each word has one end
        start[~plain], length[~plain] = len(ids) + np.cumsum(n_other) - n_other, n_other
        return gathered(np.concatenate((ids, other)), start, length), length

    def _keep(self, words: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        n, low = len(words), len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while low + n > len(self.start):
            self.start, self.length, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[low : low + n] = self.used + np.cumsum(length) - length
        self.length[low : low + n] = length
        self.met[low : low + n] = 0
        self.place.update(zip(words, range(low, low + n), strict=True))
        self.used += len(ids)

    def _add(self, words: list[bytes]) -> None:
        """Learns distinct chunks: from their parts, of which those met for the first time are encoded."""
        both = [x for w in words for x in self._cut(w)]
        if fresh := list(dict.fromkeys(x for x in both if x not in self.place)):
            self._keep(fresh, *self._words(fresh))
        at = np.fromiter(map(self.place.__getitem__, both), dtype=np.int64, count=len(both)).reshape(-1, 2)
        left = np.array([w not in self.place for w in words], dtype=bool)
        at, rest = at[left], [w for w, x in zip(words, left.tolist(), strict=True) if x]
        self._keep(rest, gathered(self.ids, self.start[at.ravel()], self.length[at.ravel()]), self.length[at].sum(axis=1))

    def _forget(self) -> None:
        """Keeps the half of the chunks that were met most, none of them long."""
        n = len(self.place)
        size = np.fromiter(map(len, self.place), dtype=np.int64, count=n)
        order = np.argsort(np.where(size > MAX_WORD_BYTES, -1, self.met[:n]), kind="stable")[-(MAX_WORDS // 2) :]
        order = np.sort(order[size[order] <= MAX_WORD_BYTES])
        words = [w for w, x in zip(self.place, np.isin(np.arange(n), order).tolist(), strict=True) if x]
        self.place.clear()
        start, length = self.start[order], self.length[order]
        kept = gathered(self.ids, start, length)
        self.ids[: len(kept)], self.used = kept, len(kept)
        self.length[: len(order)], self.start[: len(order)] = length, np.cumsum(length) - length
        self.met[: len(order)] = self.met[order] // 2
        self.place = dict(zip(words, range(len(words)), strict=True))

    def _cut(self, word: bytes) -> tuple[bytes, bytes]:
        """A chunk in two that are encoded alike apart, or a whole one and nothing."""
        if self.folds and word.isascii() and b"<|" not in word:  # a special token's text is matched before letters are folded
            word = word.lower()
        left = word.rstrip(MARKS)
        if not left or len(left) == len(word) or not self._letters(left):
            return word, b""
        return left, word[len(left) :]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        code, distinct = np.asarray(chunks.indices), chunks.dictionary.cast(pa.binary()).to_pylist()

        def places(words: list[bytes]) -> np.ndarray:
            return np.fromiter(map(self.place.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))

        at = places(distinct)
        if (at < 0).any():
            if len(self.place) + int((at < 0).sum()) > MAX_WORDS and self.place:
                self._forget()
                at = places(distinct)
            new = np.flatnonzero(at < 0)
            words = [distinct[i] for i in new.tolist()]
            self._add(words)
            at[new] = places(words)
        self.met[at] += 1
        start, length = self.start[at[code]], self.length[at[code]]
        end = np.concatenate(([0], np.cumsum(length)))[np.cumsum(np.concatenate(([0], pc.list_value_length(split).to_numpy())))]
        return gathered(self.ids, start, length), np.diff(end)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, their number for each row) of slices of a
        string column in turn; a null text is an empty one."""
        column = pc.fill_null(column, "")
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(column):
            done = int(size[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
            part = column.slice(low, high - low)
            yield (low, high, *(self._slice(part) if self.by_word else self._whole(part.cast(pa.binary()).to_pylist())))
            low = high


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
