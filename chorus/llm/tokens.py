"""Token ids of whole texts by the ``tokenizers`` library, fast enough for a corpus scan.

A text is cut at ASCII white space (the tokenizer drops white space, so no token spans it), equal
words are tokenised once per batch, and the ids are gathered back by index.  Plain words are put in
lower case and parted from the punctuation at their end (a piece of its own for the tokenizer), so
that "Word", "word" and "word." are tokenised once.  Plain letters and punctuation go straight to the
library's BPE model, piece by piece; all other words, and every other tokenizer file, go through the
library's full ``encode``.  Ids of words met before come from a bounded Arrow table.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokeniser and normaliser this module's shortcut is equal to.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE_MARKS = "^.*[a-z0-9ß-öø-ÿ]"
_CACHE_WORDS = 400_000


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1``, ... (``count`` numbers) of every row, end to end."""
    ends = np.cumsum(count, dtype=np.int64)
    at = np.repeat((first - (ends - count)).astype(np.int32), count)
    at += np.arange(len(at), dtype=np.int32)
    return at


def _byte_names() -> dict[int, str]:
    """The byte-to-character rule of byte-level BPE: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file.  ``encode`` returns all ids of a text column and each row's offset."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = norm == WORD_NORMALIZERS and WORD_PATTERN in pre
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.names = str.maketrans({chr(k): v for k, v in _byte_names().items()})
        self.known = pa.array([], pa.string())
        self.pool = np.zeros(0, self.dtype)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _piece(self, piece: str) -> list[int]:
        name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        return [t.id for t in self.model.tokenize(name)]

    def _word(self, word: str) -> list[int]:
        low = word.lower()
        if word.isascii() and low.isalpha():
            return self._piece(low)
        if _SIMPLE.match(word) and "<|" not in word:
            return [i for p in _PIECES.findall(low) for i in self._piece(p)]
        return self.tok.encode(word, add_special_tokens=False).ids if word else []

    def _look_up(self, words: pa.Array):
        """(first id, number of ids) of every one of different ``words``, and ids: words met before are looked
        up, new ones tokenised.  At most ``_CACHE_WORDS`` are kept (the first ones met, so the frequent ones);
        later words are tokenised once per batch.  Memory is bounded whatever the corpus holds."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        ids = [self._word(w) for w in new.to_pylist()]
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), self.dtype, int(n.sum()))])
        first = np.concatenate([self.first, len(self.pool) + np.cumsum(n, dtype=np.int64) - n])
        count = np.concatenate([self.count, n])
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        rows = np.empty(len(words), np.int64)
        rows[~fresh] = at.drop_null().to_numpy(zero_copy_only=False)
        rows[fresh] = len(self.known) + np.arange(len(new))
        room = min(len(new), _CACHE_WORDS - len(self.known))
        if room > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            keep = len(self.known)
            self.first, self.count = first[:keep], count[:keep]
            self.pool = pool[:int(first[keep - 1] + count[keep - 1])].copy()
        return first[rows], count[rows], pool

    def _parted(self, words: pa.Array):
        """(parts, part of every word, part of its end): the different parts that ``words`` are made of.

        A plain word that ends in a letter or a digit and punctuation marks is cut between them; there a piece
        of the tokenizer ends whatever follows.  Other words are whole, with an empty end."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        low = pc.if_else(plain, pc.utf8_lower(words), words)
        body = pc.if_else(plain, pc.utf8_rtrim(low, _MARKS), words)
        cut = pc.less(pc.binary_length(body), pc.binary_length(low))
        ends = pc.replace_substring_regex(low.filter(cut), _BEFORE_MARKS, "")
        coded = pa.concat_arrays([pa.array([""]), body, ends]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        end = np.full(len(words), codes[0], codes.dtype)
        end[cut.to_numpy(zero_copy_only=False)] = codes[1 + len(words):]
        return coded.dictionary, codes[1:1 + len(words)], end

    def _words(self, texts: pa.Array):
        """(first id, number of ids) of every word, the ids, and every row's word offset."""
        flat = pc.replace_substring(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), "\r", " ")
        split = pc.split_pattern(flat, " ")
        coded = split.values.dictionary_encode()
        parts, body, end = self._parted(coded.dictionary)
        was = gc.isenabled()
        gc.disable()  # nothing here is cyclic; collections would walk every new word
        try:
            first, count, pool = self._look_up(parts)
        finally:
            if was:
                gc.enable()
        both = np.stack([body, end], 1).ravel()  # the ids of a different word: its body's and its end's
        pool = pool[_ranges(first[both], count[both])]
        count = count[body] + count[end]
        first = np.cumsum(count, dtype=np.int64) - count
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return first.astype(np.int32)[codes], count[codes], pool, split.offsets.to_numpy()

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of every row, without building the ids."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return np.array([len(x.ids) for x in self._full(texts)], np.int64)
        _, n, _, rows = self._words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[rows])

    def _full(self, texts):
        return self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)

    def encode(self, texts: pa.Array, eos: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, row offsets); ``eos`` is appended to every row.  Nulls are empty texts."""
        texts = pc.fill_null(texts, "")
        tail = [] if eos is None else [eos]
        if len(texts) == 0:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if not self.by_word:
            rows = [np.array(x.ids + tail, self.dtype) for x in self._full(texts)]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        first, n, pool, rows = self._words(texts)
        ends = np.cumsum(n, dtype=np.int64)
        out = pool[_ranges(first, n)]
        offsets = np.concatenate([[0], ends])[rows]
        if eos is not None:
            out = np.insert(out, offsets[1:], eos)
            offsets = offsets + np.arange(len(offsets))
        return out, offsets


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker (loaded once; workers are reused between tasks)."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
