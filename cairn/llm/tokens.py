"""Token ids of whole texts by a public tokenizer, through the distinct pieces of a block of texts.

Pre-tokenizers never join what a single space or line feed between two visible characters separates, nor a letter and the
marks after it, so a text's ids are the concatenated ids of such pieces, and pieces repeat.  Arrow splits a block of texts
and finds its distinct pieces; those not met before go to the library, many of them joined to one text, in which the bytes
of the tokens tell where a piece ends.  Texts with other white space take a slower split that only cuts where that is safe.

Remembered pieces are Arrow and numpy arrays of at most ``limit`` bytes; beyond, only those of the current block stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from cairn.llm.shared import blocks

#: White space of Python's and of the tokenizers' patterns, and characters that either may count as such.
_SPACE = r"\s᠎​﻿\x1c-\x1f"
_CUT = re.compile(rf"(?<=[^{_SPACE}])(?=[ \n][^{_SPACE}])")

#: A text of the quick split has no white space but single spaces and line feeds between visible characters, and no \0.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]\z|[\x00-\x09\x0B-\x1F]|[\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Pieces that keep their length in bytes when lower-cased and composed, and that no neighbour changes.
_JOINABLE = r"\A[ \n]?[\x21-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+\z"
_ENDED = r"\A(?P<stem>(?s:.*)[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])(?P<marks>[.,!?;:%$&#*]+)\z"


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, one row after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


class PieceEncoder:
    """ids of texts; ``limit`` bounds the bytes of what is remembered, ``block`` those of the texts split at a time."""

    def __init__(self, path: str, limit: int = 12 << 20, block: int = 2 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.limit, self.block = path, limit, block
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = self.tokenizer.normalizer is None  # spaces are part of its tokens
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"] or ""
        self.special = [t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes: a token has one sign for each
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token.removesuffix(suffix)) if suffix else len(token)
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _by_library(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of distinct pieces."""
        joinable = pc.match_substring_regex(pieces, _JOINABLE)
        for s in self.special:
            joinable = pc.and_not(joinable, pc.match_substring(pieces, s))
        joinable = _flags(joinable)
        by, found, counts = [], [], np.zeros(len(pieces), np.int64)
        alone = [np.flatnonzero(~joinable)]
        rows = np.flatnonzero(joinable)
        own = pieces.take(pa.array(rows))
        bare = ~_flags(pc.match_substring_regex(own, r"\A[ \n]"))
        if self.byte_level:  # a line feed before a bare piece is a token that is taken out again
            own = pc.if_else(pa.array(bare), pc.binary_join_element_wise(_text("\n"), own, _text("")), own)
            size = pc.binary_length(own).to_numpy().astype(np.int64)
        else:
            size = pc.binary_length(own).to_numpy().astype(np.int64) - ~bare
        parts = [slice(a, a + 512) for a in range(0, len(rows), 512)]
        texts = [("" if self.byte_level else " ").join(own[p].to_pylist()) for p in parts]
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends, bounds = np.cumsum(self.width[ids]), np.cumsum(size[p])
            last = np.minimum(np.searchsorted(ends, bounds), len(ids) - 1)
            if last[-1] + 1 != len(ids) or (ends[last] != bounds).any():
                alone.append(rows[p])  # not as long as expected
                continue
            counts[rows[p]] = np.diff(last, prepend=-1)
            if self.byte_level and bare[p].any():
                ids = np.delete(ids, (last - counts[rows[p]] + 1)[bare[p]])
                counts[rows[p]] -= bare[p]
            by.append(rows[p])
            found.append(ids)
        by += alone
        alone = np.concatenate(alone)
        each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces.take(pa.array(alone)).to_pylist(), add_special_tokens=False)]
        counts[alone] = [len(x) for x in each]
        by = np.concatenate([x for x in by])
        # joined parts stand before the single ones in both lists
        pool, starts = np.concatenate([*found, *each, np.zeros(0, np.uint32)]), np.zeros(len(pieces), np.int64)
        starts[by] = np.cumsum(counts[by]) - counts[by]
        return pool[ragged(starts, counts)], counts

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, start in it and number of ids) of distinct pieces, remembered or not."""
        place = pc.index_in(pieces, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = pieces.filter(pa.array(place < 0))
        if len(new):
            ids, counts = self._by_library(new)
            place[place < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ends = np.concatenate([self.ends, np.cumsum(counts) + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        pool, ends = self.ids, np.concatenate([[0], self.ends]).astype(np.int64)
        starts, counts = ends[place], ends[place + 1] - ends[place]
        if self.words.nbytes + self.ids.nbytes + self.ends.nbytes > self.limit:
            self.words, self.ids, self.ends = pieces, pool[ragged(starts, counts)], np.cumsum(counts)
            if self.words.nbytes + self.ids.nbytes + self.ends.nbytes > self.limit:
                self.forget()
        return pool, starts, counts

    def _stemmed(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _distinct, but a letter and the marks at the end are looked up apart: they are never in one token."""
        parts = pc.extract_regex(pieces, _ENDED)
        ended = pc.is_valid(parts)
        stems = pc.if_else(ended, pc.struct_field(parts, "stem"), pieces)
        marks = pc.if_else(ended, pc.struct_field(parts, "marks"), _text(""))
        if not self.byte_level:  # the normalizer lower-cases
            stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        both = pa.concat_arrays([stems, marks]).dictionary_encode()
        pool, starts, counts = self._distinct(both.dictionary)
        at = both.indices.to_numpy().reshape(2, -1).T.ravel()
        total = counts[at].reshape(-1, 2).sum(1)
        return pool[ragged(starts[at], counts[at])], np.cumsum(total) - total, total

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces as the library may be asked for them, number of pieces of each text)."""
        if not self.byte_level:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return split.flatten(), pc.list_value_length(split).to_numpy()
        odd = _flags(pc.match_substring_regex(texts, _ODD))
        if odd.any():  # with \0 between the pieces; a text that holds \0 itself is one piece
            slow = iter(["\0".join(_CUT.split(t)) if "\0" not in t else None for t in texts.filter(pa.array(odd)).to_pylist()])
            whole = texts
            marked = pa.array([next(slow) if o else "" for o in odd], pa.large_string())
            texts = pc.if_else(pa.array(odd), _text(""), texts)
        split = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        if odd.any():
            split = pc.if_else(pa.array(odd), marked, split)
            single = pc.is_null(split)
            split = pc.split_pattern(pc.fill_null(split, _text("")), "\0")
            pieces, at = split.flatten(), split.offsets.to_numpy()[:-1]
            if pc.any(single).as_py():
                mask = np.zeros(len(pieces), bool)
                mask[at[_flags(single)]] = True
                pieces = pc.replace_with_mask(pieces, pa.array(mask), whole.filter(single))
            return pieces, pc.list_value_length(split).to_numpy()
        split = pc.split_pattern(split, "\0")
        return split.flatten(), pc.list_value_length(split).to_numpy()

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of the texts of a block, block by block."""
        for part in blocks(texts, self.block):
            pieces, n = self._pieces(part)
            unique = pieces.dictionary_encode()
            del pieces
            pool, starts, counts = self._stemmed(unique.dictionary)
            at = unique.indices.to_numpy()
            counts = counts[at]
            ends = np.concatenate([[0], np.cumsum(counts)])
            cuts = ends[np.concatenate([[0], np.cumsum(n)])]
            yield pool[ragged(starts[at], counts)], np.diff(cuts)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for a path in each Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
