"""Token ids of whole texts by a public tokenizer, with the ids of repeated words kept."""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from kinspark.llm.text import texts

TOKENIZER = "word_bpe_49k.json"
# Bytes of remembered pieces and ids; pieces of more characters are not remembered.
KEPT_BYTES = 64 * 1024 * 1024
KEPT_LENGTH = 64
# Bytes of text to encode at once: more have fewer distinct pieces a byte, and larger work arrays.
ENCODED_BYTES = 8 << 20
_ENTRY = 100
# Texts that are not made lower case beforehand.
_AS_IS = r"<\||[^\x{00}-\x{ff}]"
# Small letters of Latin-1, then signs that the tokenizer keeps together and never splits a word at.
_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_SIGNS = "!#$%&()*+,./:;?@-"
_RUNS = rf"^[{_LETTERS}]+[{_SIGNS}]*$"
_WORD = re.compile(f"[{_LETTERS}]+")
_PROBES = ("reading", "caf\xe9", "stra\xdfe", "...", "?!")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]


def tokenizer_json(name: str = TOKENIZER, path: str | None = None) -> str:
    """The tokenizer's definition, read on the driver and sent to the tasks."""
    with open(path or public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of these ranges, one range after the other."""
    ends = np.cumsum(sizes)
    index = np.repeat(starts - ends + sizes, sizes)
    index += np.arange(len(index))
    return values[index]


class WordEncoder:
    """Ids of texts for a tokenizer whose tokens never span white space.

    Of the texts of a call, the library encodes each distinct piece between ASCII white space
    once, and a word and the signs behind it apart; the ids of the most recent ones of up to
    ``KEPT_LENGTH`` characters, ``kept`` bytes of them, and of as many before them, are
    remembered. This equals encoding the whole text, because the tokenizer drops white space
    and splits at it; a piece with other white space goes to the library as it is. Text of
    Latin-1 characters is made lower case first (what the tokenizer does as well), unless it
    could hold a special token.
    """

    def __init__(self, definition: str, kept: int = KEPT_BYTES):
        self._tokenizer = Tokenizer.from_str(definition)
        self._limit, self._size = kept, 0
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.vocabulary = self._tokenizer.get_vocab_size()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self._alphabet = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(1, 256)}
        self._simple = all(self._word(p) == self._whole(p) for p in _PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, run: str) -> bytes:
        """One run of letters or of signs, by the tokenizer's model alone."""
        tokens = self._tokenizer.model.tokenize(run.translate(self._alphabet))
        return _PACK[len(tokens)](*[t.id for t in tokens]) if len(tokens) < len(_PACK) else self._whole(run)

    def _keep(self, piece: str, ids: bytes) -> None:
        self._known[piece] = ids
        self._size += getsizeof(piece) + getsizeof(ids) + _ENTRY

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct words, signs and other pieces; those of short ones are kept."""
        if self._size > self._limit:
            self._older, self._known, self._size = self._known, {}, 0
        found = list(map(self._known.get, parts))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            part = parts[k]
            short = len(part) <= KEPT_LENGTH
            ids = self._older.pop(part, None)
            if ids is None:
                ids = self._word(part) if short and self._simple and _WORD.fullmatch(part) else self._whole(part)
            found[k] = ids
            if short:
                self._keep(part, ids)
        return found

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one piece after the other, and where those of each start and how many they are."""
        runs = pc.and_(pc.match_substring_regex(pieces, _RUNS), self._simple)
        words = pc.if_else(runs, pc.utf8_rtrim(pieces, _SIGNS), pieces)
        signs = pc.if_else(runs, pc.utf8_ltrim(pieces, _LETTERS), "")
        parts = pa.concat_arrays([words, signs]).dictionary_encode()
        found = self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        order = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        ids = _taken(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[order], sizes[order])
        sizes = sizes[order].reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(sizes) - sizes, sizes

    def encode(self, rows: pa.Array | list[str]) -> list[bytes]:
        """The ids of every row, as little-endian unsigned 32-bit integers."""
        column = texts(pa.array(rows, pa.large_string()) if isinstance(rows, list) else rows)
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(column, _AS_IS), column, pc.utf8_lower(column)))
        pieces = split.flatten().dictionary_encode()
        ids, starts, sizes = self._pieces(pieces.dictionary)
        at = pieces.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[np.cumsum([0, *pc.list_value_length(split).to_numpy()])]
        whole = _taken(ids, starts[at], sizes[at]).tobytes()
        return [whole[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


@lru_cache(maxsize=1)
def shared_encoder(definition: str) -> WordEncoder:
    """The encoder of this Python worker, with what it remembers, for all tasks that the worker runs.

    It stays after a task, with its ``KEPT_BYTES`` twice at most.
    """
    return WordEncoder(definition)
