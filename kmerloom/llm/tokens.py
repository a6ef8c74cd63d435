"""Token ids of whole texts with a tokenizer that sees every distinct piece of a word once."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Units whose ids a Python worker keeps, and their characters; beyond either the cache starts anew.
CACHE_UNITS, CACHE_CHARS = 400_000, 16 << 20
#: Bytes of text that are encoded at a time; more where distinct words are looked for.
SLICE_BYTES, WORD_SLICE_BYTES = 1 << 20, 4 << 20
#: Pieces that the tokenizer gets at a time.
LEARN_UNITS = 20_000

_BLANKS = " \t\n\x0b\x0c\r"
# Texts of these characters need no normalisation but lower case, and the tokenizer's pattern is plain on them.
_PLAIN = [chr(c) for c in range(0x21, 0x180) if unicodedata.category(chr(c)) not in ("Cc", "Cf", "Zs") and c != 0x130]
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_NOT_PLAIN = re.compile(f"[^{re.escape(''.join(_PLAIN))}{_BLANKS}]|<\\|")
#: The tokenizer's pattern (fixed) on such texts, and the line feeds between words.
_PIECES = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


def _byte_characters() -> dict[int, str]:
    """Byte-level models name a byte by its Latin-1 character if that is visible, else by the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()

_ENCODERS: dict[str, WordEncoder] = {}


class _Numbers(dict):
    """Numbers pieces as they are first looked up, and remembers the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class UnitEncoder:
    """Encodes texts unit by unit, each distinct unit once.

    A kind of encoder says how a text is cut (``_cut``) and what ids a unit
    has (``_ids``).  Units are numbered as they are first seen; the ids of
    all units lie in one flat array, from which those of a text are gathered.
    """

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.index = _Numbers()
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.n = self.chars = 0

    def _cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def _ids(self, unit: str) -> list[int]:
        raise NotImplementedError

    def _ids_of(self, units: list[str]) -> list[list[int]]:
        return list(map(self._ids, units))

    def _learn(self) -> None:
        units, self.index.fresh = self.index.fresh, []
        lists = self._ids_of(units)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        first = int(self.starts[self.n])
        end = first + int(lengths.sum())
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.starts) <= self.n + len(units):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[first:end] = np.fromiter(chain.from_iterable(lists), np.uint32, end - first)
        self.starts[self.n + 1 : self.n + 1 + len(units)] = first + np.cumsum(lengths)
        self.n += len(units)
        self.chars += sum(map(len, units))

    def encode(self, texts: Iterable[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """Per text its ids (uint32), with ``end_id`` behind them; null counts as empty."""
        if len(self.index) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self._reset()
        split = [self._cut(t or "") for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        units = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.index.fresh:
            self._learn()
        return _cut_by(counts, *_gather(self.flat, self.starts, units), end_id)


def _gather(flat: np.ndarray, starts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in a row, and where each unit ends among them; those of unit u lie from ``starts[u]`` to ``starts[u + 1]``."""
    lengths = starts[units + 1] - starts[units]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[units] - (ends - lengths), lengths) + np.arange(total)], ends


def _cut_by(counts: np.ndarray, ids: np.ndarray, ends: np.ndarray, end_id: int | None) -> list[np.ndarray]:
    """The ids text by text, from the number of units of each and where units end."""
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    return [np.concatenate([ids[a:b], tail]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class WordEncoder:
    """Encodes texts by the pieces that the tokenizer cuts first.

    The tokenizer cuts a text into words, numbers and runs of marks before
    it looks for tokens, so the ids of a text are those of these pieces in a
    row.  No token, special token or normalisation reaches over an ASCII
    space character, so the distinct space-separated words of many texts are
    cut once, all at a time; the ids of pieces are kept from call to call.
    Words of characters on which the cut is less plain are pieces with a
    space before them and go through the whole tokenizer instead.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the same model for pieces on lines of their own, and the ids of tokens that end a piece
        self.lines = Tokenizer.from_file(path)
        self.lines.normalizer = None
        self.lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        suffix = self.model.end_of_word_suffix
        self.last = np.zeros(self.lines.get_vocab_size(), bool)
        self.last[[i for t, i in self.lines.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        # unit 0 is the line feed, which has no ids
        self.known = pa.array(["\n"], pa.string())
        self.flat = np.empty(0, np.uint32)
        self.starts = np.zeros(2, np.int64)

    def _ids(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of plain pieces in a row and how many each has, some pieces at a time."""
        for lo in range(0, len(units), LEARN_UNITS):
            own = [u if u.isascii() else "".join(map(_BYTE_CHARACTERS.__getitem__, u.encode())) for u in units[lo : lo + LEARN_UNITS]]
            ids = np.array(self.lines.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own):  # a model that does not mark the ends of pieces
                lists = [[t.id for t in self.model.tokenize(u)] for u in own]
                yield np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64)
            else:
                yield ids, np.diff(ends, prepend=0)

    def _whole(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``_ids``, of words for the whole tokenizer."""
        for word in words:
            ids = np.array(self.tokenizer.encode(word[1:], add_special_tokens=False).ids, np.uint32)
            yield ids, np.array([len(ids)])

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Numbers new units, the plain ones first, and keeps their ids."""
        texts = units.to_numpy(zero_copy_only=False)
        plain = np.fromiter((u[:1] != " " for u in texts), bool, len(texts))
        got = list(chain(self._ids(texts[plain].tolist()), self._whole(texts[~plain].tolist())))
        self.flat = np.concatenate([self.flat, *(x[0] for x in got)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([x[1] for x in got]))])
        first = len(self.known)
        self.known = pa.concat_arrays([self.known, units.filter(pa.array(plain)), units.filter(pa.array(~plain))])
        return first + _place(plain)

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of units, which are learnt where they are new."""
        coded = pa.array(units, pa.string()).dictionary_encode()
        number = pc.index_in(coded.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = number < 0
        if new.any():
            number[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        return number[coded.indices.to_numpy()]

    def _words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and where each word starts among them (and the last one ends)."""
        lines, rare = "\n".join([*words, ""]), np.zeros(len(words), bool)
        if _NOT_PLAIN.search(lines) is not None:
            rare = np.fromiter((_NOT_PLAIN.search(w) is not None for w in words), bool, len(words))
            lines = "\n".join([*words[~rare], ""])
        units = _PIECES.findall(lines.lower())
        units += chain.from_iterable((" " + w, "\n") for w in words[rare])
        numbers = self._numbers(units)
        ids, ends = _gather(self.flat, self.starts, numbers)
        starts = np.concatenate([[0], ends[numbers == 0]])
        if rare.any():
            ids, ends = _gather(ids, starts, _place(~rare))
            starts = np.concatenate([[0], ends])
        return ids, starts

    def encode(self, texts: Iterable[str | None], end_id: int | None = END_ID) -> list[np.ndarray]:
        """Per text its ids (uint32), with ``end_id`` behind them; null counts as empty."""
        if len(self.known) > CACHE_UNITS or self.known.nbytes > CACHE_CHARS:
            self._reset()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string(), from_pandas=True).fill_null(""))
        words = split.flatten().dictionary_encode()
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        ids, starts = self._words(words.dictionary.to_numpy(zero_copy_only=False))
        return _cut_by(counts, *_gather(ids, starts, words.indices.to_numpy()), end_id)


def _place(first: np.ndarray) -> np.ndarray:
    """Where each row stands once those marked go before the others."""
    return np.where(first, np.cumsum(first), first.sum() + np.cumsum(~first)) - 1


def encoder(name: str = TOKENIZER) -> WordEncoder:
    """The worker's encoder for a tokenizer file, by its public name or its path."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _ENCODERS[name]


def slices(batch: pd.DataFrame, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pd.DataFrame]:
    """The batch in runs of about ``size`` bytes of text."""
    sizes = batch[column].map(lambda t: len(t) if t is not None else 0)
    for _, part in batch.groupby((sizes.cumsum() // size).to_numpy(), sort=False):
        yield part
