"""What tokens and packing cost, counted, and that the results stay those of the plain way."""

import random

import numpy as np
import pandas as pd

from kmerloom.llm import language_model, packing, tokens


class Counting:
    """A pattern that counts the characters it cuts."""

    def __init__(self, pattern):
        self.pattern, self.seen = pattern, 0

    def findall(self, text):
        self.seen += len(text)
        return self.pattern.findall(text)


def test_distinct_words_are_cut_once(monkeypatch):
    counting = Counting(tokens._PIECES)
    monkeypatch.setattr(tokens, "_PIECES", counting)
    coder = tokens.encoder()
    got = coder.encode(["alpha beta, it's gamma42"] * 1000)
    assert counting.seen < 100
    want = coder.tokenizer.encode("alpha beta, it's gamma42", add_special_tokens=False).ids + [tokens.END_ID]
    assert all(x.tolist() == want for x in got)


def test_encoder_equals_library_on_mixed_slices():
    coder = tokens.encoder()
    rng = random.Random(5)
    letters = [*map(chr, range(0x250)), *"́̀  　 ​﻿σςΣK中\U0001f600’", "<|endoftext|>", "<|", "'s", "'LL", *(" \n\t\x0b\x0c\r" * 6)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)] + [None, "", " ", "\n", "  a\n\nb "]
    want = [[*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    for step in (1, 7, len(texts)):
        got = [x.tolist() for i in range(0, len(texts), step) for x in coder.encode(texts[i : i + step])]
        assert got == want


def test_windows_start_near_the_number_that_fits(monkeypatch):
    runs, real = [], packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: runs.append(k) or real(sizes, k))
    rng = np.random.default_rng(1)
    for _ in range(4):
        sizes = np.where(rng.random(2048) < 0.8, 200, rng.integers(1, 201, 2048))
        part = packing.windows(sizes)
        filled = np.bincount(part, weights=sizes)
        assert filled.max() <= packing.CAPACITY and len(filled) <= 1.05 * sizes.sum() / packing.CAPACITY
    # 13 when the search began at the least number that could fit
    assert len(runs) <= 10


def test_differencing_on_lists_equals_that_on_arrays(monkeypatch):
    rng = np.random.default_rng(2)
    groups = [(np.where(rng.random(n) < 0.5, 200, rng.integers(1, 201, n)), k) for n, k in ((1, 3), (2, 2), (64, 15), (300, 16), (300, 17), (900, 80))]
    got = [packing.differencing(sizes, k) for sizes, k in groups]
    monkeypatch.setattr(packing, "FEW", 0)
    for (sizes, k), part in zip(groups, got, strict=True):
        assert (packing.differencing(sizes, k) == part).all()


def test_chunks_split_texts_in_columns(monkeypatch):
    rng = random.Random(1)
    letters = [*" \t\n\x0b\x0c\r" * 4, *"abAB.,éÉİΣ中\x1c\x85\u00a0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(600)] + [None, "", " ", "\n a"]
    want = [language_model.words(t) for t in texts]
    held = [i % 3 == 0 for i in range(len(texts))]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "held_out": held, "text": texts})
    monkeypatch.setattr(language_model, "words", None)  # no text goes word by word through Python
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 500)
    for only_train in (False, True):
        kept = [i for i in range(len(texts)) if not (only_train and held[i])]
        chunks = list(language_model._chunks(iter([frame[:250], frame[250:]]), only_train))
        assert [d for c in chunks for d in c.docs] == [(i, held[i]) for i in kept]
        # a chunk ends with the document that fills it
        assert all(c.sizes.sum() >= 500 > c.sizes[:-1].sum() for c in chunks[:-1])
        got = np.concatenate([c.hashes()[c.tokens] for c in chunks])
        assert got.tolist() == [language_model._hash(w) for i in kept for w in [*want[i], language_model.END]]
