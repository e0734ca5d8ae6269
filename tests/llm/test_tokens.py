"""The chunk cache against the library on texts made of everything that could confuse it."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe, queries, tokens

PIECES = [*" \n\t\r\x0b\x0c\x1c\x85  　abcXYZ019.,;:!?'\"|&é日😀ß", "  ", " a", "<|endoftext|>", "'ll", " \n", "\n "]


@pytest.mark.parametrize(("step", "entries"), [(1, 800_000), (7, 800_000), (500, 800_000), (40, 50)])
def test_any_text_in_any_slices(step, entries, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", entries)
    path, rng = queries.tokenizer_path(), random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for encode in (tokens.LibraryEncoder(path).encode, bpe.BPE(path).encode):
        assert [x for i in range(0, len(texts), step) for x in encode(texts[i : i + step])] == want


def test_confused_hashes_are_asked_for_whole():
    path = queries.tokenizer_path()
    encoder = tokens.LibraryEncoder(path)
    cache = encoder.encode.__self__
    texts = ["some words here", "other words there"]
    want = encoder.encode(texts)
    cache.second[:] ^= np.uint64(1)
    assert encoder.encode(texts) == want == encoder.ask(texts)
