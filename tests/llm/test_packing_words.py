"""Ids found word by word are those of the whole tokenizer."""

import random
import unicodedata

import numpy as np
import pytest

from placekit.llm.best_fit_packing import WordCoder, default_tokenizer, plan_best_fit

LETTERS = "abcXYZ \u00e9\u00c9\u00fc\u00df\u00ff\u00c0\u00d6\u00d8\u00f8\u00f1\u00e7\u0130\u0131\u03a3\u03c3\u03c2 \u01c6\u01c5'\u2019`.,!?*#$%&-_<|>endoftextstartoftext \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000 0123\u0663\u2167\u00bd \u6f22\u304b\u30ab\ud55c e\u0301 \u200d \U0001f600 \ufb01 \u00aa \u00ba \u00b5 \u00d7 \u00f7 's 't 're 've 'll 'd 'm "
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'S", "don't", unicodedata.normalize("NFD", "\u00e9"), "\u03a3\u0391\u03a3"]


@pytest.mark.parametrize("most", [1 << 30, 2000])
def test_words_give_the_ids_of_the_whole_text(most):
    from tokenizers import Tokenizer

    whole, coder = Tokenizer.from_file(default_tokenizer()), WordCoder(default_tokenizer(), most)
    rng, blank = random.Random(5), bytes.maketrans(b"\n\r\t", b"   ")
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) if rng.random() < 0.05 else rng.choice(LETTERS) for _ in range(rng.randint(0, 40)))
        b = t.encode().translate(blank)
        words = (b if b"<|" in b else b.lower()).split(b" ")
        coder.bound()
        assert np.frombuffer(coder.ids(words), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_ties_and_equal_lengths_fill_sequences():
    """Pieces of one length share sequences; no sequence is opened while one has room."""
    plan = plan_best_fit({1024: 4, 512: 2, 1: 3}, 2048)
    assert sum(items for _, _, items, _, _, _ in plan) == 9
    assert max(first + (items - 1) // per for _, _, items, first, per, _ in plan) == 2
