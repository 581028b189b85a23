"""How decontamination cuts texts into words and looks these up."""

import random
import time

import numpy as np
import pytest

from cuemill.llm import decontaminate
from cuemill.llm.decontaminate import term_ids, words_of

ODD = [None, "", " ", "\n\t.,;!", "A", "a", "Z9 a", " lead", "trail ", "tab\tnew\nline\x0bfeed\x0c\x1c\x85\xa0end", "don't a-b_c",
       "nul\0inside", "ÄÖ äö É", "日本語 の a", "x" * 40 + " " + "x" * 41, "\ud800 a", "a" * 9 + " " + "a" * 8, "😀a a😀"]


def one_by_one(texts, terms):
    words = [words_of(t) for t in texts]
    return [terms.get(w, -1) for ws in words for w in ws], [len(ws) for ws in words]


@pytest.mark.parametrize("looked_up", [1, 7, 64, 1 << 22])
def test_term_ids_equal_a_look_up_of_each_word(monkeypatch, looked_up):
    monkeypatch.setattr(decontaminate, "LOOKED_UP", looked_up)
    rng = random.Random(looked_up)
    every = sorted({w for t in ODD for w in words_of(t)})
    for texts in ([], [None], ["", None], ODD, ODD[::-1], *(rng.choices(ODD, k=30) for _ in range(20))):
        for listed in ([], every, every[::2], [*every[1::2], b"none of them"]):
            terms = {w: k for k, w in enumerate(listed)}
            ids, sizes = term_ids(texts, terms)
            assert (ids.tolist(), sizes.tolist()) == one_by_one(texts, terms)
            assert (ids.dtype, sizes.dtype) == (np.int32, np.int64)


def test_term_ids_take_a_fraction_of_single_look_ups():
    rng = random.Random(4)
    words = [f"{''.join(rng.choices('abcdefgh', k=rng.randrange(2, 9)))}" for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(1000)]
    terms = {w.encode(): k for k, w in enumerate(sorted(set(words[:4000])))}

    def least(function):
        took = []
        for _ in range(3):
            begun = time.process_time()
            function(texts, terms)
            took.append(time.process_time() - begun)
        return min(took)

    assert least(term_ids) < 0.6 * least(one_by_one)
