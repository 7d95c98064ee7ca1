"""Trigrams are counted by numpy, not by a Python call for each."""

import hashlib
import random
import sys

import numpy as np

from likeness.functions.encode import _trigram_counts


def test_calls_grow_with_distinct_trigrams_alone():
    texts, calls = ["name:asha rao | city:pune" * 40] * 200, []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    _trigram_counts(texts, 16)
    sys.setprofile(None)
    assert len(calls) < 1000


def test_counts_are_those_of_each_text():
    pick = random.Random(2)
    for letters in ("ab ", "aé漢\U0001f600\x00", "".join(map(chr, range(0x4E00, 0x4F00)))):
        for rows in (0, 1, 5, 30):
            texts = ["".join(pick.choices(letters, k=pick.choice([0, 1, 2, 3, 40]))) for _ in range(rows)]
            wanted = np.zeros((rows, 8), np.int64)
            for i, t in enumerate(texts):
                for j in range(len(t) - 2):
                    wanted[i, int(hashlib.md5(t[j:j + 3].encode()).hexdigest()[:8], 16) % 8] += 1
            assert np.array_equal(_trigram_counts(texts, 8), wanted)
