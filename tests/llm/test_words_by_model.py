"""Words of letters are encoded by the tokenizer's model itself, with the ids of the whole library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from likeness.llm import simple8b, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_letters_do_not_go_through_the_pre_tokenizer(monkeypatch):
    sent = []
    each = tokenfiles.Encoder.each
    monkeypatch.setattr(tokenfiles.Encoder, "each", lambda self, texts: sent.extend(texts) or each(self, texts))
    ids, n = tokenfiles.Encoder(PATH).encode(["Über naïve Wörter\nund слово", "words, and more words."])
    assert not [t for t in sent if any(c.isalpha() for c in t)]
    whole = Tokenizer.from_file(PATH)
    assert np.split(ids, np.cumsum(n))[1][:-1].tolist() == whole.encode("words, and more words.").ids


def test_ids_are_those_of_whole_texts():
    pick = random.Random(3)
    parts = ["The", "naïve", "слово", "日本", "Ᲊ", "ª", "ⅷ", "́", "don't", "x1", ". ", ", ", ".", " ", "  ", "\n", "\n\n",
             "\t", "\xa0", "\x00", "<|endoftext|>", "<|endof", ")", "\U0001f600"]
    for special in (True, False):
        encoder, whole = tokenfiles.Encoder(PATH, special), Tokenizer.from_file(PATH)
        whole.encode_special_tokens = not special
        for _ in range(300):
            texts = [pick.choice(["", " "]).join(pick.choices(parts, k=pick.randrange(9))) for _ in range(3)]
            ids, n = encoder.encode(texts)
            found = [x[:-1].tolist() for x in np.split(ids, np.cumsum(n))[:-1]]
            assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_decode_to_their_ids():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 59, 60, 61, 240, 241, 900):
        for top in (1, 2, 5, 1000, 1 << 15, 1 << 21):
            ids = np.where(rng.random(n) < 0.3, rng.integers(0, top, n), 0).astype(np.uint32)
            assert np.array_equal(simple8b.decode(*simple8b.encode(ids), n), ids)
