import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakesync.llm import bpe
from hard_rows import hard, nothing  # noqa: F401


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(bpe.read_tokenizer(None)))


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_equals_the_library_on_random_text(library, codec):
    random.seed(5)
    alphabet = "aabbee  the ing tion\n\t'sélly漢字🙂0123#$   <|endoftext|>"
    tokens = [t.encode("latin-1").decode("utf-8", "ignore") for t in codec.encoder.automaton.keys()]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(60))) for _ in range(3000)]
    texts += ["".join(random.choice(tokens) for _ in range(random.randrange(1, 8))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 999, "=-" * 700, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "\x00\x01"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(codec, text) == want
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_a_full_table_starts_anew(library, codec, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    text = "some words repeat and some words do not repeat at all"
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_hard_rows(hard, nothing, library):
    content = bpe.read_tokenizer(None)
    rows = bpe.encoded(hard, content).collect()
    texts = sorted((r["text"] or "" for r in hard.collect()))
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(r["decoded_sha256"] for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert bpe.encoded(nothing, content).count() == 0


def test_tables_stay_small(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 4)
    codec = bpe.Codec(bpe.load_vocabulary(bpe.read_tokenizer(None)))
    text = "unbelievably intertwined mispronunciations " * 20 + "\u6f22\u5b57xyzzy" * 40 + " " + "qzx" * 500
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids
    assert len(codec.encoder.fits) == 4 and max(map(len, codec)) <= bpe.KEPT_CHARS
