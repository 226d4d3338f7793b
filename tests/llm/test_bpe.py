import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from galeframe.llm import bpe_fragments as m


@pytest.fixture(scope="module")
def codec(tokenizer_path):
    return m.Codec(m.read_tokenizer(tokenizer_path))


@pytest.fixture(scope="module")
def library(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


def ids_of(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist()


def test_against_the_library(codec, library):
    rnd = random.Random(1)
    alphabet = list("abcé éÉ'sdtll.,!12 ΣΑς\x1c\x1f\xa0\x85́中日😀<|") + ["<|endoftext|>", "<|startoftext|>", "'re", "İ", "ß", "²", "Ⅷ", "՘", "　", "\x00", "'LL", "ing", "tion"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    coded = codec.encode(texts)
    for t, ids, decoded in zip(texts, coded, codec.decode(coded)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_every_letter_of_the_lower_planes(codec, library):
    for c in [*range(0x600), *range(0x1C80, 0x2200, 3), 0x3FC36, 0x1F600]:
        t = f"a{chr(c)}{chr(c)}b{chr(c)}1"
        assert ids_of(codec, t) == library.encode(t, add_special_tokens=False).ids, hex(c)


def test_cuts_are_pairs_no_token_has(codec):
    fragments, count = codec.fragments([b"xqzjk", b"the", b"a", "é中".encode()])
    assert b"".join(fragments) == b"xqzjk the a " + "é中".encode() + b" " and count.sum() == len(fragments) and count[1] == count[2] == 1
    letters = codec.letters
    inside = {t.removesuffix(m.END) for t in codec.tokens}
    for left, right in zip(fragments, fragments[1:]):
        if not left.endswith(b" "):
            pair = letters[left[-1]] + letters[right[0]]
            assert not any(pair in t for t in inside) or len(right) == 2  # a word's last letter has its own pairs


def test_caches_do_not_change_results(tokenizer_path, monkeypatch, codec):
    monkeypatch.setattr(m, "CACHE_ROWS", 1)
    small = m.Codec(m.read_tokenizer(tokenizer_path))
    small.chunks.rows = small.known.rows = 1
    texts = ["one two three", "two three four four", "", "three! (one)"]
    for _ in range(3):
        assert [small.encode([t])[0] for t in texts] == codec.encode(texts)


def test_query(odd, empty, tokenizer_path, library):
    rows = m.encode_documents(odd, tokenizer_path, with_ids=True).collect()
    assert len(rows) == odd.count() and m.encode_documents(empty, tokenizer_path).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        data = np.array(want, "<u4").tobytes()
        assert r["n_tokens"] == len(want) and r["ids"] == data and r["ids_sha256"] == hashlib.sha256(data).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
