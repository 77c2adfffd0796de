import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagesearch.llm import bpe
from pagesearch.llm.catalog import tokenizer_path
from tests.llm.conftest import ODD

LIB = Tokenizer.from_file(tokenizer_path())
OWN = bpe.Encoder(tokenizer_path())
SMALL = bpe.Encoder(tokenizer_path())


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids


def test_documents_exactly(documents):
    out = bpe.encoded(documents.select("doc_id", "text"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256", "ids")).collect()
    assert len(out) == documents.count()
    for r in out:
        want = ids_of(r.text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the ", " and", "\n", "\n\n", "  ", "\t", "it's", "<|endoftext|>", "é", "中文", "🙂", "a" * 40, "12345", "!?", " ", " ", "\x1c", "\x85", "\xa0", "ß", "ñé", "½²", "\u0300", " x", "Don't"]), max_size=60))
def test_chunks_and_joins_agree_with_the_whole_text(parts):
    text = "".join(parts)
    assert OWN.encode([text, text]) == [ids_of(text)] * 2


def test_cuts_at_every_place(monkeypatch):
    """Chunks of about two bytes: every join is repaired, glue chunks included."""
    monkeypatch.setattr(bpe, "CHUNK_BITS", 1)
    text = "It's  a test<|endoftext|> of\n\n joins, 1234567 long-words " + "unbroken" * 9 + " é中🙂 end \n"
    assert len(bpe.chunk_ends(np.frombuffer(text.encode(), np.uint8))) > 20
    assert SMALL.encode([text]) == [ids_of(text)]


def test_a_small_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 3)
    own = bpe.Encoder(tokenizer_path())
    texts = [" ".join(f"w{(i * j) % 91}" for i in range(900)) for j in range(4)] * 2
    assert own.encode(texts) == [ids_of(t) for t in texts]
    assert len(own.chunks) <= 3


def test_odd_rows_and_empty(frame):
    out = {(r.doc_id, r.decoded): r.ids for r in bpe.encoded(frame(ODD), tokenizer_path()).collect()}
    assert out == {(k, t or ""): ids_of(t or "") for k, t in ODD}
    assert bpe.encoded(frame([]), tokenizer_path()).count() == 0


def test_both_libraries_split_the_fast_characters_alike():
    import random
    r = random.Random(5)
    chars = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]]
    for _ in range(400):
        text = "".join(r.choice(chars) if r.random() < 0.7 else " " for _ in range(r.randint(1, 80)))
        assert not OWN.slow.search(text) and OWN.fast.encode_ordinary(text) == ids_of(text)
