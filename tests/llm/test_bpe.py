import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from moundworks.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(PATH)


@pytest.fixture(scope="module")
def theirs():
    return Library.from_file(PATH)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_documents_and_odd_rows(docs, odd, theirs):
    for rows in (docs, odd):
        found = bpe.encode_documents(rows, PATH).collect()
        want = [repr((r.doc_id, *digests(theirs, r.text))) for r in rows.collect()]
        assert sorted(repr(tuple(r)) for r in found) == sorted(want)


def test_empty_table(none):
    assert bpe.encode_documents(none, PATH, with_ids=True, carry=("lang",)).columns == ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert bpe.encode_documents(none, PATH).count() == 0


PIECES = st.sampled_from(["the", " ", "\n", "'s", "É", "<|endoftext|>", "1234", "aaaa", "‍", "😀", "'LL", "\t", "\x00", "x"])


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(), st.lists(PIECES).map("".join)))
def test_any_text(text):
    ours, theirs = _both()
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


_PAIR = []


def _both():
    if not _PAIR:
        _PAIR.extend([bpe.Tokenizer(PATH), Library.from_file(PATH)])
    return _PAIR


def test_long_pieces(ours, theirs):
    for text in ("ab" * 20_000, "=" * 30_001, "éa" * 5_000):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_forgetting_pieces_changes_nothing(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    text = "one two three one two three four"
    assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids
