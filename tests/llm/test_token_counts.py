"""Token counts against encoding each whole text on its own."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tracklens.llm import token_counts as tc

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 '.\n\tsé漢<|>endoftx", max_size=60), st.integers(0, 5))
def test_parts_add_up(text, size):
    parts = list(tc.pieces(text, size))
    assert "".join(parts) == text
    assert sum(len(TOKENIZER.encode(p, add_special_tokens=False).ids) for p in parts) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_special_strings_follow_the_library():
    text = "one <|endoftext|> two <|endoftext|>x 1a " * 50
    assert sum(len(TOKENIZER.encode(p, add_special_tokens=False).ids) for p in tc.pieces(text, 7)) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(documents, odd, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        whole = Tokenizer.from_file(path)
        length = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    else:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        length = lambda t: len(model.encode(t))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    for docs in (documents, odd, odd.limit(0)):
        want = [(r.doc_id, len((r.text or "").encode()), n := length(r.text or ""), n > 1024) for r in docs.collect()]
        got = [tuple(r) for r in tc.token_counts(docs, path).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_batches_are_balanced():
    parts = [(i, "x" * (i % 7 * 100)) for i in range(200)]
    groups = list(tc.batches_by_bytes(parts, 1000))
    assert [p for g in groups for p in g] == parts and all(sum(len(t) for _, t in g) <= 1000 for g in groups)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab'sdt1 .!-_<|>\n\t\xa0\x85éÀ×²漢", max_size=40), min_size=1, max_size=6))
def test_sums_over_words_are_exact(texts):
    whole = [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts]
    assert ["".join(tc.WORDS.findall(t)) for t in texts] == texts
    counter = tc.PartCounts(lambda parts: [len(TOKENIZER.encode(p, add_special_tokens=False).ids) for p in parts], ["<|endoftext|>"])
    assert counter(texts) == whole == counter(texts)


def test_a_repeated_part_is_encoded_once(monkeypatch):
    seen = []
    counter = tc.PartCounts(lambda parts: seen.extend(parts) or [1 for _ in parts], ["<|x|>"])
    assert counter(["one two two", "two, one two"]) == [3, 4] and counter(["one two"]) == [2]
    assert sorted(seen) == [" one", " two", ",", "one", "two"]
    assert counter(["a<|x|> b"]) == [1] and seen[-1] == "a<|x|> b"
    monkeypatch.setattr(tc, "KNOWN_PARTS", 1)
    assert counter(["x " + "y" * 40, "x one"]) == [2, 2] and set(counter.known) == {"x", " one"}
