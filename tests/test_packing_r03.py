"""Texts are encoded some characters at a time."""

from __future__ import annotations

import pytest

packing = pytest.importorskip("ledgerloom.llm.packing")


def test_texts_are_split_by_their_size_and_each_once(monkeypatch):
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", 10)
    texts = ["a" * n for n in (4, 4, 30, 0, 1, 9, 10, 11, 2)]
    parts = [texts[s] for s in packing.handfuls(texts)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
    assert list(packing.handfuls([])) == []


def test_parts_of_whole_texts_are_encoded_without_going_through_their_words(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, library = packing.Tokens(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    # An apostrophe in a run of signs, digits of other kinds, all white space, each sign below U+0250 alone and in a word.
    plain = ["", " \t\n\x0b\x0c\r ", "It's we'LL !'s ''s d'd 'tis '", "x²y³ ½ 12,345.67%", "Äkeiter ÉÇouen\nenäü$$$ SHE'D'VE", "a­b"]
    plain += [f"{c} a{c}b {c}{c}1" for c in map(chr, range(0xA1, 0x250)) if not packing.ODD.search(c)]
    odd = ["a\x00b", "a\x1cb c", "\x85x\xa0y", "İx ȺB Ⱦ", "don’t", "ẞ K Σας", "<|endoftext|>", "a<|ENDOFTEXT|>b <|", "语言 é"]
    expect = lambda texts: [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids = lambda texts: [packing.np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)]
    assert ids(odd + plain + odd) == expect(odd + plain + odd)
    monkeypatch.setattr(tokens, "learn", lambda words: pytest.fail("words were encoded") if words else None)
    tokens.parts.clear()
    assert ids(plain) == expect(plain)
