"""Power-of-two packing against the tokenizer library on whole texts."""

import random
import struct

import pytest
from linkengine.llm import packing
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, length string, ids string, place string, task string"
LIBRARY = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
ALPHABET = ["a", "word", "The", "'s", "'", "'ll", "12", "9", "é", "ÿſ", "×", "÷", "ß.", "µ", "ª", "中文", "。", "한국", "🙂", " ", "  ", "   ", "\n", "\n\n", " \n ", "\t", "\x1c", "\x85", " ", " ", "́", "<|endoftext|>", "<|", "|>", "...", "--", "\x00", "ab12", "½"]


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def numbers(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_units_equal_the_library_on_whole_texts():
    rng, encoder = random.Random(1), packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    for _ in range(6000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 14)))
        assert numbers(encoder.ids(text)) == whole(text), repr(text)


def test_plain_texts_are_split_into_pre_tokens_at_once():
    rng, encoder = random.Random(4), packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    plain = ["a", "word", "The", "'s", "'", "''", "'ll", "'re", "'T", "12", "9", "é", "ÿſ", "ŉ", ".", ", ", "...", "--", "<|", "_", "~", " ", "  ", "   ", "\n", "\n\n", " \n ", "<|endoftext|>"]
    for _ in range(6000):
        text = "".join(rng.choice(plain) for _ in range(rng.randrange(0, 14)))
        assert numbers(encoder.ids(text)) == whole(text), repr(text)
    encoder = packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    text = "word. word, word! don't\n\nword. é."
    assert numbers(encoder.ids(text)) == whole(text)
    assert set(encoder._memo) == {"word", " word", ".", ",", "!", " don", "'t", "\n", " é"}
    # All that the memo holds is what the library makes of the same text.
    assert all(numbers(x) == whole(p) for p, x in encoder._memo.items())


@pytest.mark.parametrize("size", [3, 7, 40])
def test_chunks_equal_the_library_on_whole_texts(size):
    rng, encoder = random.Random(2), packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))).replace("<|endoftext|>", "e")
        parts = list(packing.chunks(text, size))
        assert "".join(parts) == text
        assert sum((numbers(encoder.ids(p)) for p in parts), []) == whole(text), repr(text)


def test_a_small_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_CHARS", 300)
    encoder = packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    for i in range(50):
        text = f"some words {i} and {i * i} others again {i % 3}"
        assert numbers(encoder.ids(text)) == whole(text)


def test_other_definitions_are_refused():
    with pytest.raises(ValueError):
        packing.Encoder(packing.tokenizer_path("word_bpe_49k.json"))


def check(rows, pieces, longest):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in rows:
        parts = sorted(by_doc[doc_id], key=lambda p: p["start"])
        ids = whole(text) + [0]
        assert sum((numbers(p["ids"]) for p in parts), []) == ids and all(p["doc_tokens"] == len(ids) for p in parts)
        at = 0
        for p in parts:
            assert p["start"] == at and p["length"] == len(p["ids"]) // 4
            at += p["length"]
        lengths = [p["length"] for p in parts]
        assert lengths.count(longest) == len(ids) // longest
        assert sorted(set(lengths) - {longest}, reverse=True) == [n for n in lengths if n < longest]  # its binary digits
    assert sorted(by_sequence) == list(range(len(pieces)))
    assert all(len(s) == 1 and s[0]["offset"] == 0 for s in by_sequence.values())
    order = [by_sequence[i][0]["length"] for i in range(len(pieces))]
    assert order == sorted(order, reverse=True)
    assert all(n & (n - 1) == 0 and n <= longest for n in order)


@pytest.mark.parametrize("longest", [1, 8, 1024])
def test_pack(spark, longest):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 80)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "long text of many words " * 3000), (63, "x" * 70000)]
    data = [(i, t, "a", "b", "c", "d") for i, t in rows]
    check(rows, packing.pack(spark.createDataFrame(data, SCHEMA).repartition(5), longest=longest).collect(), longest)


def test_cases(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(1, "the same", "", "", "", ""), (1, "the same", "", "", "", ""), (None, "none", "", "", "", "")], SCHEMA)
    got = packing.pack(twice).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} == {1, None}
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * (len(whole("the same")) + 1)
    with pytest.raises(ValueError):
        packing.pack(twice, longest=1000)
