import json
import random

import pytest
from linkengine.llm import token_counts as T
from tokenizers import Tokenizer

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.tokenizer_path(NAME))


def test_chunks_splice_exactly(library):
    encoder = T.LibraryEncoder(T.tokenizer_path(NAME))
    random.seed(1)
    pieces = [*"abC 's'll., \n\t<|endoftext|>é́ß ̀Σςİ12　你好\U0001f600\x1c\x85'd.,", "<|endoftext|>", "<|startoftext|>", " ", "ab", "'s", "..", ",'s"]
    for _ in range(600):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 80)))
        want = len(library.encode(text, add_special_tokens=False))
        for chunk, overlap in ((1 << 15, 256), (7, 2), (16, 4)):
            assert T.count_tokens(text, encoder, chunk, overlap) == want


def test_overlap_widens_without_white_space(library):
    encoder = T.LibraryEncoder(T.tokenizer_path(NAME))
    text = "abcdefghij" * 300 + " tail " + "xy" * 500
    assert T.count_tokens(text, encoder, 100, 4) == len(library.encode(text, add_special_tokens=False))


def test_texts_without_white_space_are_chunked(library):
    """Stable offsets inside runs: the pair of bytes there is in no token of the vocabulary."""
    encoder = T.LibraryEncoder(T.tokenizer_path(NAME))
    random.seed(3)
    encoded = []
    encode = encoder.encode
    encoder.encode = lambda chunks: encoded.extend(map(len, chunks)) or encode(chunks)
    for alphabet in ("你好世界天地玄黄宇宙洪荒日月盈昃辰宿列张", "ABCDEFabcdef0123456789+/", "かなカナ漢字、。ｶﾞ゙", "한국어말가각간갈감", "ab̧́Åé'sLLd"):
        text = "".join(random.choice(alphabet) for _ in range(6000))
        encoded.clear()
        assert T.count_tokens(text, encoder, 500, 40) == len(library.encode(text, add_special_tokens=False))
        if alphabet[0] in "你A":
            assert max(encoded) <= 700


def test_long_random_texts_splice_as_the_library_counts(library):
    encoder = T.LibraryEncoder(T.tokenizer_path(NAME))
    random.seed(4)
    words = ["it's", "don't", "Straße", "ΣΑΣ", "你好", "x1y2", "...", "--", "é", "é", "\U0001f600\U0001f3fd", "<|endoftext|>", "naïve,", "'re", "a'll", "١٢", "\x1c", "　"]
    for joint in (" ", "", "\n\n"):
        text = joint.join(random.choice(words) for _ in range(3000))
        for chunk, overlap in ((100, 8), (37, 3), (1000, 64)):
            assert T.count_tokens(text, encoder, chunk, overlap) == len(library.encode(text, add_special_tokens=False))


def test_refuses_unproven_boundaries():
    with open(T.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not T.whitespace_is_stable(json.load(f))
    with pytest.raises(ValueError):
        T.LibraryEncoder(T.tokenizer_path("byte_bpe_50k.json"))


def test_rows(spark, library):
    long = "Überlänge word " * 20_000
    rows = [(1, "a b", 1), (1, "a b", 1), (2, None, 2), (3, "", 3), (None, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = T.with_token_counts(df, NAME).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == sorted(
        (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for _, t, _ in rows
    )
    assert T.with_token_counts(df.limit(0), NAME).count() == 0
