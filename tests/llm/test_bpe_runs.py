"""Long matches: runs, periods and noise, against the library and in bounded time."""

import random
import time

import numpy as np
import pytest

from corpusloom.llm import bpe_tree


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import tiktoken

    ranks = bpe_tree.load_ranks(bpe_tree.default_vocabulary())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe_tree.TreeCodec(ranks, public_tokenizers.PATTERN), plain


LONG = 1_000_000
PERIODS = ["x", "-", "=", "ab", "0", "é", "漢", "abcabd", "the", "=-", "_" * 3 + "a", "​", "!?", "😀", "ing"]


@pytest.mark.parametrize("part", PERIODS)
def test_a_million_characters_of_one_kind(both, part):
    codec, plain = both
    text = part * (20_000 // len(part))
    assert codec.encode(text) == plain.encode_ordinary(text)
    text = part * (LONG // len(part))
    started = time.monotonic()
    ids = codec.encode(text)
    took = time.monotonic() - started
    assert codec.decode(np.array(ids, dtype="<u4")) == text.encode() and took < 25, took


def test_mixed_runs_as_the_library_has_them(both):
    codec, plain = both
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["x", "ab", "-", "=", "abc", "th", "e", "q", "é", "0", "12", "/"]) * r.choice([1, 2, 7, 40, 300]) for _ in range(r.randint(1, 8)))
        assert codec.encode(text) == plain.encode_ordinary(text)
        piece = text.encode()
        assert codec._whole(piece) == codec._merge(piece) == codec._by_heap([codec._ranks[bytes([b])] for b in piece])


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghij", "一二三四五六七八九十百千万人大小中国", "ab"])
def test_long_noise_without_white_space(both, alphabet):
    codec, plain = both
    r = random.Random(3)
    text = "".join(r.choices(alphabet, k=300_000))
    started = time.monotonic()
    ids = codec.encode(text)
    took = time.monotonic() - started
    assert took < 25, took
    assert ids[:2000] == plain.encode_ordinary(text)[:2000] and codec.decode(np.array(ids, dtype="<u4")) == text.encode()
    for k in range(0, 20_000, 1000):
        assert codec.encode(text[k : k + 3000]) == plain.encode_ordinary(text[k : k + 3000])


def test_one_pass_is_encode_and_decode(spark):
    rows = [(1, "a text with words"), (2, None), (3, ""), (None, "x" * 5000), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two = bpe_tree.decode(bpe_tree.encode(docs)).collect()
    assert sorted(map(str, bpe_tree.code(docs).collect())) == sorted(map(str, two))
