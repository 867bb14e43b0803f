"""Tokens of packing: texts go to the encoder in large parts, by a pattern that does not look ahead."""

import random
import time

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from foliomill.llm import packing


def spent(work) -> float:
    began = time.process_time()
    work()
    return time.process_time() - began


def test_encoding_costs_less_than_the_usual_pattern():
    """Of words that are rarely met twice, as most of a large corpus are; it was 2.2 times as much."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 10))) for _ in range(5000)) for _ in range(60)]
    path = packing.default_vocabulary()
    packing.token_bytes(["a"], path)
    ranks = packing._ENCODERS[path].quick.__self__._mergeable_ranks
    usual = tiktoken.Encoding("usual", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = min(spent(lambda: packing.token_bytes(texts, path)) for _ in range(3))
    assert own < 1.2 * min(spent(lambda: [usual.encode_ordinary(t) for t in texts]) for _ in range(3))


def test_parts():
    whole = "a b  c\n\nd  \n e\x1c \x1cf  "
    assert list(packing._parts(whole)) == ["a b ", " c\n", "\nd  \n", " e\x1c \x1cf  "]
    assert list(packing._parts("")) == [""]
    rng = random.Random(4)
    library = Tokenizer.from_file(packing.default_vocabulary())
    for signs in ("ab ", "ab'.9 \n\t 　é日", "ab"):
        text = "".join(rng.choices(signs, k=3 * packing.PART_CHARS if " " in signs else 1000))
        parts = list(packing._parts(text))
        assert "".join(parts) == text and max(map(len, parts)) < 1.1 * packing.PART_CHARS
        assert packing.token_bytes([text], packing.default_vocabulary())[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
