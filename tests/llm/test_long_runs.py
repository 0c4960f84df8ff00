"""Texts that tiktoken's pattern engine gives up on have the ids of the tokenizers library."""

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, " " * 2_000_000 + "x", "a" * 20_000 + "\t" * 1_000_000 + "b", "plain text"])
def test_long_runs_of_white_space(text):
    from tokenizers import Tokenizer

    from sandloom.llm._tokens import ByteLevel

    path = P.path("byte_bpe_50k.json")
    (got,) = ByteLevel(path).encode([text])
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
