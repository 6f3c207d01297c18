"""Short pieces: the prefixes that their end asks for."""

import random

import public_tokenizers
import pytest

from proofloom.llm import bytepair
from proofloom.llm.tables import read_ranks


@pytest.fixture(scope="module")
def vocabulary():
    return bytepair.Vocabulary(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def test_asked_prefixes_are_those_of_the_whole_table(vocabulary):
    rng = random.Random(5)
    for _ in range(400):
        data = "".join(rng.choice(" abcdeinorstuéß中-_09") for _ in range(rng.randint(1, 24))).encode()
        asked, table = bytepair.AskedPrefixes(vocabulary, data), bytepair.PrefixTable(vocabulary, data)
        assert asked.ids() == table.ids()
        assert all(table.last[end] == token for end, (token, _) in asked.last.items())
        assert len(asked.last) <= len(data)
