"""Parts that an earlier slice had are not encoded again; forgetting them changes no id."""

import numpy as np
import pytest

from grainmark.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary
from grainmark.llm.tokens import PartTokenizer

VOCABULARIES = [BYTE_VOCABULARY, WORD_VOCABULARY]


def encoded(tok: PartTokenizer, texts: list[str]) -> list[list[int]]:
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, at = tok.encode(np.frombuffer(b"".join(raw), np.uint8), off)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_parts_of_an_earlier_slice_are_not_encoded_again(name):
    tok = PartTokenizer(vocabulary(name))
    texts = ["Some words, known words.\nAnd 12 more  don't ü 漢字"] * 3
    first = encoded(tok, texts)
    tok._together = tok._plain = None  # the library is not asked any more
    assert encoded(tok, texts[:2]) == first[:2]


@pytest.mark.parametrize("name", VOCABULARIES)
@pytest.mark.parametrize("remembered", [0, 3, 40, 10_000])
def test_ids_do_not_depend_on_what_is_remembered(name, remembered):
    rng = np.random.default_rng(5)
    pool = ["a", "The", "the", "xx", "don't", "12", "a.b", "ü", "漢字", "\x01", " ", "\n", "\t", "é", "<|endoftext|>", "", "zz!", "longerword"]
    tok = PartTokenizer(vocabulary(name), remembered=remembered)
    plain = PartTokenizer(vocabulary(name)).tok
    for _ in range(12):
        texts = ["".join(str(rng.choice(pool)) + str(rng.choice([" ", "\n", "", "  "])) for _ in range(rng.integers(0, 12))) for _ in range(6)]
        assert encoded(tok, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tok.known) <= remembered and np.all(tok.known[1:] > tok.known[:-1])
