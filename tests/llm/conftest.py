import random

import pytest

WORDS = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "aeiouxyzkl"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every oddity: nulls, empties, signs only, ties, repeats, a very long text, columns with awkward names."""
    long_ = prose(1, 40_000)
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "!!! ... ???"), (5, prose(5, 80)), (5, prose(5, 80)), (6, prose(5, 80)),
        (None, prose(7, 60)), (None, None), (8, long_), (9, prose(9, 3)), (10, "ß é 日本語 \u0085  x"), (11, prose(9, 3).upper()),
        (-12, prose(12, 200) + " " + prose(13, 90)), (13, prose(14, 70) + " " + prose(13, 90)),
    ]
    rows = [
        (i, t, None if k % 4 == 0 else ("en" if k % 2 else "fr"), None if k % 5 == 0 else "src0", k, f"u{k}", "x", "y", k, "z", "t", "h", 0.5, "s")
        for k, (i, t) in enumerate(texts)
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, key string, _u string, _lang string, part int, "
        "_matches string, _text string, _kept string, score double, shard string"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
