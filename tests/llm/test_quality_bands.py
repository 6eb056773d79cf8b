"""The bands of the quality rules, on random text and on clean text of each language."""

import random
import string

import pyarrow as pa
import pytest

from gtdlens.llm import quality
from tests.llm.conftest import table

FOLDER = "/root/testdata/sf0.01"
# The joined documents share passages; here only the bands decide.
BANDS_ONLY = quality.Rules(most_repeat_percent=100)


def random_words(letters, size, seed):
    rng = random.Random(seed)
    words = ("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(size // 4))
    return " ".join(words)[:size]


def kept(texts, rules=quality.Rules()):
    return quality.judged(pa.array(texts), rules)["kept"].tolist()


@pytest.mark.parametrize(
    "letters, sizes",
    [
        (string.ascii_letters + string.digits, (300, 700, 1_400, 3_000, 5_500, 20_000)),
        (string.ascii_lowercase, (1_200, 1_450, 3_000, 5_500, 20_000)),
        (string.hexdigits[:16], (3_900, 5_500, 20_000)),
        ("".join(map(chr, range(33, 127))), (300, 1_400, 5_500, 20_000)),
    ],
)
def test_random_text_goes(letters, sizes):
    for size in sizes:
        assert not any(kept([random_words(letters, size, seed) for seed in range(20)])), size


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_clean_text_stays(lang):
    sql = f"select text from documents join read_parquet('{FOLDER}/labels.parquet') using (doc_id) where quality = 1 and lang = '{lang}'"
    texts = [t for (t,) in table(FOLDER, sql)]
    whole = [k for k, failed in zip(kept(texts), quality.judged(pa.array(texts), quality.Rules())["base_failed"]) if not failed]
    assert len(whole) > 20 and all(whole)
    for size in (700, 1_500, 3_000, 5_500):
        cut = [t[:size] for t in texts if len(t) >= size]
        assert sum(kept(cut)) >= 0.95 * len(cut), size


def long_prose(size):
    """English documents of 8,000 characters or more that stay, joined."""
    folder = "/root/testdata/sf0.1"
    texts = [t for (t,) in table(folder, "select text from documents where lang = 'en' and length(text) >= 8000 order by doc_id limit 60")]
    return " ".join(t[:8_000] for t, k in zip(texts, kept(texts)) if k)[:size]


def test_some_bad_chunks_reject_a_long_text():
    """Two chunks of ten: noise that the ratio of the whole text does not show, and repeats."""
    prose, size = long_prose(40_000), 4_096
    noisy = prose[: 8 * size] + random_words(string.hexdigits[:16], 2 * size, 1)
    same = prose[: 8 * size] + "abcdefgh " * (2 * size // 9)
    found = quality.judged(pa.array([prose, noisy, same]), BANDS_ONLY)
    assert found["n_bad_chunks"].tolist()[0] == 0 and min(found["n_bad_chunks"].tolist()[1:]) >= 1
    assert max(found["n_bad_chunks"][1:] / found["n_chunks"][1:]) <= 0.5
    assert found["kept"].tolist() == [True, False, False]


@pytest.mark.parametrize("share", [0.3, 0.4, 0.5])
def test_noisy_half_goes(share):
    prose, ascii_letters = long_prose(40_000), "".join(map(chr, range(33, 127)))
    assert not any(kept([prose[: int(40_000 * (1 - share))] + random_words(ascii_letters, int(40_000 * share), i) for i in range(5)], BANDS_ONLY))
