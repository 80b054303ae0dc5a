import random

from cadenza.llm import lm_scoring
from tests.llm.test_lm_scoring import compare


def test_every_word_and_pair_has_its_own_counts(spark, monkeypatch):
    """Thousands of words over many parts; brute force over the words themselves."""
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1 << 12)
    rng = random.Random(3)
    docs = [(k, " ".join(["the", *(f"w{int(rng.paretovariate(0.3)) % 9000}" for _ in range(80)), "the of"])) for k in range(300)]
    docs += [(400, None), (401, " "), (402, "the"), (3, "w1 second row"), (None, "the of")]
    assert len({w for _, t in docs for w in (t or "").split()}) > 2048
    compare(spark, docs, set(range(0, 300, 3)), 50.0, parts=7)
