from __future__ import annotations

import re

import pytest

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def prose(random, n: int) -> str:
    return " ".join(random.choice(VOCABULARY) + str(random.randrange(40)) for _ in range(n))


@pytest.fixture()
def texts(spark):
    """A table like documents from (doc_id, text) pairs, with columns whose names clash with those of results."""

    def build(rows):
        rows = [(i, t, "en", "s", len(t or ""), 1.0, 7, "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, start int, label string"
        return spark.createDataFrame(rows, schema)

    return build
