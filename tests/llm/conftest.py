"""Documents that every operator of the subpackage must take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row int, shard double, a int, fp string"


def _prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alder birch cedar elm fir hazel larch maple oak pine rowan willow yew the of and".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Null and blank texts, null and repeated ids, ties, repeated rows, a long text, hot copies, clashing columns."""
    long, shared = _prose(1, 30_000), _prose(2, 60)
    texts = [
        (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one two"), (6, "A b\x0bC d"), (7, long), (8, long), (9, _prose(3, 50) + "\n" + shared + "\n" + _prose(4, 50)),
        (10, shared), (11, _prose(5, 20) + " " + shared + " \n" + _prose(6, 30)), (None, shared), (None, None), (None, _prose(7, 80)), (12, _prose(8, 90)), (12, _prose(8, 90)),
        (12, _prose(9, 90)), (13, "l1\nl2\nl3\nl4\nl1\nl2\nl3\nl9"), (14, "l0\nl1\nl2\nl3\n"), (15, "\n\n\n\n\n"), (16, "Ünï çödé ßtraße 漢字 \U0001f600 ends"), (-5, _prose(10, 40)),
    ]
    texts += [(100 + i, _prose(11, 70)) for i in range(60)] + [(200 + i, _prose(11, 70).replace("oak", "ash", i % 3)) for i in range(40)]
    texts += [(300 + i, _prose(300 + i, 5 + 7 * i)) for i in range(40)]
    return [(i, t, "en", None if k % 7 == 0 else "hot" if k % 3 else f"s{k % 5}", len(t or ""), "x", k, None, 3, "fp") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
