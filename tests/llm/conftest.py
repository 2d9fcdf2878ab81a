import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from riskspark.session import local_session

    s = local_session("*", shuffle_partitions=4, app_name="riskspark-llm-tests")
    yield s
    s.stop()


WORDS = "the river stone walks under light green hills while old birds sing about rain and small boats drift away from town".split()


def prose(n: int, seed: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Ties, copies, near copies, empty, NULL, blank and long texts, a repeated row, a NULL id, clashing extra columns."""
    base = prose(120, 1)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base), (2, base), (3, near), (4, prose(80, 2)), (5, ""), (6, None), (7, " \t\n "), (8, "one two"),
            (9, prose(30_000, 3)), (4, prose(80, 2)), (None, prose(60, 4)), (10, "One\x0bTWO three Ünïcödé"), (11, prose(80, 2))]
    return spark.createDataFrame([(i, t, "en", "src", 7, 1, 2) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp long, component long")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
