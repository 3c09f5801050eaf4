"""Small tables with the awkward cases every operator must take."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from vitalgrid.session import configure, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return configure(local_session("8", shuffle_partitions=4))


#: Columns whose names the operators use inside.
CLASH = "doc long, n long, bucket int, gram string, keep_id long, token string, run int, with_text string, shard long"


@pytest.fixture(scope="session")
def documents(spark):
    """rows [(doc_id, text)] -> table with clashing extra columns, over three partitions."""

    def make(rows):
        full = [(i, t, 1, 2, 3, "g", 4, "t", 5, "w", 6) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {CLASH}").repartition(3)

    return make
