import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from riskweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


TEN_ROWS = [
    (63, 1, 1, 145, 233, 1, 2, 150, 0, 2.3, 3, 0, 6, 0),
    (67, 1, 4, 160, 286, 0, 2, 108, 1, 1.5, 2, 3, 3, 2),
    (67, 1, 4, 120, 229, 0, 2, 129, 1, 2.6, 2, 2, 7, 1),
    (37, 1, 3, 130, 250, 0, 0, 187, 0, 3.5, 3, 0, 3, 0),
    (41, 0, 2, 130, 204, 0, 2, 172, 0, 1.4, 1, 0, 3, 0),
    (56, 1, 2, 120, 236, 0, 0, 178, 0, 0.8, 1, 0, 3, 0),
    (62, 0, 4, 140, 268, 0, 2, 160, 0, 3.6, 3, 2, 3, 3),
    (57, 0, 4, 120, 354, 0, 0, 163, 1, 0.6, 1, 0, 3, 0),
    (63, 1, 4, 130, 254, 0, 2, 147, 0, 1.4, 2, 1, 7, 2),
    (53, 1, 4, 140, 203, 1, 2, 155, 1, 3.1, 3, 0, 7, 1),
]


@pytest.fixture(scope="session")
def ten_rows(spark):
    from riskweave.functions import fixed

    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(TEN_ROWS)]
    schema = "row_id long, " + ", ".join(f"{c} double" for c in fixed.COHORT_COLUMNS)
    return spark.createDataFrame(rows, schema)
