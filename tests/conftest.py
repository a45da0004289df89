import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from secondlook.session import local_session  # noqa: E402
from secondlook.sources import tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def taxonomy(spark):
    return tables.load_taxonomy(spark)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_samples(spark):
    """Samples from (text, pred_label, confidence, ground_truth, is_misclassified) tuples."""
    from secondlook import schemas

    def make(rows):
        full = [(i, f"demo_1_{i:04d}", *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(full, schemas.SAMPLES)

    return make
