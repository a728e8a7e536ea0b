import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from corpusweave.session import local_session, ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(4)


@pytest.fixture(scope="session")
def blobs(spark):
    """Three far-apart groups of 40 points in 4 dimensions, in a mixed order."""
    import numpy as np

    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(c, 0.4, (40, 4)) for c in (0.0, 7.0, -7.0)])
    rows = [(i, points[i].tolist(), i // 40) for i in rng.permutation(len(points)).tolist()]
    return spark.createDataFrame(rows, "doc_id bigint, vector array<double>, cluster int").repartition(4)


@pytest.fixture(scope="session")
def points(blobs):
    """The blobs as (ids, matrix, labels), ordered by id."""
    import numpy as np

    rows = blobs.orderBy("doc_id").collect()
    return (
        np.array([r["doc_id"] for r in rows]),
        np.array([r["vector"] for r in rows]),
        np.array([r["cluster"] for r in rows]),
    )
