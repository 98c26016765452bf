import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from fieldnote.session import local_session

    session = local_session("tests", memory="12g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    import duckdb

    c = duckdb.connect()
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for t in names.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c
