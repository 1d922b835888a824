import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracles import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as contract

    session = local_session()
    contract._ship(session)
    session.conf.set("spark.sql.shuffle.partitions", "3")
    return session


@pytest.fixture
def rows():
    """Collect as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
