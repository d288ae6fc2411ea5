import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesflow.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus="*", shuffle_partitions=8, app="salesflow-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Rows as plain tuples, in the DataFrame's order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
