import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from postline.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app="postline-tests")
    sc = s.sparkContext
    if not sc.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        # tests only: no shared folder configured, use a fresh scratch folder
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postline-ck-", dir="/tmp"))
    yield s


def rows(df, *cols):
    """Sorted tuples of the given columns."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
