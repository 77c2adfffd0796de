import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagesearch.session import ensure_checkpoint_dir, get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    ensure_checkpoint_dir(s)   # tests only: the cluster names its own
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
