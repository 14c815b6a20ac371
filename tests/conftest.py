import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from counterscope.schema import COUNTERS, snapshot_schema  # noqa: E402
from counterscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("counterscope-tests", cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Build snapshot rows from short tuples ``(server, seq, text, schema, counters...)``.

    Snapshot ``i`` is taken ten seconds after snapshot ``i - 1`` unless ``times`` says otherwise.
    """
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def build(rows, times=None):
        out = []
        for i, (server, seq, text, schema, counts) in enumerate(rows):
            at = (times or {}).get((server, seq), 10 * seq)
            filled = {**dict.fromkeys(COUNTERS, 0), **counts}
            out.append((server, seq, start + timedelta(seconds=at), i, schema, text, *[filled[c] for c in COUNTERS]))
        return spark.createDataFrame(out, snapshot_schema())

    return build
