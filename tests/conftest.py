import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from compare import session
    return session()


@pytest.fixture
def event_frame(spark):
    """Literal canonical events: ``event_frame([(\"03:00:10\", {...}), ...])``."""
    from secframe.schema import EVENT_SCHEMA

    def build(rows):
        out = []
        for i, (at, fields) in enumerate(rows):
            ts = dt.datetime(2026, 9, 2, tzinfo=dt.timezone.utc) + (
                at if isinstance(at, dt.timedelta) else dt.timedelta(
                    **dict(zip(("hours", "minutes", "seconds"), map(int, at.split(":"))))))
            d = {"ts": ts, "event_seq": i, **fields}
            out.append(tuple(d.get(f.name) for f in EVENT_SCHEMA.fields))
        return spark.createDataFrame(out, EVENT_SCHEMA)
    return build
