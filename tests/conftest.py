from __future__ import annotations

import pytest

from cleave.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", partitions=4)
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
