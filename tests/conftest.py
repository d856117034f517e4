import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from finloom.plans.runtime import session, ship

    s = session(cores="4", shuffle_partitions=4, memory="4g")
    ship(s)
    yield s
    s.stop()
