import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session("4")
    # Several slices and packs even for tiny inputs.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
