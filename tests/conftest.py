import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (task functions travel with their jobs)

    from plantmetrics.session import clear_run_folder, configure, local_session

    session = configure(local_session("8"))
    yield session
    clear_run_folder(session)
