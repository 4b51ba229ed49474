import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from dunlin.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", 8, app="dunlin-tests")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="dunlin-test-ckpt-"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="dunlin-test-")
