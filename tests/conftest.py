import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from murmur.session import get_session
    s = get_session("local[4]", 4, app_name="murmur-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="murmur-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="murmur-test-")
