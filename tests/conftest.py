import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpuslab.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="corpuslab-test-ckpt-")
    s = get_spark(app="corpuslab-tests", master="local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ckpt, "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
