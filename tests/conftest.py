import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-"),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
