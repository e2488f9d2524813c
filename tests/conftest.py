import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from gaugewell.session import local_session  # noqa: E402
from small_inputs import CONTENTS  # noqa: E402

TABLES = Path("/root/testdata/sf0.001")

@pytest.fixture(scope="session")
def spark():
    return local_session("4", "gaugewell-tests")


@pytest.fixture(scope="session")
def inputs(tmp_path_factory):
    """Path of an input file, written on first use."""
    folder = tmp_path_factory.mktemp("inputs")

    def find(name: str) -> str:
        file, content = CONTENTS[name]
        path = folder / file
        if not path.exists():
            path.write_text(content(), encoding="utf-8")
        return str(path)

    return find


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(str(TABLES / f"{name}.parquet"))
