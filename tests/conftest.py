import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from forgeline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4, memory="4g")


@pytest.fixture
def rows(spark):
    """rows(schema, *tuples) -> DataFrame"""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make


@pytest.fixture
def landed(spark, tmp_path):
    """landed(schema, *dicts) -> DataFrame read from JSON lines, missing fields null."""
    import json

    from forgeline.sources.tables import read_jsonl

    def make(schema, *records):
        path = tmp_path / f"landed{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(json.dumps(r) for r in records) + "\n")
        return read_jsonl(spark, str(path), schema)

    return make
