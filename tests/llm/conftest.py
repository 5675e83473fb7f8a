import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n) -> n words of invented text"""

    def make(seed, n):
        return " ".join(random.Random(seed).choices(WORDS, k=n))

    return make


@pytest.fixture
def stored(spark, tmp_path):
    """stored(df) -> the same rows read from a written table"""

    def make(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return make
