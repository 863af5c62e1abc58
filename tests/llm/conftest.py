import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import DOCS, ODD  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def stored(odd, spark, tmp_path_factory):
    """The same as a table on disk, with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "t")
    names = ("row", "bucket", "kept", "id", "digest", "score", "length", "piece", "rank", "component", "bands", "links", "_row", "copies")
    odd.withColumns({c: F.lit("clash") for c in names}).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
