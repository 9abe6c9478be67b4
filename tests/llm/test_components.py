from __future__ import annotations

import pytest

from wakeline.llm.components import connected_components


def test_unfinished_components_raise(spark):
    with pytest.raises(RuntimeError, match="not come to rest"):
        connected_components(spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long"), rounds=1)
