"""The component search never ends unsettled without saying so."""

import pytest

from graphloom.llm import components


def test_unsettled_rounds_are_an_error(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(links, max_rounds=2)
