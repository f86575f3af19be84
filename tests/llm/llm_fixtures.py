"""Fixtures: small slide tables for the training-data operators."""

import pytest


@pytest.fixture
def slides(spark):
    """Slides from (id, text) pairs, with extra columns whose names operators use inside."""
    def make(rows, *more, schema=""):
        data = [(*row[:2], *row[2:], "extra", 1) for row in rows]
        return spark.createDataFrame(data, f"slide_id bigint, text string{schema}, _row string, _size int")
    return make
