from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stallwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, shuffle_partitions=4, **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


ORDER_SCHEMA = (
    "order_id bigint, user_id bigint, restaurant_id bigint, order_ts timestamp_ntz, hour int, traffic string,"
    " eta_minutes double, cancelled int, delivered int, revenue double"
)


@pytest.fixture
def make_orders(spark):
    """Orders from partial dicts; everything not given has a plain default."""
    from datetime import datetime

    def make(*rows: dict):
        complete = []
        for i, row in enumerate(rows):
            delivered = row["delivered"] if "delivered" in row else 1 - row.get("cancelled", 0)
            base = {
                "order_id": i + 1,
                "user_id": 1,
                "restaurant_id": 1,
                "order_ts": datetime(2025, 1, 1, 12),
                "hour": 12,
                "traffic": "Low",
                "eta_minutes": 30.0,
                "cancelled": 1 - delivered,
                "delivered": delivered,
                "revenue": 100.0 * delivered,
            }
            base.update(row)
            complete.append(tuple(base[c.split()[0]] for c in ORDER_SCHEMA.split(", ")))
        return spark.createDataFrame(complete, ORDER_SCHEMA)

    return make


@pytest.fixture
def make_restaurants(spark):
    def make(*rows: tuple):
        return spark.createDataFrame(list(rows), "restaurant_id bigint, cuisine string, rating double")

    return make
