from __future__ import annotations

import json
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shared_rows import MECHANICS, RIDE_COLUMNS, RIDES, takings  # noqa: E402

from smelter.session import local_session  # noqa: E402

FEE_PER_RIDE = {
    "metric": "fee_per_ride", "aggregation": "ratio", "numerator": "fee", "denominator": "rides_count",
    "label": "Average Ride Fee", "description": "Fees over rides, taken again at every grain.", "unit": "EUR", "round": 2,
    "owner": "finance-desk", "dimensions": ["station", "bike", "subscribed"], "time_grains": ["daily", "monthly"],
    "rollups": {"daily": "gold.agg_rides_daily"}, "lineage": ["gold.agg_rides_daily"],
}

def kiosk_csv() -> str:
    """Sixty days of a kiosk with known coefficients."""
    lines = ["day,counter,guests,rain,takings"]
    for i in range(60):
        counter, guests, rain = ("left", "middle", "right")[i * 7 // 2 % 3], 30 + (i * 37) % 53, int(i % 5 in (1, 4))
        lines.append(f"{date(2025, 5, 1) + timedelta(days=i)},{counter},{guests},{rain},{takings(counter, guests, rain):.2f}")
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="session")
def spark():
    session = local_session("smelter-tests", cores=8, shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rental_dir(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("rental")
    lines = [RIDE_COLUMNS, *RIDES]
    (folder / "rides.csv").write_text("\n".join(",".join(map(str, line)) for line in lines) + "\n")
    (folder / "mechanics.json").write_text(json.dumps(MECHANICS))
    return str(folder)


@pytest.fixture(scope="session")
def metrics_dir(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("metrics")
    (folder / "fee.json").write_text(json.dumps(FEE_PER_RIDE))
    return str(folder)


@pytest.fixture(scope="session")
def rental(spark, rental_dir, metrics_dir, tmp_path_factory):
    from smelter.plans.medallion import run_medallion
    from smelter.sources import load_metrics
    base = str(tmp_path_factory.mktemp("rental-run"))
    return run_medallion(spark, [rental_dir], base, "rental", load_metrics(spark, metrics_dir))


@pytest.fixture(scope="session")
def kiosk(spark, tmp_path_factory):
    from smelter.plans.medallion import run_medallion
    folder = tmp_path_factory.mktemp("kiosk")
    (folder / "kiosk.csv").write_text(kiosk_csv())
    return run_medallion(spark, [str(folder)], str(tmp_path_factory.mktemp("kiosk-run")), "kiosk")


def rows(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="session")
def collect():
    return rows
