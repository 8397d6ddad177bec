import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from panelcast.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("panelcast-tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def small_panel(spark):
    """12 areas x 3 years with a season, a level per area and some noise."""
    import numpy as np
    import pandas as pd

    from panelcast.functions.isoweek import calendar
    from panelcast.operators.panel import build_panel
    from panelcast.session import materialise

    rng = np.random.default_rng(7)
    rows = []
    for a in range(12):
        for i, (y, w) in enumerate(calendar(2019, 2021)):
            mean = (20 + 5 * a) * (1.2 + np.sin(2 * np.pi * (w - 1) / 52.1775))
            cases = int(rng.poisson(mean))
            if cases:
                rows.append((f"area_{a:02d}", y, w, float(cases), 0.0))
    pdf = pd.DataFrame(rows, columns=["health_area", "year", "week_", "cases", "deaths"])
    return materialise(build_panel(spark.createDataFrame(pdf)))


@pytest.fixture(scope="session")
def small_static(spark):
    import pandas as pd
    pdf = pd.DataFrame({"health_area": [f"area_{a:02d}" for a in range(12)], "Pop_Totale": [10000.0 + 900 * a for a in range(12)],
                        "Pop_Enfants_0_14": [4000.0 + 400 * a for a in range(12)], "Densite_Pop": [50.0 + a for a in range(12)],
                        "Superficie_km2": [200.0 + a for a in range(12)], "Altitude_Moy": [300.0 + 10 * a for a in range(12)]})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="session")
def small_weights(spark):
    from panelcast.operators.spatial import build_neighbour_weights
    from panelcast.session import materialise
    rows = [(f"area_{a:02d}", float(a % 4), float(a // 4)) for a in range(12)]
    df = spark.createDataFrame(rows, "health_area string, x double, y double")
    return materialise(build_neighbour_weights(df, 3, "x", "y"))
