import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scriptwell.session import build_session  # noqa: E402
from scriptwell.streaming.tracker import STATE_STORE_SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="scriptwell-tests-")
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": f"{folder}/checkpoints",
        "spark.sql.warehouse.dir": f"{folder}/warehouse",
        **STATE_STORE_SETTINGS,
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="scriptwell-test-")


# Six claims over two years. Drugs and states tie in 2021, one row has no claims and no patients,
# one no patients, and prescriber 34 is in no profile table.
CLAIMS = """
    npi state specialty      brand      generic      claims cost  patients year
    31  GA    Dermatology    ALLEGRA    FEXOFENADINE 12     60.0  6        2020
    31  GA    Dermatology    CETIRIZINE CETIRIZINE   30     45.0  0        2020
    32  GA    Anesthesiology ALLEGRA    FEXOFENADINE 8      45.0  4        2020
    32  GA    Anesthesiology CETIRIZINE CETIRIZINE   10     20.0  5        2021
    34  ME    Geriatrics     ULTRAM     TRAMADOL     4      20.0  2        2021
    34  ME    Geriatrics     ZYRTEC     CETIRIZINE   0      0.0   0        2021
"""


@pytest.fixture(scope="session")
def silver(spark):
    """The table above as Silver claims."""
    rows = []
    for line in CLAIMS.strip().splitlines()[1:]:
        npi, state, kind, brand, generic, claims, cost, patients, year = line.split()
        n, usd = int(claims), float(cost)
        rows.append((int(npi), f"{state} CITY", state, kind, brand, generic, n, usd, int(patients),
                     int(year), brand == generic, round(usd / n, 2) if n else 0.0))
    return spark.createDataFrame(
        rows, "prscrbr_npi long, prscrbr_city string, prscrbr_state_abrvtn string, prscrbr_type "
        "string, brnd_name string, gnrc_name string, tot_clms int, tot_drug_cst double, tot_benes "
        "int, year int, is_generic boolean, avg_cost_per_claim double")
