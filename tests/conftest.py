import datetime as dt
import decimal
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from marketlens.plans.tables import Tables  # noqa: E402
from marketlens.schemas import SCHEMAS  # noqa: E402
from marketlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _typed(value, kind):
    name = kind.typeName()
    if value is None:
        return None
    if name == "decimal":
        return decimal.Decimal(str(value)).quantize(decimal.Decimal("0.01"))
    if name == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if name == "timestamp_ntz" and isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    return value


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from lists of dicts; missing columns are NULL."""

    def build(as_of="2024-12-31", **rows):
        frames = {}
        for name, schema in SCHEMAS.items():
            data = [tuple(_typed(r.get(f.name), f.dataType) for f in schema.fields)
                    for r in rows.get(name, [])]
            frames[name] = spark.createDataFrame(data, schema)
        return Tables(dt.date.fromisoformat(as_of), **frames)

    return build


def rows(df, *keys):
    """Collected rows as dicts, by key columns when given."""
    got = [r.asDict() for r in df.collect()]
    if not keys:
        return got
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in got}
