"""Lookup relation from (source, item id) to feature name, range and unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landmarkflow.config import FAHRENHEIT_ITEMS, LABS, VITALS

SCHEMA = ("feature_name string, source string, itemid bigint, valid_low double, "
          "valid_high double, unit_multiplier double, unit_offset double")


def signal_rows(vitals=VITALS, labs=LABS, fahrenheit=FAHRENHEIT_ITEMS) -> list:
    """Rows of the lookup. A Fahrenheit reading joins temperature_c after
    ``(v - 32) * 5/9`` and is checked against the Celsius range."""
    rows = [(name, "chartevents", item, lo, hi, 1.0, 0.0)
            for name, items, lo, hi in vitals for item in items]
    celsius = next(((lo, hi) for name, _, lo, hi in vitals if name == "temperature_c"), None)
    if celsius:
        rows += [("temperature_c", "chartevents", item, *celsius, 5.0 / 9.0, -32.0)
                 for item in fahrenheit]
    rows += [(name, "labevents", item, lo, hi, 1.0, 0.0)
             for name, items, lo, hi in labs for item in items]
    return rows


def signal_items(source: str, **signals) -> list:
    """Item ids of one source that the lookup has."""
    return sorted({r[2] for r in signal_rows(**signals) if r[1] == source})


def signal_map(spark: SparkSession, **signals) -> DataFrame:
    """The lookup as a DataFrame (29 rows with the defaults)."""
    return spark.createDataFrame(signal_rows(**signals), SCHEMA)
