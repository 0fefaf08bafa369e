"""Explicit schemas of the six tables; no reader infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "d": T.DoubleType(), "t": T.TimestampNTZType(), "y": T.DateType()}


def _schema(columns: str, required: tuple[str, ...] = ()) -> T.StructType:
    fields = (x.split(":") for x in columns.split())
    return T.StructType([T.StructField(name, _KINDS[kind], name not in required) for name, kind in fields])


ELEMENTS = (
    "GP_ID:l NORAD_CAT_ID:i OBJECT_NAME:s OBJECT_ID:s EPOCH:t MEAN_MOTION:d ECCENTRICITY:d INCLINATION:d RA_OF_ASC_NODE:d ARG_OF_PERICENTER:d MEAN_ANOMALY:d "
    "EPHEMERIS_TYPE:i CLASSIFICATION_TYPE:s ELEMENT_SET_NO:i REV_AT_EPOCH:i BSTAR:d MEAN_MOTION_DOT:d MEAN_MOTION_DDOT:d SEMIMAJOR_AXIS:d PERIOD:d APOAPSIS:d PERIAPSIS:d "
    "OBJECT_TYPE:s RCS_SIZE:s COUNTRY_CODE:s LAUNCH_DATE:y SITE:s DECAY_DATE:y FILE:l GP_ID_ORIG:l TLE_LINE0:s TLE_LINE1:s TLE_LINE2:s ingested_at:t"
)

#: Latest element set of each object, and the history (the same columns).
GP = _schema(ELEMENTS, ("NORAD_CAT_ID",))
GP_HISTORY = GP

SATCAT = _schema(
    "NORAD_CAT_ID:i SATNAME:s OBJECT_NAME:s OBJECT_ID:s INTLDES:s OBJECT_TYPE:s COUNTRY:s LAUNCH:y SITE:s DECAY:y PERIOD:d INCLINATION:d APOGEE:i PERIGEE:i RCS_SIZE:s CURRENT:s COMMENT:s FILE:l LAUNCH_YEAR:i LAUNCH_NUM:i LAUNCH_PIECE:s RCSVALUE:d ingested_at:t",
    ("NORAD_CAT_ID",),
)

MANEUVERS = _schema(
    "id:l NORAD_CAT_ID:i EPOCH_BEFORE:t EPOCH_AFTER:t DELTA_SMA:d DELTA_ECCENTRICITY:d DELTA_INCLINATION:d DELTA_RAAN:d DELTA_PERIOD:d DELTA_APOAPSIS:d DELTA_PERIAPSIS:d CLASSIFICATION:s KP:d VEL_RESIDUAL_MS:d BSTAR_DELTA:d detected_at:t",
    ("NORAD_CAT_ID", "EPOCH_BEFORE", "EPOCH_AFTER"),
)
MANEUVER_KEY = ("NORAD_CAT_ID", "EPOCH_BEFORE", "EPOCH_AFTER")

SENSOR = _schema(
    "SENSOR_ID:l NAME:s COUNTRY:s ORGANISATION:s ORG_TYPE:s TYPE:s LAT:d LON:d ALT_M:d MIN_EL_DEG:d MAX_EL_DEG:d AZ_MIN_DEG:d AZ_MAX_DEG:d ORIENTATION_DEG:d MIN_RANGE_KM:d MAX_RANGE_KM:d SENSITIVITY:d REMARKS:s ingested_at:t",
    ("NAME", "TYPE", "LAT", "LON"),
)
SENSOR_KEY = ("NAME", "LAT", "LON")

SYNC_META = _schema("key:s value:s", ("key", "value"))

TABLES = {"gp": GP, "gp_history": GP_HISTORY, "satcat": SATCAT, "maneuvers": MANEUVERS, "sensor": SENSOR, "sync_meta": SYNC_META}
