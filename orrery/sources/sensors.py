"""Sheets of ground sensors: CSV, or the first sheet of a workbook."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sensors import estimates, or_default, sensor_type

HEADER = ["Sensor Name", "Sensor Type", "Lat", "Lon", "Elevation Min", "Elevation Max", "Azimuth Min", "Azimuth Max", "Orientation", "Country", "Organisation", "Org Type", "Remarks"]
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns are found by the names in the header; all are text."""
    return by_header(spark.read.csv(path, header=True))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, which is one small file and read on the driver."""
    [(_, data)] = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    rows = sheet(bytes(data))
    head, body = (rows[0], rows[1:]) if rows else ([], [])
    schema = T.StructType([T.StructField((name or f"_{i}").strip(), T.StringType()) for i, name in enumerate(head)])
    return by_header(spark.createDataFrame([tuple((r + [None] * len(head))[: len(head)]) for r in body], schema))


def sheet(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [None] * (at - len(cells))
                v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else v.text if v is not None else None
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append(cells)
    return out


def by_header(rows: DataFrame) -> DataFrame:
    """The columns of HEADER, in any order in the sheet; one that is missing is null."""
    have = {c.strip().lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{have[name.lower()]}`") if name.lower() in have else F.lit(None)).cast("string").alias(name) for name in HEADER])


def sensors(sheet_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed sensors, one row of the counts `kept` and `skipped`).

    A row without a name is passed over; one without a place counts as skipped.
    Zero in azimuth or greatest elevation is taken as not given.
    """
    number = lambda name: F.nullif(F.trim(F.col(f"`{name}`")), F.lit("")).try_cast("double")
    text = lambda name: F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
    named = sheet_rows.filter(text("Sensor Name").isNotNull())
    placed = number("Lat").isNotNull() & number("Lon").isNotNull()
    counts = named.agg(F.count_if(placed).alias("kept"), F.count_if(~placed).alias("skipped"))
    kind = F.coalesce(sensor_type(F.col("`Sensor Type`")), F.lit(""))
    guess = estimates(kind, F.col("Remarks"))

    def limit(name: str, default: float) -> Column:
        return or_default(number(name), default)

    kept = named.filter(placed).select(
        text("Sensor Name").alias("NAME"), text("Country").alias("COUNTRY"), text("Organisation").alias("ORGANISATION"), text("Org Type").alias("ORG_TYPE"), kind.alias("TYPE"),
        number("Lat").alias("LAT"), number("Lon").alias("LON"), guess["ALT_M"].alias("ALT_M"), limit("Elevation Min", 10.0).alias("MIN_EL_DEG"), limit("Elevation Max", 90.0).alias("MAX_EL_DEG"),
        limit("Azimuth Min", -180.0).alias("AZ_MIN_DEG"), limit("Azimuth Max", 180.0).alias("AZ_MAX_DEG"), limit("Orientation", 0.0).alias("ORIENTATION_DEG"),
        guess["MIN_RANGE_KM"].alias("MIN_RANGE_KM"), guess["MAX_RANGE_KM"].alias("MAX_RANGE_KM"), guess["SENSITIVITY"].alias("SENSITIVITY"), F.col("Remarks").alias("REMARKS"),
        F.current_timestamp().cast("timestamp_ntz").alias("ingested_at"),
    )
    return kept, counts
