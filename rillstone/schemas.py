"""Declared schemas; no load path infers."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(text: str) -> T.StructType:
    """'name type, ...' as a schema, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ") for x in text.split(", "))])


# Field names as the feeds land them.
WEATHER = struct(
    "icaoId string, obsTime long, reportTime string, temp double, dewp double, wdir double, wspd double, visib double, altim double, lat double, lon double, rawOb string"
)
#: Telemetry as it lands: every field is text. Fixed values.
TELEMETRY = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "Chuva_Adotada", "Chuva_Adotada_Status", "Cota_Adotada", "Cota_Adotada_Status", "Data_Atualizacao", "Data_Hora_Medicao", "Vazao_Adotada",
            "Vazao_Adotada_Status", "codigoestacao",
        )
    ]
)
SURFACE = struct("station string, valid string, tmpf string, dwpf string, alti string, drct string, sknt string, vsby string, lat string, lon string, metar string")
READING = struct("station_id string, sensor string, source string, ts timestamp, value double, updated_at timestamp, is_outlier boolean")
EVENT = struct("event_id long, station long, sensor string, ts string, value double")
