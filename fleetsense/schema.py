"""Explicit schemas; no production path infers one."""

from pyspark.sql import types as T

TRIPS = T.StructType([
    T.StructField("bike", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("t0", T.TimestampType()),
    T.StructField("st0", T.StringType()),
    T.StructField("t1", T.TimestampType()),
    T.StructField("st1", T.StringType()),
    T.StructField("dist_m", T.DoubleType()),
    T.StructField("who", T.StringType()),
])

FAULTS = T.StructType([
    T.StructField("bike", T.StringType()),
    T.StructField("t", T.TimestampType()),
    T.StructField("kind", T.StringType()),
])

STATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("gu", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

EV_SNAPSHOTS = T.StructType([T.StructField(c, T.StringType()) for c in (
    "at", "statId", "chgerId", "stat", "statUpdDt", "lastTsdt", "lastTedt", "nowTsdt")])

# Unified column -> names seen in files and service answers (fixed values).
ALIASES = {
    "bike": ["자전거번호", "BIKE_NO", "bikeNo", "bike_no", "BIKE_ID", "bikeId"],
    "t0": ["대여일시", "RENT_DT", "rentDt", "rent_dt", "RENT_DATE", "rentDate"],
    "st0": ["대여 대여소번호", "대여대여소번호", "대여_대여소ID", "RENT_ID", "RENT_STATION_NO", "RENT_NO",
            "rentStationNo", "rent_station_no", "RENT_STATION_ID", "rentStationId"],
    "t1": ["반납일시", "RTN_DT", "RETURN_DT", "returnDt", "rtnDt", "return_dt", "RETURN_DATE", "returnDate"],
    "st1": ["반납대여소번호", "반납 대여소번호", "반납_대여소ID", "RTN_ID", "RTN_STATION_NO", "RETURN_STATION_NO",
            "RTN_NO", "returnStationNo", "rtnStationNo", "return_station_no", "RETURN_STATION_ID",
            "returnStationId"],
    "dist_m": ["이용거리(M)", "이용거리", "USE_DST", "USE_DISTANCE", "useDistance", "use_distance", "useDst"],
    "born": ["생년", "BIRTH_YEAR", "BIRTH_YR", "birthYear", "birth_year"],
    "sex": ["성별", "GENDER", "SEX", "SEX_CD", "gender", "sex"],
}
REQUIRED = ("bike", "t0", "st0", "t1", "st1")
