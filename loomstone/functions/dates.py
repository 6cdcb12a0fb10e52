"""Dates and times of typed literals, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"

_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"


def as_date(value: Column, datatype: Column) -> Column:
    """The day of an xsd:date (its zone aside), xsd:gYearMonth or xsd:gYear (their first day) or xsd:dateTime (in the session's zone); null for others and for values that are none."""
    day = F.regexp_extract(value, rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){_ZONE}$", 1)
    month = F.regexp_extract(value, rf"^([0-9]{{4}}-[0-9]{{2}}){_ZONE}$", 1)
    year = F.regexp_extract(value, rf"^([0-9]{{4}}){_ZONE}$", 1)
    found = F.when(datatype == XSD + "date", day).when(datatype == XSD + "gYearMonth", F.concat(month, F.lit("-01"))).when(datatype == XSD + "gYear", F.concat(year, F.lit("-01-01")))
    return F.when(datatype == XSD + "dateTime", as_timestamp(value, datatype).cast("date")).otherwise(found.try_cast("date"))


def as_timestamp(value: Column, datatype: Column) -> Column:
    """The instant of an xsd:dateTime, in the session's zone where it names none; null for others and for values that are none."""
    whole = value.rlike(rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?{_ZONE}$")
    return F.when((datatype == XSD + "dateTime") & whole, value.try_cast("timestamp"))


def date_text(value: Column) -> Column:
    """The lexical form of an xsd:date."""
    return F.date_format(value, "yyyy-MM-dd")


def date_time_text(value: Column) -> Column:
    """The lexical form of an xsd:dateTime in the session's zone, whole seconds."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssXXX")
