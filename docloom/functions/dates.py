"""Column functions over dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms, day before month, in order of trial (fixed values).
STRICT_FORMS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$"), ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),  # also with hyphens
    ("MMMM d, yyyy", r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$"), ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), ("MMMM d yyyy", r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$"), ("MMM d yyyy", r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"),
)


def _parsed(s: Column) -> Column:
    """Date of the first form that fits, else null."""
    title = F.initcap(F.lower(F.regexp_replace(s, r"^(\d{1,2})-([A-Za-z]+)-(\d{4})$", "$1 $2 $3")))
    read = lambda t: F.coalesce(*[F.when(F.rlike(t, F.lit(shape)), F.try_to_timestamp(t, F.lit(form)).cast("date")) for form, shape in STRICT_FORMS])
    return F.transform(F.array(title), read)[0]  # binds the text once, instead of once for each form


def normalize_date(c: Column, as_of: Column) -> Column:
    """ISO date, or null for anything but a whole date from 1900 to ``as_of``."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[–—]", "-"), r"\s+", " ")
    s = F.regexp_replace(s, r"(?i)(\d+)(st|nd|rd|th)\b", "$1")
    s = F.regexp_replace(s, r"^[ ,.]+|[ ,.]+$", "")
    d = _parsed(s)
    return F.when((F.year(d) >= 1900) & (d <= as_of), F.date_format(d, "yyyy-MM-dd"))


def display_date(c: Column) -> Column:
    """DD/MM/YYYY; what cannot be parsed passes through."""
    return F.coalesce(F.date_format(_parsed(F.trim(c)), "dd/MM/yyyy"), c)
