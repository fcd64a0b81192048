"""Text, date and number clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds between the Unix and the GPS epoch, and the offset of adjusted GPS time.
GPS_EPOCH = 315964800
GPS_ADJUSTMENT = 1000000000
METRES_TO_FEET = 3.281


def number(text: Column) -> Column:
    """Number in the text, NULL for anything else and for NaN."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_list(text: Column) -> Column:
    """List text, with commas or blanks between the items, to an array of numbers; a bare number is a list of one."""
    bare = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    return F.when(bare == "", F.array().cast("array<double>")).otherwise(
        F.transform(F.split(bare, r"[,\s]+"), lambda x: x.try_cast("double"))
    )


def scalar(text: Column) -> Column:
    """Number, with a list wrapper taken off: the first element."""
    return F.get(parse_list(text), F.lit(0))


def is_removed(comments: Column) -> Column:
    return F.coalesce(F.lower(F.trim(comments)) == "removed", F.lit(False))


#: Date forms by shape: what the text looks like, and how it is then read. Each may be followed by a time.
DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}(?![0-9])", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}(?![0-9])", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}(?![0-9])", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}(?![0-9])", "M-d-y"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}(?![0-9])", "MMM d, y"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}(?![0-9])", "MMMM d, y"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}(?![0-9])", "d MMM y"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}(?![0-9])", "d MMMM y"),
)
TIME_FORM = "['T'][ ][H:mm[:ss[.SSSSSSSSS]]][ a][XXX]"


def parse_date(text: Column) -> Column:
    """Date of a whole text in one of ``DATE_FORMS``, its time part cut; NULL for anything else. Slashes read month first."""
    whole = F.trim(text)
    # The shape decides on one form, so a text that is no date costs no failed attempts.
    out = F.lit(None).cast("date")
    for shape, form in reversed(DATE_FORMS):
        out = F.when(whole.rlike(shape), F.try_to_timestamp(whole, F.lit(form + TIME_FORM)).cast("date")).otherwise(out)
    return out


def date_of_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers, NULL when any is 0 or the day does not exist."""
    complete = (year != 0) & (month != 0) & (day != 0)
    return F.when(complete, F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date"))


def gps_date(seconds: Column) -> Column:
    """Date (UTC) of an adjusted GPS time."""
    days = F.floor((seconds + F.lit(GPS_ADJUSTMENT + GPS_EPOCH)) / 86400)
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def project_year(project: Column) -> Column:
    """Four-digit year in a project name, else the fiscal year written as FY and two digits."""
    full = F.regexp_extract(project, r"((?:19|20)\d{2})", 1)
    fiscal = F.regexp_extract(project, r"FY(\d{2})", 1)
    return F.when(full != "", full.try_cast("int")).when(fiscal != "", F.lit(2000) + fiscal.try_cast("int"))


def scan_date(recorded: Column, project: Column) -> Column:
    """Recorded scan date, else 15 June of the project's year."""
    return F.coalesce(recorded, F.make_date(project_year(project), F.lit(6), F.lit(15)))


def safe_filename(text: Column) -> Column:
    """Each of the nine characters that file systems refuse becomes ``-``."""
    return F.translate(text, '/\\:*?"<>|', "-" * 9)


def id_in_path(path: Column) -> Column:
    """Digits at the end of a file name's stem."""
    return F.regexp_extract(path, r"(\d+)\.[A-Za-z0-9]+$", 1).try_cast("bigint")


def label_index(label: Column) -> Column:
    """0 for the upstream section, n for ``Downstream<n>``."""
    return F.when(label == "Upstream", F.lit(0)).otherwise(F.regexp_extract(label, r"(\d+)$", 1).try_cast("int"))


def label_distance(label: Column, length: Column) -> Column:
    """Distance below the structure, whole metres."""
    return (label_index(label) * length).cast("int")


def significant(x: Column, digits: int) -> Column:
    """Rounded half-even to significant figures; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(F.when(x != 0, x)))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def tens(percent: Column) -> Column:
    """Exceedance percentage to the nearest ten, half to even, between 10 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(10), (F.rint(percent / 10) * 10).cast("int")))


def baseflow(method: Column, ep: Column, known: Column, median: Column, exceedance: dict[int, Column]) -> Column:
    """Flow chosen by method: surveyed flow, median, or the flow at an exceedance percentage."""
    level = tens(ep)
    pick = F.lit(None).cast("double")
    for p, flow in exceedance.items():
        pick = F.when(level == p, flow).otherwise(pick)
    return F.when(method == "Median", median).when(method == "EP", pick).otherwise(known)


def positive(*candidates: Column) -> Column:
    """First candidate above zero."""
    return F.coalesce(*[F.when(c > 0, c) for c in candidates])


def source_pair(flowline: Column, streamflow: Column) -> Column:
    return F.concat(flowline, streamflow)
