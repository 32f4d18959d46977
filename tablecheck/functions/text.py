"""Text tests: full regex matches and which texts encode a number or a date.

Every expression is total: a text that does not fit gives null or false and never raises,
also under ANSI mode. Shape patterns come before each cast, both because casts accept more
than a plain number or date (blanks, ``1d``, ``2026``) and because a text of the wrong
shape then never reaches a parser.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# The patterns of the semantic hints and the share of non-null values that
# must match.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?[\d\s().-]{7,20}$"
ID_NAME_PATTERN = r"(?i)(^|[_-])id$"
MATCH_THRESHOLD = 0.8

_INTEGER_SHAPE = r"\A[+-]?[0-9]+\z"
_FLOAT_SHAPE = (
    r"\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\z"
)
_TIME_SHAPE = r"(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"


def full_match(column: Column, pattern: str) -> Column:
    """Whether the whole value matches ``pattern``.

    The dialect is java.util.regex with ``\\d \\w \\s`` Unicode-aware and only ``\\n`` as
    line end. ``\\A`` and ``\\z`` are used because ``$`` would also match before a final
    line break.
    """
    return column.rlike(_whole(pattern))


def _whole(pattern: str) -> str:
    return rf"(?dU)\A(?:{pattern})\z"


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Raise for a pattern that does not compile, before it reaches a job over data.

    The optimiser folds this into a local row: no job runs.
    """
    spark.sql("SELECT * FROM VALUES ('') AS t(x)").select(full_match(F.lit(""), pattern)).collect()


# The rest is SQL text on a column given as SQL (an alias or a quoted name). A regular
# expression first decodes its whole text, so each is preceded by a test on the bytes that
# every match passes and that a long text fails at once.


def is_email(column: str) -> str:
    return f"contains({column}, '@') AND {_matches(column, EMAIL_PATTERN)}"


def is_phone(column: str) -> str:
    # seven to twenty-one characters of at most four bytes
    return f"octet_length({column}) BETWEEN 7 AND 84 AND {_matches(column, PHONE_PATTERN)}"


def _matches(column: str, pattern: str) -> str:
    return f'{column} RLIKE r"{_whole(pattern)}"'


def _starts_like_a_number(column: str) -> str:
    # signs, the point and the digits lie between + and 9
    return f"{column} >= '+' AND {column} < ':'"


def as_integer(column: str) -> str:
    plausible = _starts_like_a_number(column)
    return (
        f"CASE WHEN {plausible} AND {column} RLIKE r'{_INTEGER_SHAPE}'"
        f" THEN try_cast({column} AS BIGINT) END"
    )


def as_float(column: str) -> str:
    # the longest name of a number is "+infinity"
    plausible = f"({_starts_like_a_number(column)} OR octet_length({column}) <= 9)"
    return (
        f"CASE WHEN {plausible} AND {column} RLIKE r'{_FLOAT_SHAPE}'"
        f" THEN try_cast({column} AS DOUBLE) END"
    )


def dates_read(column: str) -> str:
    """Aggregate: how many texts the best date format reads; a column has one format."""
    return _best_format(column, f"octet_length({column}) = 10", "", "DATE")


def datetimes_read(column: str) -> str:
    """The same for dates with an optional time of day."""
    plausible = f"octet_length({column}) BETWEEN 10 AND 35"
    return _best_format(column, plausible, _TIME_SHAPE, "TIMESTAMP_NTZ")


def _best_format(column: str, plausible: str, suffix: str, target: str) -> str:
    year_first = f"translate({column}, '/', '-')"
    day_first = (
        f"concat(substr({column}, 7, 4), '-', substr({column}, 4, 2), '-',"
        f" substr({column}, 1, 2), substr({column}, 11))"
    )
    counts = [
        f"count(CASE WHEN {plausible} AND {column} RLIKE r'\\A{shape}{suffix}\\z'"
        f" THEN try_cast({iso} AS {target}) END)"
        for mark in "-/"
        for shape, iso in (
            (f"[0-9]{{4}}{mark}[0-9]{{2}}{mark}[0-9]{{2}}", year_first),
            (f"[0-9]{{2}}{mark}[0-9]{{2}}{mark}[0-9]{{4}}", day_first),
        )
    ]
    return f"greatest({', '.join(counts)})"
