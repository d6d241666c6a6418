"""Values taken out of log text, paths and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Result lines of the benchmark logs.
TOTAL_IMAGES = r"(?m)^total images/sec: ([.0-9]+)$"
FINAL_JSON = r"(?m)FINAL RESULTS JSON: (.*)$"
PHASE_VERSION = r"Version v([^ ]+)"
BWA_MEM_TIME = r"GPU-BWA Mem time: (.*) seconds"
PROCESSING_TIME = r"Processing time: (.*) seconds"
TOTAL_TIME = r"Total time taken: (.*)"

# Words read as booleans.
TRUE_WORDS = ["yes", "true", "t", "y", "1"]
FALSE_WORDS = ["no", "false", "f", "n", "0"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_match(text: str | Column, pattern: str) -> Column:
    """First group of the last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1)), F.lit(-1))


def last_number(text: str | Column, pattern: str = TOTAL_IMAGES) -> Column:
    return last_match(text, pattern).try_cast(DoubleType())


def first_match(text: str | Column, pattern: str) -> Column:
    found = F.regexp_extract(_col(text), pattern, 1)
    return F.nullif(found, F.lit(""))


def first_number(text: str | Column, pattern: str) -> Column:
    return first_match(text, pattern).try_cast(DoubleType())


def logged_json(text: str | Column, schema: str) -> Column:
    """The JSON document a log line ends in."""
    return F.from_json(first_match(text, FINAL_JSON), schema)


def percent_number(text: str | Column) -> Column:
    """``'37 %'`` as 37.0."""
    return F.replace(_col(text), F.lit(" %"), F.lit("")).try_cast(DoubleType())


def contains_any(text: str | Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | _col(text).contains(needle)
    return hit


def to_bool(word: str | Column) -> Column:
    """Boolean words; anything else fails the job."""
    low = F.lower(_col(word))
    return (
        F.when(low.isin(TRUE_WORDS), F.lit(True))
        .when(low.isin(FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("boolean value expected: "), F.coalesce(low, F.lit("null")))))
    )


def base_name(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_name(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+)/[^/]*$", 1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: str | Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def copies_suffix(copies: str | Column, resize: str | Column) -> Column:
    """Data folder suffix; a combination without a name fails the job."""
    n, f = _col(copies), _col(resize)
    return (
        F.when((n == 1) & (f == 1.0), F.lit(""))
        .when((n > 1) & (f == 1.0), F.format_string("-%dx", n.cast("bigint")))
        .when((n < 1) & (f == 1.0), F.format_string("-%.1fx", n.cast("double")))
        .when((n == 1) & (f == 3.0), F.lit("1729"))
        .otherwise(F.raise_error(F.lit("no suffix for these copies and this size")))
    )


def checksum_of(content: str | Column) -> Column:
    return F.md5(_col(content).cast("binary"))


def fixed_text(value: str | Column, digits: int = 4) -> Column:
    """A number from 0 up as text with ``digits`` decimals, rounded on its exact binary value.

    ``format_string`` rounds the shortest decimal form half up, which differs from C and Python in
    the last digit. Splitting the factor keeps the product's rounding error, so ties are seen exactly.
    """
    x = _col(value).cast("double")
    scale = F.lit(float(10**digits))
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    low = (x - high) * scale
    product = high * scale + low
    error = (high * scale - product) + low
    whole = F.floor(product)
    side = (product - whole - F.lit(0.5)) + error
    up = (side > 0) | ((side == 0) & (whole % 2 == 1))
    units = whole + up.cast("bigint")
    # String functions here are several times faster than ``format_string``.
    cut = F.lit(10**digits)
    fraction = F.lpad((units % cut).cast("string"), digits, "0")
    return F.concat(F.floor(units / cut).cast("string"), F.lit("."), fraction)
