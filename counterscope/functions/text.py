"""Numbers, times and cells as report text.

Fixed-decimal text uses ``format_number`` with a pattern: it rounds the exact binary value half to even
(0.125 gives 0.12), whereas ``format_string('%.2f')`` rounds the printed decimal half up (0.13).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(decimals: int) -> str:
    return "0." + "0" * decimals if decimals else "0"


def fixed(value: Column, decimals: int) -> Column:
    return F.call_function("format_number", value, F.lit(_pattern(decimals)))


def _by_band(name: str, bands, field: int, fallback) -> str:
    """SQL for the given field of the first band whose lower bound the column reaches."""

    def literal(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x!r}D"

    cases = " ".join(f"when {name} >= {literal(band[0])} then {literal(band[field])}" for band in bands)
    return f"case {cases} else {literal(fallback)} end"


# Lower bound in seconds, factor to the printed unit, decimals, unit.
_TIME_BANDS = (
    (1.0, 1.0, 0, " s"),
    (0.1, 1000.0, 1, " ms"),
    (0.01, 1000.0, 2, " ms"),
    (0.001, 1000.0, 3, " ms"),
    (0.0001, 1000000.0, 1, " µs"),
    (0.00001, 1000000.0, 2, " µs"),
    (0.000001, 1000000.0, 3, " µs"),
    (0.0000001, 1000000000.0, 1, " ns"),
    (0.00000001, 1000000000.0, 2, " ns"),
    (0.000000001, 1000000000.0, 3, " ns"),
)

# Lower bound, divisor, decimals, unit.
_NUMBER_BANDS = (
    (1000.0, 1000.0, 2, " k"),
    (100.0, 1.0, 0, ""),
    (10.0, 1.0, 1, ""),
    (1.0, 1.0, 2, ""),
    (0.1, 1.0, 3, ""),
    (0.01, 1.0, 4, ""),
)

# Fixed value: decimals of anything smaller.
_SMALL_DECIMALS = 6


def _with_patterns(bands) -> list[tuple]:
    return [(floor, scale, _pattern(decimals), unit) for floor, scale, decimals, unit in bands]


def _time_sql(name: str) -> str:
    # One format call takes its factor, pattern and unit from the band: the generated code stays small.
    bands = _with_patterns(_TIME_BANDS)
    factor, unit = _by_band(name, bands, 1, 1.0), _by_band(name, bands, 3, " s")
    pattern = _by_band(name, bands, 2, _pattern(_SMALL_DECIMALS))
    return f"concat(format_number({name} * {factor}, {pattern}), {unit})"


def _number_sql(name: str) -> str:
    bands = _with_patterns(_NUMBER_BANDS)
    divisor, unit = _by_band(name, bands, 1, 1.0), _by_band(name, bands, 3, "")
    pattern = _by_band(name, bands, 2, _pattern(_SMALL_DECIMALS))
    return f"if({name} = 0, '0', concat(format_number({name} / {divisor}, {pattern}), {unit}))"


def float_time(seconds: str) -> Column:
    """A column of seconds as s, ms, µs or ns with about four significant digits."""
    return F.expr(_time_sql(seconds))


def float_number(value: str) -> Column:
    """A column of numbers with about three significant digits; thousands get a ``k``."""
    return F.expr(_number_sql(value))


def significant(whole: Column, digits: int) -> Column:
    """Round a whole number to ``digits`` significant digits, half to even, and print it with as many
    decimals (123 gives ``120.00``)."""
    step = F.pow(F.lit(10.0), F.length(whole.cast("string")) - digits)
    rounded = F.when(whole >= 10**digits, F.bround(whole / step, 0) * step).otherwise(whole.cast("double"))
    return fixed(rounded, digits)


def steady(value: Column, digits: int = 12) -> Column:
    """Keep ``digits`` significant digits.

    Sums of doubles come in no fixed order, so their last digits vary from run to run. Without them a value
    close to a rounding boundary prints the same every time.
    """
    pattern = "0." + "0" * (digits - 1) + "E0"
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds / 60) % 60
    return F.format_string("%02d:%02d:%02d", hours, minutes, seconds % 60)


# Picoseconds per unit, unit.
_PICO_UNITS = ((10**12, " s"), (10**9, " ms"), (10**6, " µs"), (10**3, " ns"))


def picosecond_time(picoseconds: str) -> Column:
    """Picoseconds as a clock from one minute on, else as the largest whole unit."""
    ps = F.col(picoseconds)

    def whole(unit: int) -> Column:
        return F.expr(f"`{picoseconds}` div {unit}")

    text = F.when(ps >= 60 * 10**12, clock(whole(10**12)))
    for unit, name in _PICO_UNITS:
        text = text.when(ps >= unit, F.concat(significant(whole(unit), 2), F.lit(name)))
    return text.otherwise(F.concat(ps.cast("string"), F.lit(" ps")))


def padded(text: Column, width: int) -> Column:
    """Left-justify without cutting longer text (``rpad`` cuts)."""
    return F.format_string(f"%-{width}s", text)


def metric_cell(avg: str, stddev: str, metric: str = "metric") -> Column:
    """``mean, σ spread`` in the unit of the metric."""

    def text(name: str) -> str:
        return f"if({metric} = 'Latency', {_time_sql(name)}, {_number_sql(name)})"

    rate = f"if({metric} = 'QPS', ' qps', '')"
    return F.expr(f"concat({text(avg)}, {rate}, ', σ ', {text(stddev)})")
