"""Raw-token parsing as column expressions: numbers, booleans, dates, times."""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens import constants as K

# Characters removed from both ends of a token.
WHITESPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0                　"

_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
NONFINITE = r"^[+-]?(?:inf|infinity|nan)$"
INTEGER = rf"^[+-]?{_DIGITS}$"
QUOTED = r"[uU]?['\"]([^'\"]*)['\"]"
PLAIN_LIST = r"^[\[]\s*(?:[+-]?[0-9.]+\s*,\s*)*[+-]?[0-9.]+\s*,?\s*[\]]$"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(stripped(value)).isin(*K.MISSING_TOKENS)


def parse_text(value: Column) -> Column:
    return F.when(~is_missing(value), stripped(value))


def with_numbers(df: DataFrame, fields: tuple[str, ...], error: str = "_e", value: str = "_v") -> DataFrame:
    """Add a finite number and an error code per text field, in steps so each token is parsed once.

    A permissive cast alone would accept suffixes such as '1d', so the shape is tested first. All fields go through one
    expression as an array: written out per field, the generated method is too long for the JIT compiler.
    """
    def number(token: Column) -> Column:
        return F.when(token.rlike(NUMBER), F.regexp_replace(token, "_", "").try_cast("double"))

    def judged(token: Column, value_: Column) -> Column:
        code = (
            F.when(token.isNull() | token.isin(*K.MISSING_TOKENS), F.lit(None).cast("string"))
            .when((F.abs(value_) == float("inf")) | (value_.isNull() & token.rlike(NONFINITE)), "nonfinite_float")
            .when(value_.isNull(), "invalid_float")
        )
        return F.struct(F.when(F.abs(value_) < float("inf"), value_).alias("v"), code.alias("e"))

    tokens = df.withColumn("t_", F.transform(F.array(*fields), lambda raw: F.lower(stripped(raw))))
    numbers = tokens.withColumn("n_", F.transform("t_", number))
    parsed = numbers.withColumn("j_", F.zip_with("t_", "n_", judged))
    each = {f + suffix: F.col("j_")[i][part] for i, f in enumerate(fields) for suffix, part in ((value, "v"), (error, "e"))}
    return parsed.withColumns(each).drop("t_", "n_", "j_")


def parse_bool(value: Column) -> Column:
    token = F.lower(stripped(value))
    return F.when(token.isin("true", "1"), True).when(token.isin("false", "0"), False)


def bool_error(value: Column) -> Column:
    return F.when(~is_missing(value) & parse_bool(value).isNull(), "invalid_boolean")


def _is_list(token: Column) -> Column:
    return token.startswith("[") & token.endswith("]")


def _list_parts(token: Column) -> Column:
    """Members of a list literal; an empty array where it is not one."""
    quoted = F.regexp_extract_all(token, F.lit(QUOTED), 1)
    commas = F.length(token) - F.length(F.regexp_replace(token, ",", ""))
    plain = F.filter(
        F.transform(F.split(F.regexp_replace(token, r"[\[\]]", ""), ","), stripped), lambda part: part != ""
    )
    return (
        F.when((F.size(quoted) > 0) & (F.size(quoted) == commas + 1), quoted)
        .when(token.rlike(PLAIN_LIST) & ~token.rlike(r"(?:^|[\[,\s+-])0[0-9]"), plain)
        .otherwise(F.array().cast("array<string>"))
    )


def _integer(part: Column) -> Column:
    token = stripped(part)
    return F.when(token.rlike(INTEGER), F.regexp_replace(token, "_", "").try_cast("int"))


def with_datetime(df: DataFrame, date: str, time: str) -> DataFrame:
    """Add `timestamp_us` (UTC) and `timestamp_error`, in steps so each token is parsed once.

    Seconds round half-even at one microsecond and may carry. A list date is checked only after the time
    has the right shape; a plain date is checked at once.
    """
    day, clock = F.col("d_"), F.col("c_")
    tokens = df.withColumn("d_", stripped(F.col(date))).withColumn("c_", stripped(F.col(time)))
    kinds = tokens.withColumns({
        "dl_": _is_list(day), "cl_": _is_list(clock),
        "di_": day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "du_": day.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{2}$"),
    })
    short = F.substring(day, 7, 2).try_cast("int")
    us_parts = F.array(
        (short + F.when(short >= 69, 1900).otherwise(2000)).cast("string"), F.substring(day, 1, 2), F.substring(day, 4, 2)
    )
    parts = kinds.withColumns({
        "dp_": F.when(F.col("dl_"), _list_parts(day)).when(F.col("di_"), F.split(day, "-")).when(F.col("du_"), us_parts),
        "cp_": F.when(F.col("cl_"), _list_parts(clock)).otherwise(F.split(clock, ":")),
    })
    second = stripped(F.regexp_replace(stripped(F.get("cp_", 2)), "[Zz]$", ""))
    numbers = parts.withColumns({
        **{n: _integer(F.get("dp_", i)) for i, n in enumerate(("y_", "mo_", "dd_"))},
        **{n: _integer(F.get("cp_", i)) for i, n in enumerate(("h_", "mi_"))}, "s_": second,
    }).withColumn("s_", F.when(F.col("s_").rlike(NUMBER), F.regexp_replace("s_", "_", "").try_cast("decimal(38,30)")))
    stamped = numbers.withColumns({
        "day_": F.try_make_timestamp("y_", "mo_", "dd_", F.lit(0), F.lit(0), F.lit(0.0)),
        "minute_": F.unix_micros(F.try_make_timestamp("y_", "mo_", "dd_", "h_", "mi_", F.lit(0.0))),
        "us_": (F.bround("s_", 6) * F.lit(1_000_000)).cast("long"),
    })
    usable = F.col("s_").isNotNull() & (F.col("s_") >= 0) & (F.col("s_") < 60) & F.col("y_").between(1, 9999)
    plain = F.col("di_") | F.col("du_")
    error = (
        F.when(day.isNull() | F.lower(day).isin(*K.MISSING_TOKENS), "missing_date")
        .when(clock.isNull() | F.lower(clock).isin(*K.MISSING_TOKENS), "missing_time")
        .when(F.col("dl_") & (F.size("dp_") != 3), "invalid_date_shape")
        .when(plain & (F.col("day_").isNull() | ~F.col("y_").between(1, 9999)), "invalid_datetime")
        .when(~F.col("dl_") & ~plain, "invalid_date_format")
        .when(F.col("cl_") & (F.size("cp_") != 3), "invalid_time_shape")
        .when(F.size("cp_") != 3, "invalid_time_format")
        .when(~F.coalesce(usable, F.lit(False)) | F.col("minute_").isNull(), "invalid_datetime")
    )
    return (
        stamped.withColumn("timestamp_error", error)
        .withColumn("timestamp_us", F.when(F.col("timestamp_error").isNull(), F.col("minute_") + F.col("us_")))
        .select(*df.columns, "timestamp_us", "timestamp_error")
    )


def _sunday(year: Column, month: int, nth: int) -> Column:
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, "SUN"), 7 * (nth - 1))


def _hours_after(day: Column, hours: int) -> Column:
    return F.unix_date(day).cast("long") * F.lit(86_400_000_000) + F.lit(hours * 3_600_000_000)


def us_eastern_flags(stamp_us: Column) -> tuple[Column, Column, Column]:
    """For a wall-clock reading: (UTC offset in hours, ambiguous, nonexistent) by the statutory rule."""
    year = F.year(F.timestamp_micros(stamp_us))
    spring, autumn = _sunday(year, 3, 2), _sunday(year, 11, 1)
    nonexistent = (stamp_us >= _hours_after(spring, 2)) & (stamp_us < _hours_after(spring, 3))
    ambiguous = (stamp_us >= _hours_after(autumn, 1)) & (stamp_us < _hours_after(autumn, 2))
    summer = (stamp_us >= _hours_after(spring, 3)) & (stamp_us < _hours_after(autumn, 2))
    return F.when(summer | ambiguous, -4).otherwise(-5), ambiguous, nonexistent


def utc_to_us_eastern(stamp_us: Column) -> Column:
    """Wall-clock microseconds in US Eastern time for a UTC instant."""
    year = F.year(F.timestamp_micros(stamp_us))
    summer = (stamp_us >= _hours_after(_sunday(year, 3, 2), 7)) & (stamp_us < _hours_after(_sunday(year, 11, 1), 6))
    return stamp_us - F.when(summer, F.lit(4)).otherwise(F.lit(5)) * F.lit(3_600_000_000)


def path_date_token(path: Column) -> Column:
    """First date token of a path as mm-dd-yy: the short form wins over the ISO form."""
    mdy = F.regexp_extract(path, r"(?<![0-9])([0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])", 1)
    ymd = F.regexp_extract(path, r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", 1)
    return F.when(mdy != "", F.when(token_date(mdy).isNotNull(), mdy)).otherwise(
        F.date_format(F.try_to_timestamp(F.when(ymd != "", ymd), F.lit("yyyy-MM-dd")), "MM-dd-yy")
    )


def token_date(token: Column) -> Column:
    """Calendar date of an mm-dd-yy token; null where there is none."""
    short = F.substring(token, 7, 2).try_cast("int")
    year = F.when(short >= 69, short + 1900).otherwise(short + 2000)
    return F.try_make_timestamp(
        year, F.substring(token, 1, 2).try_cast("int"), F.substring(token, 4, 2).try_cast("int"),
        F.lit(0), F.lit(0), F.lit(0.0),
    ).cast("date")


def all_date_tokens(text: Column) -> Column:
    """Distinct valid dates in a text, as sorted mm-dd-yy tokens."""
    mdy = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"), 1)
    ymd = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"), 1)
    valid = F.filter(mdy, lambda t: token_date(t).isNotNull())
    iso = F.filter(
        F.transform(ymd, lambda t: F.date_format(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), "MM-dd-yy")),
        lambda t: t.isNotNull(),
    )
    return F.array_sort(F.array_distinct(F.concat(valid, iso)))


def natural_name_key(name: Column) -> Column:
    """Sort key of a file name: digit runs compare as numbers and come before letters."""
    lowered = F.lower(name)
    runs = F.regexp_extract_all(lowered, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.transform(runs, lambda r: F.when(
        r.rlike("^[0-9]+$"), F.struct(F.lit(0).alias("kind"), F.length(F.ltrim(r, F.lit("0"))).alias("digits"), F.ltrim(r, F.lit("0")).alias("text"))
    ).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("digits"), r.alias("text"))))


def date_stratum(day: Column) -> Column:
    """Named half-year or quarter of a date; null outside the covered range."""
    year, month = F.year(day), F.month(day)
    return (
        F.when((year == 2020) & month.between(7, 9), "2020Q3")
        .when((year == 2020) & (month >= 10), "2020Q4")
        .when(year == 2021, F.when(month <= 6, "2021H1").otherwise("2021H2"))
        .when(year == 2022, F.concat(F.lit("2022Q"), F.quarter(day).cast("string")))
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def iso_micros(stamp_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(stamp_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
