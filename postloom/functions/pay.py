"""Rules for pay: ranges in text, board pay fields, annual amounts, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions.expr import col, is_blank, let, lookup, nonblank, whole_number_text

COMPENSATION = "struct<interval:string,min_amount:double,max_amount:double,currency:string>"


def compensation(
    interval: Column, low: Column, high: Column, currency: Column
) -> Column:
    return F.struct(
        interval.cast("string").alias("interval"),
        low.cast("double").alias("min_amount"),
        high.cast("double").alias("max_amount"),
        currency.cast("string").alias("currency"),
    )


def no_compensation() -> Column:
    return F.lit(None).cast(COMPENSATION)


def currency_number(c: Column | str) -> Column:
    """A money text as a number with two decimals.

    Separators before the last three characters are group marks; one inside them is a decimal sign.
    """

    def parse(digits: Column) -> Column:
        tail = F.right(digits, F.lit(3))
        head = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0)))
        plain = F.concat(F.regexp_replace(head, "[.,]", ""), tail)
        number = F.when(
            ~tail.contains(".") & tail.contains(","), F.replace(plain, F.lit(","), F.lit("."))
        ).otherwise(plain)
        return F.bround(number.try_cast("double"), 2)

    return let(F.regexp_replace(col(c), "[^-0-9.,]", ""), parse)


def salary_range(
    c: Column | str,
    lower: int = fv.SALARY_LOWER,
    upper: int = fv.SALARY_UPPER,
    hourly_below: int = fv.HOURLY_BELOW,
    monthly_below: int = fv.MONTHLY_BELOW,
    annual: bool = False,
) -> Column:
    """First ``$low - $high`` range of a text as a compensation struct, or null.

    The text is scanned once for the whole range; its parts are read from the short match.
    """

    def read(match: Column) -> Column:
        def number(group: int) -> Column:
            text = F.regexp_extract(match, fv.SALARY_PATTERN, group)
            return F.replace(text, F.lit(","), F.lit("")).try_cast("double").cast("bigint")

        marks = F.concat(
            F.regexp_extract(match, fv.SALARY_PATTERN, 2),
            F.regexp_extract(match, fv.SALARY_PATTERN, 4),
        )
        scale = F.when(F.lower(marks).contains("k"), F.lit(1000)).otherwise(F.lit(1))
        return F.struct(
            (number(1) * scale).alias("low"), (number(3) * scale).alias("high")
        )

    def judge(pair: Column) -> Column:
        low, high = pair["low"], pair["high"]
        hourly, monthly = low < hourly_below, low < monthly_below
        interval = F.when(hourly, "hourly").when(monthly, "monthly").otherwise("yearly")
        factor = F.when(hourly, fv.ANNUAL_FACTORS["hourly"]).when(
            monthly, fv.ANNUAL_FACTORS["monthly"]
        ).otherwise(1)
        limit = F.when(hourly, hourly_below).when(monthly, monthly_below)
        year_low, year_high = low * factor, high * factor
        fits = (
            (limit.isNull() | (high < limit))
            & year_low.between(lower, upper)
            & year_high.between(lower, upper)
            & (year_low < year_high)
        )
        shown = (year_low, year_high) if annual else (low, high)
        return F.when(fits, compensation(interval, *shown, F.lit("USD")))

    def whole(match: Column) -> Column:
        return F.when(match != "", let(read(match), judge))

    return let(F.regexp_extract(col(c), fv.SALARY_PATTERN, 0), whole)


def annualise(pay: Column) -> Column:
    """Hourly, daily, weekly and monthly amounts to yearly; incomplete ones are left alone."""
    factor = F.coalesce(lookup(fv.ANNUAL_FACTORS, pay["interval"]), F.lit(1))
    complete = (
        (pay["interval"] != "")
        & (pay["interval"] != "yearly")
        & (pay["min_amount"] != 0)
        & (pay["max_amount"] != 0)
    )
    return F.when(
        complete,
        compensation(
            F.lit("yearly"), pay["min_amount"] * factor, pay["max_amount"] * factor, pay["currency"]
        ),
    ).otherwise(pay)


def zip_salary(c: Column | str) -> Column:
    """``$120K - $160K/yr``: two amounts, small ones in thousands, yearly when it says so."""
    text = col(c)

    def scaled(n: Column) -> Column:
        value = F.replace(n, F.lit(","), F.lit("")).try_cast("double")
        return F.when(value < 1000, value * 1000).otherwise(value)

    def build(amounts: Column) -> Column:
        low, high = F.get(amounts, F.lit(0)), F.get(amounts, F.lit(1))
        yearly = F.lower(text).contains("/yr") | F.lower(text).contains("/year")
        return F.when(
            low.isNotNull() & high.isNotNull(),
            compensation(F.when(yearly, "yearly").otherwise("hourly"), low, high, F.lit("USD")),
        )

    numbers = F.regexp_extract_all(text, F.lit(r"\$([\d,.]+)[Kk]?"), 1)
    return let(F.transform(numbers, scaled), build)


def unit_interval(unit: Column) -> Column:
    """Pay period of a free unit word."""
    out = F.lit(None).cast("string")
    for word in reversed(fv.PAY_UNIT_WORDS):
        out = F.when(F.upper(unit).contains(word), fv.PAY_UNITS[word]).otherwise(out)
    return out


def pay_range_text(c: Column | str) -> Column:
    """``$76,000 - $103,000 annually`` as (low, high, unit)."""

    def number(group: int) -> Column:
        return F.replace(
            F.regexp_extract(col(c), fv.PAY_RANGE_PATTERN, group), F.lit(","), F.lit("")
        ).try_cast("double")

    return F.struct(
        number(1).alias("low"),
        number(2).alias("high"),
        nonblank(F.regexp_extract(col(c), fv.PAY_RANGE_PATTERN, 3)).alias("unit"),
    )


def indeed_pay(pay: Column) -> Column:
    """Stated base salary, else the estimated one; an estimate decides the currency."""

    def build(base: Column) -> Column:
        interval = lookup(fv.PAY_UNITS, F.upper(base["unitOfWork"]))
        estimated = pay["estimated"]
        return F.when(
            interval.isNotNull(),
            compensation(
                interval,
                base["range"]["min"].cast("bigint"),
                base["range"]["max"].cast("bigint"),
                F.when(estimated.isNotNull(), estimated["currencyCode"]).otherwise(
                    pay["currencyCode"]
                ),
            ),
        )

    return let(F.coalesce(pay["baseSalary"], pay["estimated"]["baseSalary"]), build)


def glassdoor_pay(header: Column) -> Column:
    """10th and 90th percentile of the adjusted pay."""
    period = header["payPeriod"]
    interval = F.when(period == "ANNUAL", "yearly").otherwise(lookup(fv.PAY_PERIODS, period))
    spread = header["payPeriodAdjustedPay"]
    return F.when(
        (period != "") & spread.isNotNull(),
        compensation(
            interval,
            F.floor(spread["p10"]),
            F.floor(spread["p90"]),
            F.coalesce(header["payCurrency"], F.lit("USD")),
        ),
    )


def usajobs_pay(ranges: Column) -> Column:
    """First stated range, yearly codes only."""

    def build(first: Column) -> Column:
        yearly = first["RateIntervalCode"] == "PA"
        return compensation(
            F.when(yearly, "yearly"),
            F.when(yearly, first["MinimumRange"].try_cast("bigint")),
            F.when(yearly, first["MaximumRange"].try_cast("bigint")),
            F.lit("USD"),
        )

    return let(F.get(ranges, F.lit(0)), build)


def linkedin_pay(c: Column | str) -> Column:
    """``$90,000.00 - $120,000.00`` on a card; the sign gives the currency."""
    text = col(c)

    def build(parts: Column) -> Column:
        low = currency_number(F.get(parts, F.lit(0))).cast("bigint")
        high = currency_number(F.get(parts, F.lit(1))).cast("bigint")
        sign = F.left(text, F.lit(1))
        return F.when(
            low.isNotNull() & high.isNotNull(),
            compensation(
                F.lit(None), low, high, F.when(sign == "$", F.lit("USD")).otherwise(sign)
            ),
        )

    return F.when(text != "", let(F.split(text, "-"), build))


def amount_text(c: Column | str) -> Column:
    """An amount for display: whole numbers without fraction, other text as it is."""
    number = col(c).cast("string").try_cast("double")
    return F.when(is_blank(col(c).cast("string")), F.lit("")).otherwise(
        F.coalesce(whole_number_text(number), col(c).cast("string"))
    )


def amount_or_blank(c: Column | str) -> Column:
    """A form amount as number text; anything else becomes an empty text."""
    return F.coalesce(whole_number_text(col(c).cast("string").try_cast("double")), F.lit(""))


def salary_text(low: Column | str, high: Column | str, currency: Column | str) -> Column:
    """``CUR low–high`` or ``CUR low+``; zero and blank count as missing."""

    def shown(c: Column | str) -> Column:
        text = amount_text(c)
        return F.when((text != "") & (text != "0"), text)

    def build(pair: Column) -> Column:
        sign = F.coalesce(col(currency), F.lit(""))
        return (
            F.when(
                pair["low"].isNotNull() & pair["high"].isNotNull(),
                F.concat(sign, pair["low"], F.lit("–"), pair["high"]),
            )
            .when(pair["low"].isNotNull(), F.concat(sign, pair["low"], F.lit("+")))
            .otherwise(F.lit(""))
        )

    return let(F.struct(shown(low).alias("low"), shown(high).alias("high")), build)


def chosen_pay(
    direct: Column, description: Column | str, country: Column | str, annual: bool = False
) -> Column:
    """Direct pay data first; for US searches else a range found in the description.

    Gives the compensation fields with the source they came from; the source is null when there
    is no minimum amount.
    """
    stated = annualise(direct) if annual else direct

    def build(pair: Column) -> Column:
        is_direct = pair["direct"].isNotNull()
        pay = F.coalesce(pair["direct"], pair["found"])
        source = F.when(is_direct, F.lit("direct_data")).otherwise(F.lit("description"))
        return F.struct(
            pay["interval"].alias("interval"),
            pay["min_amount"].alias("min_amount"),
            pay["max_amount"].alias("max_amount"),
            pay["currency"].alias("currency"),
            F.when(pay["min_amount"] != 0, source).alias("salary_source"),
        )

    found = F.when(
        direct.isNull() & (col(country) == "USA"), salary_range(description, annual=annual)
    )
    return let(F.struct(stated.alias("direct"), found.alias("found")), build)
