"""Work calendars as tables, and calendar tests as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calendar_days(spark: SparkSession, first: str, last: str, *, weekdays: tuple[int, ...] = (0, 1, 2, 3, 4), exceptions: tuple[str, ...] = (), overrides: tuple[str, ...] = ()) -> DataFrame:
    """(d, is_work, ord) for every day: ord counts work days up to and including d. Monday is 0.

    Exceptions beat overrides, overrides beat weekdays. A calendar is one row for each day of its span, so it is small
    whatever the data; joins with it broadcast it.
    """
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS d")
    work = ~F.col("d").cast("string").isin(*exceptions, "") & (F.col("d").cast("string").isin(*overrides, "") | F.weekday("d").isin(*weekdays))
    return days.withColumn("is_work", work).withColumn("ord", F.sum(F.when(F.col("is_work"), 1).otherwise(0)).over(Window.orderBy("d")).cast("int"))


def with_ordinal(df: DataFrame, calendar: DataFrame, date: str, name: str) -> DataFrame:
    """Adds the work-day ordinal of a date column."""
    return df.join(F.broadcast(calendar.select(F.col("d").alias(date), F.col("ord").alias(name))), date, "left")


def work_days_between(df: DataFrame, calendar: DataFrame, a: str, b: str, name: str = "work_days") -> DataFrame:
    """Signed number of work days in (a, b]; 0 for equal dates, null for null ones."""
    return with_ordinal(with_ordinal(df, calendar, a, "_a"), calendar, b, "_b").withColumn(name, F.col("_b") - F.col("_a")).drop("_a", "_b")


def add_work_days(df: DataFrame, calendar: DataFrame, date: str, n: Column, name: str) -> DataFrame:
    """The date n work days later (earlier for negative n); n = 0 gives the date itself."""
    days = calendar.where("is_work").select(F.col("ord").alias("_to"), F.col("d").alias("_d"))
    own = with_ordinal(df, calendar, date, "_o").join(F.broadcast(calendar.select(F.col("d").alias(date), F.col("is_work").alias("_w"))), date, "left").withColumn("_n", n)
    # Backwards, the date itself counts only if it is no work day: the n-th work day before it.
    target = F.when(F.col("_n") > 0, F.col("_o") + F.col("_n")).otherwise(F.col("_o") - F.when(F.col("_w"), 1).otherwise(0) + F.col("_n") + 1)
    out = own.withColumn("_to", target).join(F.broadcast(days), "_to", "left")
    return out.withColumn(name, F.when(F.col("_n") == 0, F.col(date)).otherwise(F.col("_d"))).drop("_o", "_w", "_n", "_to", "_d")


def month_day(d: Column) -> Column:
    return F.month(d) * 100 + F.dayofmonth(d)


def in_winter(d: Column) -> Column:
    """From 15 December to 15 March, both included."""
    return (month_day(d) >= 1215) | (month_day(d) <= 315)


def before_deadline(d: Column, north: Column) -> Column:
    """Strictly before 1 October in the north, 15 October elsewhere; the year doesn't count."""
    return month_day(d) < F.when(north, 1001).otherwise(1015)


def hours_to_days(hours: Column, per_day: Column) -> Column:
    """Days of a number of hours, halves to even; eight hours a day where none are given."""
    return F.bround(hours / F.when(F.coalesce(per_day, F.lit(0.0)) == 0, 8.0).otherwise(per_day)).cast("int")


def long_date(text: Column) -> Column:
    """A date as 'January 5, 2024', '5 January 2024', '1/5/2024' or '2024-01-05', tried in that order; else null."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in ("MMMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy-MM-dd")]).cast("date")


def effective_date(day: Column, code: Column) -> Column:
    """A week later where the code says urgent."""
    return F.when(code == "U", F.date_add(day, 7)).otherwise(day)


def serial_date(n: Column) -> Column:
    """The date of a spreadsheet day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


# How a schedule export names days of the week, from the first.
EXPORT_DAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def export_calendar(data: Column) -> Column:
    """struct(work_days, exceptions, overrides) of a calendar text of a schedule export.

    A day works if it has shifts. Dated entries without shifts are exceptions, those with shifts overrides.
    """
    rest = F.regexp_extract(data, r"(?s)DaysOfWeek\(\)\((.*)$", 1)
    week = F.regexp_replace(rest, r"(?s)\(0\|\|(?:Exceptions|VIEW).*$", "")
    works = [F.when(week.contains(f"(0||{i}()(") & ~week.contains(f"(0||{i}()())"), F.lit(d)) for i, d in enumerate(EXPORT_DAYS, 1)]
    dated = F.regexp_extract(data, r"(?s)\(0\|\|Exceptions\(\)\((.*)$", 1)
    days = lambda p: F.transform(F.regexp_extract_all(dated, F.lit(p), F.lit(1)), lambda n: serial_date(n))
    return F.struct(F.filter(F.array(*works), lambda d: d.isNotNull()).alias("work_days"), days(r"d\|(\d+)\)\(\)").alias("exceptions"), days(r"d\|(\d+)\)\([^)]").alias("overrides"))
