"""One unambiguous instant from dates written in many ways.

The written date is brought to one canonical field list by anchored patterns, local times are matched against the
zone-offset intervals of their source's clock, and the number of matching intervals decides: one gives the offset,
two mean an ambiguous time, none a time that never was.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache, reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names in English and German by number, and zone letters with their offsets in minutes.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jän": 1, "feb": 2, "february": 2, "februar": 2, "mar": 3, "march": 3,
    "märz": 3, "mär": 3, "apr": 4, "april": 4, "may": 5, "mai": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7,
    "july": 7, "juli": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10,
    "oktober": 10, "okt": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "dezember": 12, "dez": 12,
}
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MET": 60, "CEST": 120,
    "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "IST": 330, "JST": 540, "KST": 540, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540,
    "AKDT": -480, "HST": -600,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?(?: ?([AaPp][Mm]))?"
_ZONE = r"(?: ?((?:GMT|UTC|UT)? ?[+-]\d{1,2}:?\d{2}|[A-Z]{1,5}))?(?: ?\([^)]*\))?"
# pattern, then the groups of year, month, day, hour, minute, second, fraction, half of the day, zone
_FORMS = [
    (rf"^(?:\p{{L}}{{2,10}}\.?,? )?(\d{{1,2}})\.?[ -](\p{{L}}{{3,9}})\.?[ -](\d{{4}}|\d{{2}}),? {_TIME}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:\p{{L}}{{2,9}},? )?(\p{{L}}{{3,9}}) (\d{{1,2}}) {_TIME}{_ZONE} (\d{{4}})$", (9, 1, 2, 3, 4, 5, 6, 7, 8)),
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[Tt ] ?{_TIME}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?(\b)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_TIME}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
]
_SLASHES = rf"^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}}),? {_TIME}{_ZONE}$"
_ORDERS = {"dmy": (3, 2, 1), "mdy": (3, 1, 2), "ymd": (1, 2, 3)}
# the widths that _count knows; fourteen digits are a date
_EPOCH = r"^(?:\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})$"
MICROS = 1_000_000
# the years mail may be dated in
FIRST_YEAR, LAST_YEAR = 1970, 2100


def _canon(s: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    return F.regexp_replace(s, pattern, "|".join(f"${g}" for g in groups))


def _lookup(key: Column, values: dict[str, int]) -> Column:
    pairs = reduce(lambda a, kv: [*a, F.lit(kv[0]), F.lit(kv[1])], values.items(), [])
    return F.try_element_at(F.create_map(*pairs), key)


@lru_cache(maxsize=1024)
def _offsets(name: str, first_year: int, last_year: int) -> tuple[tuple[int, tuple[tuple[int, int, int], ...]], ...]:
    """(month of local time as year * 100 + month, its intervals) of a zone; none for unknown names."""
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return ()
    utc = dt.timezone.utc
    offset = lambda t: int(dt.datetime.fromtimestamp(t, zone).utcoffset().total_seconds())
    begin = int(dt.datetime(first_year, 1, 1, tzinfo=utc).timestamp()) - 86400
    end = int(dt.datetime(last_year + 1, 1, 1, tzinfo=utc).timestamp()) + 86400
    cuts, now = [(begin, offset(begin))], offset(begin)
    for day in range(begin, end, 86400):
        if (then := offset(day + 86400)) != now:
            low, high = day, day + 86400
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == now else (low, mid)
            cuts.append((high, then))
            now = then
    months: dict[int, list] = {}
    for (a, shift), (b, _) in zip(cuts, [*cuts[1:], (end, 0)]):
        at = dt.datetime.fromtimestamp(a + shift, utc).replace(day=1, hour=0, minute=0, second=0)
        while at.timestamp() < b + shift:
            months.setdefault(at.year * 100 + at.month, []).append(((a + shift) * MICROS, (b + shift) * MICROS, shift))
            at = (at + dt.timedelta(days=32)).replace(day=1)
    return tuple((m, tuple(x)) for m, x in months.items() if first_year <= m // 100 <= last_year)


def zone_intervals(spark: SparkSession, zones: list[str], first_year: int, last_year: int) -> DataFrame:
    """(zone, month, intervals): for every zone and month of local time the intervals of constant offset touching it.

    The size is bounded by the zones of the time-zone database (some 600) times the months of the range.
    """
    rows = [(name, m, list(x)) for name in sorted(set(zones)) for m, x in _offsets(name, first_year, last_year)]
    kind = "zone string, month int, intervals array<struct<low: bigint, high: bigint, shift: int>>"
    return spark.createDataFrame(rows, kind)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _canonical(s: Column, order: Column) -> Column:
    """year|month|day|hour|minute|second|fraction|half|zone of the text, # and the digits of a count, or null."""
    rfc, *rest = _FORMS
    canon = F.when(s.rlike(rfc[0]), _canon(s, *rfc)).when(s.rlike(_EPOCH), F.concat(F.lit("#"), s))
    slash = F.when(s.rlike(r"^\d{4}/"), _canon(s, _SLASHES, (*_ORDERS["ymd"], 4, 5, 6, 7, 8, 9)))
    for name, groups in _ORDERS.items():
        slash = slash.when(order == name, _canon(s, _SLASHES, (*groups, 4, 5, 6, 7, 8, 9)))
    for pattern, groups in rest:
        canon = canon.when(s.rlike(pattern), _canon(s, pattern, groups))
    return canon.when(s.rlike(_SLASHES), slash)


def _count(digits: Column) -> Column:
    """Microseconds since 1970 of a count: 9 or 10 digits are seconds, 12 or 13 milliseconds, 15 or 16 microseconds,
    18 tenths of microseconds since 1601, 19 nanoseconds."""
    n, width = digits.try_cast("decimal(20,0)"), F.length(digits)
    since_1601 = F.lit(11_644_473_600).cast("decimal(20,0)") * MICROS
    return (
        F.when(width <= 10, n * MICROS)
        .when(width.between(12, 13), n * 1000)
        .when(width.between(15, 16), n)
        .when(width == 18, F.floor(n / 10) - since_1601)
        .when(width == 19, F.floor(n / 1000))
    ).cast("bigint")


def _shift(zone: Column) -> Column:
    """Seconds east of UTC of a written zone; null for letters without a usual meaning."""
    sign = F.when(zone.startswith("-"), -60).otherwise(60)
    digits = F.lpad(F.regexp_replace(zone, "[+:-]", ""), 4, "0")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    numeric = F.when((hours < 15) & (minutes < 60), sign * (hours * 60 + minutes))
    return F.when(zone.rlike("^[+-]"), numeric).otherwise(_lookup(zone, ZONE_MINUTES) * 60)


def _fields(parts: Column) -> Column:
    part = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit(""))
    number = lambda k: part(k).try_cast("int")
    # a cast that fails is slow even when it gives null, so names never come to it
    month = F.when(part(1).rlike("^[0-9]"), number(1)).otherwise(_lookup(F.lower(part(1)), MONTHS))
    full_year = lambda y: F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    clock = lambda h: (
        F.when(part(7).isNull(), h).when(h.between(1, 12), h % 12 + F.when(F.upper(part(7)) == "PM", 12).otherwise(0))
    )
    second = F.coalesce(number(5), F.lit(0))
    micros = F.rpad(F.substring(F.coalesce(part(6), F.lit("0")), 1, 6), 6, "0").cast("int")
    epoch = F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")

    def dated(year: Column) -> Column:
        at = F.try_make_timestamp_ntz(year, month, number(2), _let(number(3), clock), number(4), second.cast("decimal(8,6)"))
        at = F.when(second < 60, at)
        zone = F.regexp_replace(F.upper(F.trim(part(8))), r"^(GMT|UTC|UT) ?(?=[+-])", "")
        return F.struct(
            F.lit(None).cast("bigint").alias("count"),
            (F.timestamp_diff("MICROSECOND", epoch, at) + micros).alias("local"),
            zone.isNotNull().alias("zoned"),
            _let(zone, _shift).cast("bigint").alias("shift"),
            (year * 100 + month).alias("month"),
        )

    return _let(_let(number(0), full_year), dated)


def written_fields(raw: Column, order: Column) -> Column:
    """Struct of count (microseconds, where the text is a count), local (microseconds of the written clock), zoned and
    shift (seconds, where a zone is written) and month. Null for text that is no full date."""
    none = lambda kind: F.lit(None).cast(kind)
    counted = lambda c: F.struct(
        _count(F.substring(c, 2, 19)).alias("count"), none("bigint").alias("local"), F.lit(True).alias("zoned"),
        none("bigint").alias("shift"), none("int").alias("month"),
    )
    read = lambda c: F.when(c.startswith("#"), counted(c)).when(c.isNotNull(), _let(F.split(c, r"\|"), _fields))
    return _let(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")), lambda s: _let(_canonical(s, order), read))


def resolve_instants(messages: DataFrame, sources: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """messages with instant_us (microseconds since 1970 UTC, null where the writing names no single instant).

    A null or unknown source leaves dates without a zone unresolved. Missing, blank and undated text, days without a
    time, days that do not exist and local times that occur twice or never give null, as do dates without a zone outside of first_year to last_year. Sources are few; their zones
    are read to build the interval table. Columns of messages are kept; repeated source ids count once.
    """
    clocks = sources.where("source_id is not null").groupBy("source_id").agg(
        F.min("home_zone").alias("_home"), F.min("date_order").alias("_order")
    )
    zones = [r[0] for r in sources.select("home_zone").where("home_zone is not null").distinct().collect()]
    table = zone_intervals(messages.sparkSession, zones, first_year, last_year)
    # a megabyte for each dozen zones
    months = table.select(F.col("zone").alias("_home"), F.col("month").alias("_month"), "intervals")
    df = messages.join(clocks, "source_id", "left").withColumn("_w", written_fields(F.col("date_raw"), F.col("_order")))
    df = df.withColumn("_month", F.when(~F.col("_w.zoned"), F.col("_w.month"))).join(F.broadcast(months), ["_home", "_month"], "left")
    local = F.col("_w.local")
    held = F.filter("intervals", lambda x: (x["low"] <= local) & (local < x["high"]))
    one = _let(held, lambda x: F.when(F.size(x) == 1, local - F.get(x, F.lit(0))["shift"].cast("bigint") * MICROS))
    zoned = local - F.col("_w.shift") * MICROS
    instant = F.coalesce("_w.count", F.when(F.col("_w.zoned"), zoned).otherwise(one))
    return df.withColumn("instant_us", instant).drop("_home", "_order", "_month", "_w", "intervals")


def as_timestamp(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"))


def misread(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose written date means one instant while sent_at is null or a second or more away from it."""
    sent = F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col("sent_at").cast("timestamp_ntz"))
    rows = resolve_instants(messages.select("read_ord", "source_id", "date_raw", "sent_at"), sources)
    return rows.where(F.col("instant_us").isNotNull() & (F.col("sent_at").isNull() | (F.abs(sent - F.col("instant_us")) >= MICROS)))
