"""What time a text means: absolute and relative dates in English and Chinese, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the grammar and what they stand for.
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sept": 9, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
DAYS = {
    "the day before yesterday": -2, "day before yesterday": -2, "yesterday": -1, "today": 0, "tomorrow": 1,
    "the day after tomorrow": 2, "day after tomorrow": 2, "前天": -2, "昨天": -1, "今天": 0, "明天": 1, "后天": 2,
}
TURNS = {"last": -1, "this": 0, "next": 1, "上": -1, "本": 0, "这": 0, "下": 1}
CHINESE_WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
MOST_YEARS = 999

_MONTH = {m: i + 1 for i, m in enumerate(MONTHS)} | SHORT_MONTHS
_NUMBER = {w: i for i, w in enumerate(NUMBERS)} | {w: 10 * i + 20 for i, w in enumerate(TENS)}
_ONE_OF = lambda words: "|".join(sorted(words, key=len, reverse=True))
_COUNT = rf"(?:(?:\d{{1,3}}(?:,\d{{3}})+|\d+|{_ONE_OF(_NUMBER)})(?:[- ](?:{_ONE_OF(NUMBERS[1:10])}))?)"

#: Each kind of expression; its groups are read by ``_interval``.
KINDS = {
    "iso": r"(\d{4})(?:-|/|年)(\d{1,2})(?:-|/|月)(\d{1,2})日?(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:?\d{2})?)?(?![T\d:+-])",
    "month": rf"\b({_ONE_OF(_MONTH)})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,?\s*(\d{{4}}))?\b",
    "us": r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)",
    "day": rf"(\b(?:{_ONE_OF(d for d in DAYS if d.isascii())})\b|{_ONE_OF(d for d in DAYS if not d.isascii())})",
    "ago": rf"(?<![\w,])({_COUNT})\s+(day|week|month|year)s?\s+ago(?![\w,])",
    "ahead": rf"(?<![\w,])in\s+({_COUNT})\s+(day|week|month|year)s?(?![\w,])",
    "offset": rf"(\d+|[{''.join(DIGITS)}十]+)个?(天|周|星期|个月|月|年)(前|后)",
    "weekday": rf"\b(last|this|next)\s+({_ONE_OF(WEEKDAYS)})\b",
    "week": r"\b(last|this|next)\s+week\b",
    "zh_weekday": rf"(上|本|这|下)周([{''.join(CHINESE_WEEKDAYS)}])",
    "zh_week": rf"(上|本|这|下)周(?![{''.join(CHINESE_WEEKDAYS)}])",
}
_FLAGS = "(?iU)"
ANY = _FLAGS + "(?:" + "|".join(p.replace("(", "(?:").replace("(?:?", "(?") for p in KINDS.values()) + ")"
_FROM = r"(?i)(from|between|从)\s*$"
_TO = r"(?i)^\s*(?:to|through|until|至|到|[-–—])\s*$"
_AND = r"(?i)^\s*(?:and|和|与|及|至|到)\s*$"


def _of(table: dict[str, int], word: Column) -> Column:
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))), word)


def _english(number: Column) -> Column:
    plain = F.replace(F.lower(number), F.lit(","), F.lit(""))
    words = F.transform(F.split(plain, "[- ]"), lambda w: _of(_NUMBER, w))
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("int")).when(~F.exists(words, lambda w: w.isNull()), F.aggregate(words, F.lit(0), lambda s, w: s + w))


def _chinese(number: Column) -> Column:
    digits = F.array_join(F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: _of(DIGITS, c).cast("string")), "")
    left, right = F.substring_index(number, "十", 1), F.substring_index(number, "十", -1)
    tens = F.when(left == "", 1).otherwise(F.coalesce(_of(DIGITS, left), F.lit(1)))
    return F.when(number.rlike(r"^\d+$"), number.try_cast("int")).when(F.contains(number, F.lit("十")), tens * 10 + F.coalesce(_of(DIGITS, right), F.lit(0))).otherwise(digits.try_cast("int"))


def _shifted(day: Column, amount: Column, unit: Column) -> Column:
    """A day some units away, by calendar months where it must be; null beyond the years 1 to 9999 and far-off years."""
    by = F.when(unit.isin("day", "天"), F.date_add(day, amount)).when(unit.isin("week", "周", "星期"), F.date_add(day, amount * 7))
    by = by.when(unit.isin("month", "月", "个月"), F.add_months(day, amount)).otherwise(F.when(F.abs(amount) <= MOST_YEARS, F.add_months(day, amount * 12)))
    return F.when((F.abs(amount) < 1_000_000) & F.year(by).between(1, 9999), by)


def _interval(token: Column, said: Column) -> Column:
    """``start, end`` of one expression, null where it is no date; a time of day has no end."""
    part = lambda kind, k: F.regexp_extract(token, f"{_FLAGS}^(?:{KINDS[kind]})$", k)
    number = lambda kind, k: part(kind, k).try_cast("int")
    is_a = lambda kind: part(kind, 0) != ""
    today = said.cast("date")
    monday = F.date_sub(today, F.weekday(today))
    zone = part("iso", 7)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.right(zone, F.lit(2)).try_cast("int")
    away = F.when(zone.rlike("^[+-]"), F.when((hours <= 23) & (minutes <= 59), (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))).otherwise(0)
    moment = F.try_make_timestamp_ntz(*(number("iso", k) for k in (1, 2, 3)), *(F.coalesce(number("iso", k), F.lit(0)) for k in (4, 5)), F.coalesce(number("iso", 6), F.lit(0)).cast("decimal(8,6)"))
    moment = moment - F.make_dt_interval(F.lit(0), F.lit(0), away)
    day_of = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")
    target, turn = F.lower(part("weekday", 2)), F.lower(part("weekday", 1))

    def weekday(to: Column, turn: Column) -> Column:
        ahead, back = F.pmod(to - F.weekday(today), F.lit(7)), F.pmod(F.weekday(today) - to, F.lit(7))
        move = F.when(turn > 0, F.when(ahead == 0, 7).otherwise(ahead)).when(turn < 0, -F.when(back == 0, 7).otherwise(back)).otherwise(to - F.weekday(today))
        return F.date_add(today, move)

    year = F.when(part("month", 3) == "", F.year(today)).otherwise(number("month", 3))
    day = (
        F.when(is_a("iso"), day_of(*(number("iso", k) for k in (1, 2, 3))))
        .when(is_a("month"), day_of(year, _of(_MONTH, F.lower(part("month", 1))), number("month", 2)))
        .when(is_a("us"), day_of(number("us", 3), number("us", 1), number("us", 2)))
        .when(is_a("day"), F.date_add(today, _of(DAYS, F.lower(part("day", 1)))))
        .when(is_a("ago"), _shifted(today, -_english(part("ago", 1)), F.lower(part("ago", 2))))
        .when(is_a("ahead"), _shifted(today, _english(part("ahead", 1)), F.lower(part("ahead", 2))))
        .when(is_a("offset"), _shifted(today, _chinese(part("offset", 1)) * F.when(part("offset", 3) == "前", -1).otherwise(1), part("offset", 2)))
        .when(is_a("weekday"), weekday(_of({w: i for i, w in enumerate(WEEKDAYS)}, target), _of(TURNS, turn)))
        .when(is_a("zh_weekday"), weekday(_of(CHINESE_WEEKDAYS, part("zh_weekday", 2)), _of(TURNS, part("zh_weekday", 1))))
    )
    turn = F.when(is_a("week"), _of(TURNS, F.lower(part("week", 1)))).when(is_a("zh_week"), _of(TURNS, part("zh_week", 1)))
    week = F.date_add(monday, 7 * turn)
    start = F.when(part("iso", 4) != "", moment).otherwise(F.coalesce(week, day).cast("timestamp_ntz"))
    end = F.when(part("iso", 4) == "", F.coalesce(F.date_add(week, 7), F.date_add(day, 1)).cast("timestamp_ntz"))
    return F.struct(start.alias("start"), end.alias("end"))


def occurrence(text: Column, said: Column, value: Column | None = None) -> Column:
    """``start, end`` of the time that a text means, said at ``said`` (without it only absolute dates with a year count).

    Expressions are marked in one pass and each is read by itself. Two in a row that are joined as a range (``from .. to``,
    ``between .. and``, a dash) are one interval; one alone is its own; of several the one that ``value``, the fact's
    text, names alone; else null.
    """

    def found(t: Column) -> Column:
        """Expressions in order with the text before each."""
        marked = F.split(F.regexp_replace(t, ANY, "\x01$0\x02"), "\x02")
        rows = F.transform(F.filter(marked, lambda p: F.contains(p, F.lit("\x01"))), lambda p: F.struct(F.substring_index(p, "\x01", 1).alias("before"), _interval(F.substring_index(p, "\x01", -1), said).alias("at"), F.substring_index(p, "\x01", -1).alias("token")))
        # What is no date is text before the next one.
        start = F.struct(F.lit("").alias("held"), F.array().cast("array<struct<before: string, at: struct<start: timestamp_ntz, end: timestamp_ntz>>>").alias("out"))
        step = lambda s, r: F.when(r["at"]["start"].isNull(), F.struct(F.concat(s["held"], r["before"], r["token"]).alias("held"), s["out"].alias("out"))).otherwise(F.struct(F.lit("").alias("held"), F.concat(s["out"], F.array(F.struct(F.concat(s["held"], r["before"]).alias("before"), r["at"].alias("at")))).alias("out")))
        return F.aggregate(rows, start, step)["out"]

    def ranges(rows: Column) -> Column:
        """The first pair that is a range."""
        pairs = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r, i: F.struct(F.get(rows, i).alias("left"), r.alias("right")))
        lead = lambda p: F.lower(F.regexp_extract(p["left"]["before"], _FROM, 1))
        last = lambda p: F.coalesce(p["right"]["at"]["end"], p["right"]["at"]["start"])
        joined = F.filter(pairs, lambda p: F.when(lead(p) == "between", p["right"]["before"].rlike(_AND)).otherwise(p["right"]["before"].rlike(_TO)) & (last(p) > p["left"]["at"]["start"]))
        return F.get(F.transform(joined, lambda p: F.struct(p["left"]["at"]["start"].alias("start"), last(p).alias("end"))), F.lit(0))

    def chosen(rows: Column) -> Column:
        own = F.when(F.size(rows) == 1, F.get(rows, F.lit(0))["at"])
        if value is not None:
            named = F.transform(F.array(found(value)), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))["at"]))[0]
            own = F.coalesce(own, F.when(F.exists(rows, lambda r: r["at"].eqNullSafe(named)), named))
        return F.coalesce(ranges(rows), own)

    return F.transform(F.array(found(text)), chosen)[0]
