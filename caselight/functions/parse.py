"""Parsing of times, numbers and clinical results as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight.functions.binding import let
from caselight.functions.text import casefold, clean

#: Result words by category and group, in order of precedence.
CATEGORIES = (
    ("positive", "polarity", ("positive", "pos", "dương tính", "duong tinh", "phát hiện", "phat hien", "detected")),
    ("negative", "polarity", ("negative", "neg", "âm tính", "am tinh", "không phát hiện", "khong phat hien", "not detected")),
    ("indeterminate", "polarity", ("indeterminate", "không xác định", "khong xac dinh", "nghi ngờ", "nghi ngo", "equivocal")),
    ("normal", "interpretation", ("normal", "bình thường", "binh thuong")),
    ("abnormal", "interpretation", ("abnormal", "bất thường", "bat thuong")),
    ("not_applicable", "status", ("n/a", "not applicable", "không áp dụng", "khong ap dung")),
    ("not_performed", "status", ("not done", "not performed", "chưa thực hiện", "chua thuc hien", "chưa làm", "chua lam")),
    ("unknown", "status", ("unknown", "không rõ", "khong ro")),
)
#: Ordinal words and their levels.
ORDINALS = {
    "trace": 1.0, "low": 1.0, "thấp": 1.0, "thap": 1.0, "mild": 1.0, "moderate": 2.0, "vừa": 2.0, "vua": 2.0, "medium": 2.0,
    "high": 3.0, "cao": 3.0, "severe": 3.0,
}
_NUMBER = r"([+-]?\d+(?:[.,]\d+)?)"
#: Shapes of results.
COMPARATOR = rf"^(<=|>=|<|>)\s*{_NUMBER}$"
RANGE = rf"^(?i){_NUMBER}\s*(?:-|–|—|to|đến)\s*{_NUMBER}$"
APPROXIMATE = rf"^(?i)(?:~|≈|about|approximately|approx\.?|khoảng|khoang)\s*{_NUMBER}\s*(.*)$"
SCIENTIFIC = rf"^(?i){_NUMBER}\s*[x×]\s*10\s*\^?\s*([+-]?\d+)\s*(.*)$"
EXACT = rf"^{_NUMBER}$"


def number(c: Column) -> Column:
    """A finite number with a decimal point or comma, else null."""
    return let(F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def _moment(*parts: Column | str) -> Column:
    """A time from the parts of its ISO text, in no zone; null if there is no such time."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).try_cast("timestamp_ntz")


def parse_time(c: Column) -> Column:
    """Time from YYYYMMDDHHMM, YYYYMMDD, a spreadsheet day number from 20000 to 60000, or a standard text; else null. The session's zone has no part in it."""
    raw = F.regexp_replace(F.trim(c), r"\.0+$", "")
    number_ = F.trim(c).try_cast("double")
    day = F.when(number_.between(20000, 60000), number_)
    serial = F.expr("TIMESTAMP_NTZ '1899-12-30 00:00:00'") + F.make_dt_interval(F.floor(day).cast("int"), F.lit(0), F.lit(0), F.round((day - F.floor(day)) * 86400, 6).cast("decimal(18,6)"))
    part = lambda start, n: F.substring(raw, start, n)
    date = (part(1, 4), "-", part(5, 2), "-", part(7, 2))
    out = F.when(raw.rlike(r"^\d{12}$"), _moment(*date, " ", part(9, 2), ":", part(11, 2), ":00")).when(raw.rlike(r"^\d{8}$"), _moment(*date))
    return out.when(day.isNotNull(), serial).otherwise(F.trim(c).try_cast("timestamp_ntz"))


#: The layouts of visit dates, year first and day first, with or without time.
_YEAR_FIRST = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?))?$"
_DAY_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}:\d{1,2})(:\d{1,2})?)?$"


def parse_date(c: Column, strict: bool = True) -> Column:
    """The time of a visit date in one of six layouts: year-month-day or day/month/year, each with or without time.

    Any other text, a missing one included, fails the job when it is met; without strict it gives null.
    """

    def read(text: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(text, pattern, i)
        year = F.when(text.rlike(_YEAR_FIRST), _moment(part(_YEAR_FIRST, 1), "-", part(_YEAR_FIRST, 2), "-", part(_YEAR_FIRST, 3), " ", F.coalesce(F.nullif(part(_YEAR_FIRST, 4), F.lit("")), F.lit("00:00:00"))))
        clock = F.coalesce(F.nullif(part(_DAY_FIRST, 4), F.lit("")), F.lit("00:00"))
        day = F.when(text.rlike(_DAY_FIRST), _moment(part(_DAY_FIRST, 3), "-", part(_DAY_FIRST, 2), "-", part(_DAY_FIRST, 1), " ", clock, F.coalesce(F.nullif(part(_DAY_FIRST, 5), F.lit("")), F.lit(":00"))))
        known = F.coalesce(year, day)
        return F.coalesce(known, F.raise_error(F.concat(F.lit("no known date: "), text)).cast("timestamp_ntz")) if strict else known

    return let(clean(c), read)


def study_date(c: Column) -> Column:
    """The date in the first eight characters."""
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 8), F.lit("yyyyMMdd")))


def category(c: Column) -> Column:
    """struct(name, group) of a cleaned result word, null for other texts; the first dictionary that has it counts."""
    return let(casefold(c), _category)


def _category(key: Column) -> Column:
    pair = lambda name, group: F.struct(name.alias("name"), F.lit(group).alias("group"))
    words = {"-": pair(F.lit("negative"), "polarity")} | {w: pair(F.lit(w), "ordinal") for w in ORDINALS}
    for word, group, texts in reversed(CATEGORIES):
        words |= {t: pair(F.lit(word), group) for t in texts}
    plus = key.rlike(r"^(?:\+{1,4}|[1-4]\+)$")
    table = F.create_map(*(x for t, p in words.items() for x in (F.lit(t), p)))
    return F.coalesce(F.try_element_at(table, key), F.when(plus, pair(F.concat(F.lit("positive_"), F.replace(key, F.lit("+"), F.lit("plus"))), "semi_quantitative")))


def ordinal_level(name: Column) -> Column:
    """The level of an ordinal word or of a count of plus signs."""
    out = F.when(name.rlike(r"^positive_(?:plus)+$"), F.regexp_count(name, F.lit("plus")).cast("double"))
    out = out.when(name.rlike(r"^positive_\dplus$"), F.regexp_extract(name, r"(\d)", 1).cast("double"))
    for word, level in ORDINALS.items():
        out = out.when(name == word, F.lit(level))
    return out


def parse_result(c: Column) -> Column:
    """The typed reading of a result text as a struct; the first shape that fits counts."""
    return let(clean(c), lambda raw: let(category(raw), lambda word: let(_kind(raw, word), lambda kind: let(_bounds(raw, kind), lambda b: _result(raw, word, kind, b)))))


def _kind(raw: Column, word: Column) -> Column:
    kinds = [
        (raw == "", "missing"), (word["group"].isin("semi_quantitative", "ordinal"), "semi_quantitative"), (word.isNotNull(), "categorical"), (raw.rlike(COMPARATOR), "numeric_censored"),
        (raw.rlike(RANGE), "numeric_interval"), (raw.rlike(APPROXIMATE), "numeric_approx"), (raw.rlike(SCIENTIFIC), "numeric_with_unit"), (raw.rlike(EXACT), "numeric_exact"),
    ]
    out = F.when(*kinds[0])
    for cond, value in kinds[1:]:
        out = out.when(cond, value)
    return out.otherwise("free_text")


def _bounds(raw: Column, kind: Column) -> Column:
    part = lambda pattern, i: F.regexp_extract(raw, pattern, i)
    op = F.when(kind == "numeric_censored", part(COMPARATOR, 1)).otherwise(F.lit(""))
    sides = lambda o: F.struct(
        o.alias("op"),
        F.when(o.isin(">", ">="), number(part(COMPARATOR, 2))).when(kind == "numeric_interval", number(part(RANGE, 1))).alias("lower"),
        F.when(o.isin("<", "<="), number(part(COMPARATOR, 2))).when(kind == "numeric_interval", number(part(RANGE, 2))).alias("upper"),
        F.when(kind == "numeric_approx", number(part(APPROXIMATE, 1)))
        .when(kind == "numeric_with_unit", number(part(SCIENTIFIC, 1)) * F.pow(F.lit(10.0), part(SCIENTIFIC, 2).try_cast("double")))
        .when(kind == "numeric_exact", number(raw))
        .alias("exact"),
    )
    return let(op, sides)


def _result(raw: Column, word: Column, kind: Column, b: Column) -> Column:
    is_ = lambda k: kind == k
    half = b["op"].isin("<", "<=") & (b["upper"] >= 0)
    proxy = F.when(half, b["upper"] / 2).when(is_("numeric_censored"), b["lower"]).when(is_("numeric_interval"), (b["lower"] + b["upper"]) / 2).otherwise(b["exact"])
    method = F.when(half, "half_upper_bound_nonnegative").when(is_("numeric_censored"), "lower_bound").when(is_("numeric_interval"), "interval_midpoint")
    method = method.when(is_("numeric_approx"), "approximate_value").when(is_("numeric_with_unit"), "scientific_notation").when(is_("numeric_exact"), "exact_value").otherwise("")
    subtype = F.when(is_("numeric_approx"), "approximate").when(is_("numeric_with_unit"), "scientific_notation").otherwise("")
    unit = F.when(is_("numeric_approx"), F.trim(F.regexp_extract(raw, APPROXIMATE, 2))).when(is_("numeric_with_unit"), F.trim(F.regexp_extract(raw, SCIENTIFIC, 3))).otherwise("")
    name = F.coalesce(word["name"], F.lit(""))
    return F.struct(
        raw.alias("result_raw"), kind.alias("result_type"), b["exact"].alias("result_numeric"), proxy.alias("value_proxy"), method.alias("proxy_method"), subtype.alias("numeric_subtype"),
        unit.alias("value_unit"), b["op"].alias("result_operator"), b["lower"].alias("result_lower_bound"), b["upper"].alias("result_upper_bound"), name.alias("result_category"),
        F.coalesce(word["group"], F.lit("")).alias("result_category_group"), ordinal_level(name).alias("ordinal_level"),
    )


def convert(value: Column, kind: Column, approved: Column, multiplier: Column, offset: Column) -> Column:
    """The value in its approved unit, for exact results only."""
    return F.when(approved & (kind == "numeric_exact") & value.isNotNull(), value * F.coalesce(multiplier, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0)))


def observation_proxy(proxy: Column, exact: Column, lower: Column, upper: Column) -> Column:
    """The proxy, the exact value, the middle of the bounds, half of an upper bound that isn't negative, or the lower bound."""
    return F.coalesce(proxy, exact, F.when(lower.isNotNull() & upper.isNotNull(), (lower + upper) / 2), F.when(lower.isNull() & (upper >= 0), upper / 2), lower)


def observation_values(kind: Column, exact: Column, word: Column, raw: Column, numeric: tuple[str, ...] = ("numeric_exact", "numeric_with_unit")) -> Column:
    """struct(numeric, text): a number, a category, or the raw text of qualified results."""
    text = F.when(kind.isin("categorical", "semi_quantitative"), word).when(~kind.isin(*numeric, "missing"), raw)
    return F.struct(F.when(kind.isin(*numeric), exact).alias("numeric"), text.alias("text"))


def age_at(time: Column, birth_year: Column) -> Column:
    """Years between the birth year and the time's, null outside 0 to 120."""
    age = F.year(time) - birth_year
    return F.when(age.between(0, 120), age)


def hours_between(time: Column, since: Column) -> Column:
    """Hours from since to time."""
    return (F.unix_micros(time.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(3.6e9)


def day_bucket(hours: Column) -> Column:
    """Whole days, with a number out of range for unknown time."""
    return F.coalesce(F.floor(hours / 24).cast("int"), F.lit(-2147483648))


def temporal_status(time: Column, admission: Column, discharge: Column) -> Column:
    """Where a time lies against a visit."""
    return F.when(time.isNull(), "unknown").when(time < admission, "before_admission").when(time > discharge, "after_discharge").otherwise("within_visit")


def imputed_time(time: Column, *fallbacks: tuple[str, Column]) -> Column:
    """struct(time, imputed, source): the time, or the first fallback that is known."""
    source = F.lit("none")
    for name, c in reversed(fallbacks):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.struct(F.coalesce(time, *(c for _, c in fallbacks)).alias("time"), time.isNull().alias("imputed"), F.when(time.isNotNull(), "event").otherwise(source).alias("source"))


def node_features(value: Column, median: Column, iqr: Column, count: Column, hours: Column, kind: Column, lower: Column, upper: Column, level: Column, masked: Column) -> Column:
    """The 16 features of a graph node, as an array, in this order.

    Scaled value, ln(1 + count), hours / 168, has value, has time, lacks value, is masked, is censored, is an interval, is a category
    or status, scaled bounds, has them, ordinal level / 4, has a level. Values and bounds are scaled by the token's median
    and spread (1 where it has none) and clipped to 5, hours to 4; a masked value is 0, and what isn't known is 0.
    """
    clip = lambda c, low, high: F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))).otherwise(F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    has = lambda c: flag(c.isNotNull() & ~F.isnan(c))
    spread = F.when(iqr <= 1e-8, F.lit(1.0)).otherwise(F.coalesce(iqr, F.lit(1.0)))
    scaled = lambda c: clip((c.cast("double") - F.coalesce(median, F.lit(0.0))) / spread, -5, 5)
    value, hours, lower, upper, level = (c.cast("double") for c in (value, hours, lower, upper, level))
    return F.array(
        F.when(F.coalesce(masked, F.lit(False)), F.lit(0.0)).otherwise(scaled(value)), F.log1p(F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).cast("double")), clip(hours / 168, -4, 4),
        has(value), has(hours), 1 - has(value), flag(masked), flag(kind == "numeric_censored"), flag(kind == "numeric_interval"),
        flag(kind.isin("categorical", "semi_quantitative", "not_applicable", "not_performed", "unknown")), scaled(lower), scaled(upper), has(lower), has(upper), clip(level / 4, 0, 1), has(level),
    )
