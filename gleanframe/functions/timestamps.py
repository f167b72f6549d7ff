"""Mixed timestamp texts to one UTC instant (problem 5).

All formats are one regex alternation with named groups. A text is matched once: the replacement
string writes every component, in fixed order, between separators, and a group of an alternative
that did not take part writes nothing. Calendar checks and the instant itself are integer
arithmetic on those components. Match and instant each come from a generator of one element, which
keeps the optimiser from copying them into the filters above, so the path stays in generated JVM code.

Rules
-----
* Outer white space of any kind, full-width digits and full-width punctuation are spelling.
* Parts that are not written are zero; digits beyond microseconds are cut off.
* Bare digits count seconds (up to 11 digits), milliseconds (12 to 14) or microseconds (15 to 17).
* Year last: slashes mean month first, dots day first.
* An offset (also ``Z``, ``UTC``, ``GMT``) wins over a zone name. A zone name without offset, or
  else the row's own zone, gives wall-clock time; a null or blank row zone is UTC. In a repeated
  hour the earlier instant is taken, in a skipped hour time moves forward by the skip.
* Impossible dates or clock times, unknown zones and anything else give null; so does null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\u0001"
#: The white space characters of Unicode, zero-width space and byte-order mark.
BLANKS = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_FULL = "０１２３４５６７８９：／．－＋，\u3000\u2212" + _SEP
_HALF = "0123456789:/.-+, -?"

#: Month names as written in English stamps.
_MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
    "Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Days before each month in a common year, and the days of each month.
_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +)"
_CLOCK = r"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?"
_OFFSET = r"(?<o{n}>[Zz]|UTC|GMT|[+-]\d{{2}}(?::?\d{{2}})?)"

#: Component names in the order in which the replacement writes them.
_FIELDS = ("y", "mo", "mn", "d", "h", "mi", "s", "f", "ap", "o", "z", "e")

_DATES = "|".join(
    (
        r"(?<y1>\d{4})(?<sep>[-/:.])(?<mo1>\d{1,2})\k<sep>(?<d1>\d{1,2})",
        r"(?<d2>\d{1,2})\.(?<mo2>\d{1,2})\.(?<y2>\d{4})",
        r"(?<mo3>\d{1,2})/(?<d3>\d{1,2})/(?<y3>\d{4})",
        rf"{_WEEKDAY}?(?<d4>\d{{1,2}})[ -](?<mn4>{_MONTHS})\.?[ -](?<y4>\d{{4}})",
        rf"{_WEEKDAY}?(?<mn5>{_MONTHS})\.? (?<d5>\d{{1,2}}),? (?<y5>\d{{4}})",
    )
)
_PATTERN = (
    "(?i)^(?:"
    # a date, then perhaps a clock time, half of day, offset, zone
    rf"(?:{_DATES})"
    rf"(?:(?:T|,? +){_CLOCK.format(n=1)}(?: ?(?<ap1>[AP])\.?M\.?)?)?"
    rf"(?: ?{_OFFSET.format(n=1)})?"
    r"(?: ?\[(?<zb1>[^\[\]]+)\]| (?<z1>[A-Z]+(?:/[A-Z0-9_+-]+)+))?"
    "|"
    # basic form without separators
    r"(?<y6>\d{4})(?<mo6>\d{2})(?<d6>\d{2})T(?<h2>\d{2})(?<mi2>\d{2})(?:(?<s2>\d{2})(?:[.,](?<f2>\d+))?)?"
    rf" ?{_OFFSET.format(n=2)}?(?:\[(?<zb2>[^\[\]]+)\])?"
    "|"
    # Chinese units
    r"(?<y7>\d{4})年(?<mo7>\d{1,2})月(?<d7>\d{1,2})日"
    r"(?: *(?<h3>\d{1,2})[时時点](?:(?<mi3>\d{1,2})分(?:(?<s3>\d{1,2})秒)?)?)?"
    "|"
    # clock time before the year
    rf"{_WEEKDAY}(?<mn8>{_MONTHS}) +(?<d8>\d{{1,2}}) {_CLOCK.format(n=4)}(?: {_OFFSET.format(n=4)})? (?<y8>\d{{4}})"
    "|"
    r"(?<e1>\d{1,17})"
    ")$"
)
_GROUPS = {
    "y": ("y1", "y2", "y3", "y4", "y5", "y6", "y7", "y8"),
    "mo": ("mo1", "mo2", "mo3", "mo6", "mo7"),
    "mn": ("mn4", "mn5", "mn8"),
    "d": ("d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8"),
    "h": ("h1", "h2", "h3", "h4"),
    "mi": ("mi1", "mi2", "mi3", "mi4"),
    "s": ("s1", "s2", "s3", "s4"),
    "f": ("f1", "f2", "f4"),
    "ap": ("ap1",),
    "o": ("o1", "o2", "o4"),
    "z": ("zb1", "z1", "zb2"),
    "e": ("e1",),
}
_REPLACEMENT = _SEP + _SEP.join("".join(f"${{{g}}}" for g in _GROUPS[k]) for k in _FIELDS)

#: A text in this form already is the normal form.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?\+00:00$"


def zone_known(zone: Column) -> Column:
    """Whether the engine knows a region's name, such as ``Asia/Shanghai``; it reads a stamp with it or not."""
    return zone.rlike("^[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+$") & F.concat(F.lit("2000-01-01 00:00:00 "), zone).try_cast("timestamp").isNotNull()


def once(c: Column) -> Column:
    """``c`` from a generator of one element: worked out once a row, never copied into the filters and projections above it."""
    return F.explode(F.array(c))


def trim_space(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def _trimmed(c: Column) -> Column:
    return trim_space(F.translate(c, _FULL, _HALF))


def _int(c: Column) -> Column:
    """A component as bigint; an unwritten one is zero."""
    return F.when(c == "", F.lit(0)).otherwise(c.try_cast("bigint")).cast("bigint")


def _days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers (years 0 to 9999)."""
    yy = F.when(m <= 2, y - 1).otherwise(y) + F.lit(400)  # one era ahead: never negative
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468 - 146097


def with_instant(df: DataFrame, text: str, zone: str | None, out: str, normal: bool = True) -> DataFrame:
    """``df`` plus bigint ``out``: microseconds since 1970-01-01 UTC that ``text`` denotes, or null.

    ``zone`` names the column with the zone of the clock that wrote the row's stamps. ``normal`` says
    whether texts in the normal form occur; if not, none is looked for. Helper
    columns carry a random suffix, so no column of ``df`` can clash with them.
    """
    tag = uuid.uuid4().hex[:12]
    c = {k: f"__{k}_{tag}" for k in ("t", "n", "p", *_FIELDS, "off", "zone", "us")}
    keep = [F.col(f"`{x}`") for x in df.columns]
    col = lambda k: F.col(c[k])
    # the normal form needs no match: the engine reads it itself
    text_ = F.col(f"`{text}`").cast("string")
    if normal:
        df = df.select(*keep, text_.alias(c["t"]), F.coalesce(text_.rlike(CANONICAL) & ~text_.startswith("0000"), F.lit(False)).alias(c["n"]))
    else:
        df = df.select(*keep, text_.alias(c["t"]), F.lit(False).alias(c["n"]))
    raw = F.split(F.regexp_replace(_trimmed(F.when(~col("n"), col("t"))), _PATTERN, _REPLACEMENT), _SEP)
    df = df.select(*keep, F.when(col("n"), F.unix_micros(col("t").try_cast("timestamp"))).alias(c["n"]), once(raw).alias(c["p"]))
    df = df.select(*keep, col("n"), F.when(F.size(col("p")) == len(_FIELDS) + 1, col("p")).alias(c["p"]))
    at = {k: F.get(col("p"), F.lit(i + 1)) for i, k in enumerate(_FIELDS)}
    month = F.when(at["mn"] != "", (F.instr(F.lit(_MONTH_STARTS), F.lower(F.substring(at["mn"], 1, 3))) + 2) / 3).otherwise(at["mo"].try_cast("int"))
    wall = F.coalesce(F.nullif(F.trim(F.col(f"`{zone}`")), F.lit("")), F.lit("UTC")) if zone else F.lit("UTC")
    df = df.select(
        *keep,
        col("n"),
        *[_int(at[k]).alias(c[k]) for k in ("y", "d", "h", "mi", "s")],
        month.cast("bigint").alias(c["mo"]),
        F.rpad(F.substring(at["f"], 1, 6), 6, "0").cast("bigint").alias(c["f"]),
        F.upper(at["ap"]).alias(c["ap"]),
        F.upper(at["o"]).alias(c["o"]),
        F.when(at["z"] != "", at["z"]).otherwise(wall).alias(c["zone"]),
        at["e"].alias(c["e"]),
    )
    leap = ((col("y") % 4 == 0) & (col("y") % 100 != 0)) | (col("y") % 400 == 0)
    last = F.element_at(F.array(*map(F.lit, _DAYS)), F.greatest(F.lit(1), F.least(F.lit(12), col("mo"))).cast("int"))
    last = last + F.when((col("mo") == 2) & leap, 1).otherwise(0)
    ap = col("ap")
    ok = (
        (col("y") >= 1) & col("mo").between(1, 12) & (col("d") >= 1) & (col("d") <= last)
        & F.when(ap == "", col("h") <= 23).otherwise(col("h").between(1, 12))
        & (col("mi") <= 59) & (col("s") <= 59)
    )
    hour = F.when(ap == "", col("h")).otherwise(col("h") % 12 + F.when(ap == "P", 12).otherwise(0))
    seconds = _days_from_civil(col("y"), col("mo"), col("d")) * 86400 + hour * 3600 + col("mi") * 60 + col("s")
    digits = F.regexp_replace(F.substring(col("o"), 2, 5), ":", "")
    oh, om = _int(F.substring(digits, 1, 2)), _int(F.substring(digits, 3, 2))
    signed = F.substring(col("o"), 1, 1)
    offset = (
        F.when(signed.isin("+", "-"), F.when((oh <= 18) & (om <= 59), (oh * 60 + om) * F.when(signed == "-", -1).otherwise(1)))
        .when(col("o") != "", F.lit(0))
        .cast("bigint")
    )
    named = F.nullif(col("o"), F.lit("")).isNull()
    df = df.select(
        *keep,
        col("n"),
        F.when(ok, seconds * 1_000_000 + F.coalesce(col("f"), F.lit(0))).cast("bigint").alias(c["us"]),
        offset.alias(c["off"]),
        F.when(named, col("zone")).alias(c["zone"]),
        col("e"),
    )
    epoch = F.nullif(col("e"), F.lit(""))
    unit = F.when(F.length(epoch) <= 11, 1_000_000).when(F.length(epoch) <= 14, 1_000).otherwise(1)
    zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(col("us")), col("zone")))
    instant = (
        F.when(col("n").isNotNull(), col("n"))
        .when(epoch.isNotNull(), epoch.try_cast("bigint") * unit)
        .when(col("off").isNotNull(), col("us") - col("off") * 60_000_000)
        .when(col("zone").isin("UTC", "GMT"), col("us"))
        .when(zone_known(col("zone")), zoned)
    )
    return df.select(*keep, once(instant.cast("bigint")).alias(out))
