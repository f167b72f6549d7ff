"""Column functions on numbers, hashes, times and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.timestamps import trim_space

# ---- hashes and vectors
def hamming(a: Column, b: Column) -> Column:
    """Bits in which two bigint fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hex_code(c: Column) -> Column:
    """A text of exactly 16 hex digits as bigint, else null."""
    h = F.lower(trim_space(c))
    return F.when(h.rlike("^[0-9a-f]{16}$"), F.conv(h, 16, -10).try_cast("bigint"))


def picture_code(c: Column) -> Column:
    """A 64-bit fingerprint as bigint, or null where it is not exactly 16 hex digits after a prefix that names the notation."""
    return hex_code(F.regexp_replace(F.lower(trim_space(c)), r"^(?:p?hash\s*[:=]\s*|0x)", ""))


def sign_code(vector: Column) -> Column:
    """Signs of the first 63 entries of a vector as the bits of a bigint."""
    bits = F.transform(F.slice(vector, 1, 63), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def short_name(c: Column) -> Column:
    """First 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(c), 1, 16)


def content_key(*parts: Column) -> Column:
    """SHA-256 over labelled parts; parts are parted by a zero byte, null parts are empty."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        pieces += [F.lit(f"{i}="), F.coalesce(p.cast("string"), F.lit("")), F.lit("\x00")]
    return F.sha2(F.concat(*pieces), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; null where one has no length."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, dot / norm)


# ---- coercions
def score_0_10(c: Column) -> Column:
    """A written score as an int from 0 to 10; fractions are cut off, what is no number is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(c.try_cast("int"), F.lit(0))))


def clamped(index: Column, size: Column) -> Column:
    """``index`` moved into 0 .. size-1."""
    return F.greatest(F.lit(0), F.least(index, size - 1))


def one_based(index: Column, size: Column) -> Column:
    """1 .. size as 0-based, anything else null."""
    return F.when(index.between(1, size), index - 1)


def truth(c: Column) -> Column:
    """Whether a written flag says yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def ramp(x: Column, low: Column | float, high: Column | float) -> Column:
    """0 below ``low``, 1 above ``high``, straight in between; a ramp without width is 1."""
    low, high = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when(high <= low, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def backoff(attempt: Column, base: float, factor: float, longest: float) -> Column:
    """Waiting time before attempt ``attempt`` + 1, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(longest))


# ---- places
def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees; south and west are negative."""
    value = d + m / F.lit(60.0) + s / F.lit(3600.0)
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def on_earth(lat: Column, lon: Column) -> Column:
    """Whether a position was really measured (0, 0 means it was not)."""
    return F.coalesce((F.abs(lat) > 1e-6) | (F.abs(lon) > 1e-6), F.lit(False))


def cell_key(lat: Column, lon: Column, places: int = 3) -> Column:
    """A coordinate's cell as text; null where the position was not measured."""
    written = lambda c: F.format_string(f"%.{places}f", F.round(c, places))
    return F.when(on_earth(lat, lon), F.concat_ws(",", written(lat), written(lon)))


def place_name(city: Column, locality: Column, country: Column) -> Column:
    """City, or else locality, and country, of what there is."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.nullif(F.concat_ws(", ", F.coalesce(some(city), some(locality)), some(country)), F.lit(""))


def camera_clock(c: Column) -> Column:
    """``HH:MM`` of a camera's ``YYYY:MM:DD HH:MM:SS``; null where that is no clock time."""
    t = F.regexp_extract(c, r"^[0-9]{4}:[0-9]{2}:[0-9]{2} ([0-9]{2}:[0-9]{2}):[0-9]{2}$", 1)
    return F.when(t.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), t)


def place_line(clock: Column, place: Column) -> Column:
    """A line of clock time and place, of what there is; null if there is neither."""
    return F.nullif(F.concat_ws(" ", F.lit("📍"), clock, place), F.lit("📍"))


# ---- times
def local_minute(ts: Column, hours: int = 8) -> Column:
    """Minute of the day on a clock ``hours`` ahead of UTC."""
    at = F.from_utc_timestamp(ts, "UTC") + F.make_interval(hours=F.lit(hours))
    return F.hour(at) * 60 + F.minute(at)


def in_window(minute: Column, start: int | None, end: int | None) -> Column:
    """Start inclusive, end exclusive, past midnight where the end comes first; no window is open."""
    if start is None or end is None:
        return F.lit(True)
    inside = (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)
    return inside


def clock_minutes(spec: str | None) -> tuple[int, int] | tuple[None, None]:
    """``HH:MM-HH:MM`` as two minutes of the day; what cannot be read is no window."""
    try:
        a, b = [[int(x) for x in part.split(":")] for part in (spec or "").split("-", 1)]
        return a[0] * 60 + a[1], b[0] * 60 + b[1]
    except (ValueError, IndexError):
        return None, None


def countdown(seconds: Column) -> Column:
    """Seconds as ``3h 07m``; nothing left is ``now``."""
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(seconds <= 0, "now").otherwise(F.concat(h.cast("string"), F.lit("h "), F.lpad(m.cast("string"), 2, "0"), F.lit("m")))


# ---- codes
def matches_any(c: Column, needles: list[str]) -> Column:
    """Whether a message names any of the needles, case apart; a null message names none."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(n.lower())), F.lit(False))
    return hit


def by_prefix(c: Column, prefixes: dict[str, str], default: str) -> Column:
    """The value of the first prefix that the text starts with, case apart."""
    out = F.when(F.lit(False), F.lit(default))
    for p, v in prefixes.items():
        out = out.when(F.startswith(F.lower(c), F.lit(p.lower())), v)
    return out.otherwise(F.lit(default))


def spec_parts(c: Column) -> Column:
    """``name[, effort][, cap]`` as a struct; unknown efforts and caps that are no number are null."""
    part = lambda i: F.nullif(F.trim(F.get(F.split(c, ","), F.lit(i))), F.lit(""))
    effort = F.lower(part(1))
    return F.struct(
        F.coalesce(part(0), F.lit("")).alias("name"),
        F.when(effort.rlike("^(off|low|high|[0-9]+)$"), effort).alias("effort"),
        F.when(part(2).rlike("^[0-9]+$"), part(2).try_cast("bigint")).alias("cap"),
    )


# ---- decisions
def much_later(later: Column, earlier: Column, days: int) -> Column:
    """Whether ``later`` lies more than ``days`` days after ``earlier``; unknown times do not."""
    return F.coalesce(later - earlier > F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def first_true(checks: dict[str, Column], otherwise: str) -> Column:
    """The name of the first check that holds, in order; one that is null does not hold."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for name, check in checks.items():
        out = out.when(F.coalesce(check, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def due(now: Column, last: Column, seconds: int) -> Column:
    """Whether nothing happened before, or the last time is at least ``seconds`` ago."""
    return last.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= seconds * 1_000_000)


def unless(evidence: Column) -> Column:
    """True unless the evidence is there: what is false or unknown shuts the gate."""
    return ~F.coalesce(evidence, F.lit(False))


def agree(a: Column, b: Column, missing: int) -> Column:
    """Whether two values are the same, a missing one read as ``missing``."""
    return F.coalesce(a, F.lit(missing)) == F.coalesce(b, F.lit(missing))


def index_or_zero(index: Column, size: Column) -> Column:
    """An index of 0 .. size-1; anything else is 0, not moved to the nearer end."""
    return F.when((index >= 0) & (index < size), index).otherwise(F.lit(0))


def marked(text: Column, mark: Column) -> Column:
    """``text`` with ``mark`` behind it, unless it ends with the mark already; a null text stays null."""
    bare = F.rtrim(text)
    return F.when(F.endswith(F.regexp_replace(text, r"\s+$", ""), mark), text).otherwise(F.concat(bare, F.lit(" "), mark))


#: What the orientation codes 2 to 8 of a camera ask for.
_TURNS = {2: "mirror", 3: "turn180", 4: "flip", 5: "transpose", 6: "turn270", 7: "transverse", 8: "turn90"}


def orientation(code: Column) -> Column:
    """The operation that sets a picture upright; other codes need none."""
    out = F.when(F.lit(False), F.lit("none"))
    for k, name in _TURNS.items():
        out = out.when(code == k, F.lit(name))
    return out.otherwise(F.lit("none"))


def prominence(likeness: Column, area: Column, least_likeness: float, least_area: float) -> Column:
    """``main`` where likeness and area suffice, ``small`` where only the likeness does, else ``other``."""
    alike = F.coalesce(likeness >= least_likeness, F.lit(False))
    return F.when(alike & F.coalesce(area >= least_area, F.lit(False)), "main").when(alike, "small").otherwise("other")
