"""Plain-Python versions of the general operators, written apart from them."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
WIDE = str.maketrans("０１２３４５６７８９：－／", "0123456789:-/")


def _utc(dt, zone):
    tz = ZoneInfo(zone)
    # fold 0 is the earlier instant; in a gap its offset is that before the change: time moves forward
    return (dt - dt.replace(tzinfo=tz, fold=0).utcoffset()) if tz else dt


def instant(text, wall):
    """Microseconds that a stamp denotes, or None; tries strptime formats one after the other."""
    if text is None:
        return None
    t = text.strip().translate(WIDE)
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", t):
        return int(t) * {10: 1_000_000, 13: 1000, 16: 1}[len(t)]
    zone = None
    if m := re.fullmatch(r"(.*[+-]\d\d:\d\d)\[.*\]", t):
        t = m[1]
    elif m := re.fullmatch(r"(.*\d) ([A-Za-z]+/[A-Za-z_]+|UTC)", t):
        t, zone = m[1], m[2]
    t = re.sub(r"GMT$", "+0000", re.sub(r"[zZ]$", "+0000", t))
    micros = 0
    if m := re.search(r":\d\d[.,](\d+)", t):
        micros = int(m[1][:6].ljust(6, "0"))
        t = t.replace(m[0], m[0][:3], 1)
    t = re.sub(r"(\d)t(\d)", r"\1T\2", t)
    forms = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y:%m:%d %H:%M:%S", "%Y/%m/%d %H:%M", "%d.%m.%Y %H:%M:%S"]
    forms += ["%Y%m%dT%H%M%S", "%Y年%m月%d日 %H时%M分", "%B %d, %Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%a, %d %b %Y %H:%M:%S"]
    for f in [x + z for x in forms for z in ("", "%z", " %z")] + ["%a %b %d %H:%M:%S %z %Y"]:
        try:
            dt = datetime.strptime(t, f)
        except ValueError:
            continue
        dt = dt.replace(microsecond=micros)
        if dt.tzinfo:
            dt = dt.astimezone(timezone.utc).replace(tzinfo=None)
        else:
            dt = _utc(dt, zone or wall or "UTC")
        return (dt - EPOCH) // timedelta(microseconds=1)
    return None


def key(k):
    k = k.strip() if isinstance(k, str) else None
    return None if k in (None, "", "DRYRUN") else k
