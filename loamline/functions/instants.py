"""Any usual notation of a time to one UTC instant (plain Python; runs once per distinct text)."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
#: Offsets of zone abbreviations in minutes; those that several countries use (CST, CDT) count only at a site whose
#: clock uses them.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "EAT": 180, "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AEST": 600, "AEDT": 660}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
PLACEHOLDER_NUMBERS = {Decimal(-9999), Decimal(-999)}

CLOCK = r"(?:[T ]+(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?)?"
ZONE = r"(?:\s*(?P<zone>[A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?))?"
FORMS = [
    re.compile(p + "$")
    for p in (
        r"(?P<Y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})" + CLOCK + ZONE,
        r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<Y>\d{4})" + CLOCK + ZONE,
        r"(?P<Y>\d{4})-(?P<j>\d{3})" + CLOCK + ZONE,
        r"(?P<Y>\d{4})_(?P<j>\d{3})(?:_(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?)?",
        r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[T ]?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,](?P<f>\d+))?)?" + ZONE,
        r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[- ](?P<b>[A-Za-z]{3,9})[- ](?P<Y>\d{4})" + CLOCK + ZONE,
        r"(?P<b>[A-Za-z]{3,9})\s+(?P<d>\d{1,2}),?\s+(?P<Y>\d{4})" + CLOCK + ZONE,
    )
]


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def local_to_utc(local: datetime, zone: str) -> datetime | None:
    """UTC of a wall-clock time; None if the site's clock shows it twice or never, or the zone is unknown."""
    z = _zone(zone)
    if z is None:
        return None
    first, second = (local.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
    return local - first if first == second else None


def _wall(g: dict[str, str | None]) -> tuple[datetime, Decimal] | None:
    """Whole seconds of wall time and its fraction; None for a date or clock that doesn't exist."""
    try:
        year = int(g["Y"])
        if g.get("j"):
            day = date(year, 1, 1) + timedelta(int(g["j"]) - 1)
            if int(g["j"]) < 1 or day.year != year:
                return None
        else:
            month = MONTHS.get(g["b"][:3].lower(), 0) if g.get("b") else int(g["m"])
            day = date(year, month, int(g["d"]))
        hour, minute, second = (int(g.get(k) or 0) for k in "HMS")
        fraction = Decimal("0." + (g.get("f") or "0"))
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["ap"] in "Pp")
        if hour == 24 and not minute and not second and not fraction:
            return datetime(day.year, day.month, day.day) + timedelta(1), fraction
        return datetime(day.year, day.month, day.day, hour, minute, second), fraction
    except (ValueError, OverflowError):
        return None


def _offset(zone: str, site: str | None, local: datetime) -> timedelta | None:
    name = zone.upper()
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?", name):
        hours, minutes = int(m[2]), int(m[3] or 0)
        return None if hours > 18 or minutes > 59 else (1 if m[1] == "+" else -1) * timedelta(hours=hours, minutes=minutes)
    if site and (z := _zone(site)):  # the site's own abbreviations
        for fold in (0, 1):
            aware = local.replace(tzinfo=z, fold=fold)
            if aware.tzname() == name and re.fullmatch("[A-Z]+", name):
                return aware.utcoffset()
    return timedelta(minutes=ABBREVIATIONS[name]) if name in ABBREVIATIONS else None


def _to_ms(when: datetime, fraction: Decimal = Decimal(0)) -> int:
    delta = when - EPOCH
    seconds = delta.days * 86400 + delta.seconds
    return int((Decimal(seconds) * 1000 + Decimal(delta.microseconds) / 1000 + fraction * 1000).quantize(Decimal(1), ROUND_HALF_UP))


def text_ms(text: str, site: str | None) -> int | None:
    """Milliseconds since 1970-01-01 UTC of a written date, or None: every form is tried, and one that gives a date that does not
    exist or no instant is no reading; readings that differ fix none."""
    found = set()
    for form in FORMS:
        if m := form.match(text):
            g = m.groupdict()
            wall = _wall(g)
            if wall is None:
                continue
            local, fraction = wall
            if zone := g.get("zone"):
                offset = _offset(zone, site, local)
                utc = None if offset is None else local - offset
            else:
                utc = local if site is None else local_to_utc(local, site)
            if utc is not None:
                found.add(_to_ms(utc, fraction))
    return found.pop() if len(found) == 1 else None


@lru_cache(maxsize=4096)
def unit_epoch(units: str) -> tuple[int, int] | None:
    """(milliseconds per unit, epoch in ms) of ``<unit> since <date>``; the unit goes by its first letter, but
    ``milliseconds`` (also msec, ms) means milliseconds."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s+since\s+(.+?)\s*", units, re.I)
    if not m:
        return None
    word = m[1].lower()
    size = 1 if word in ("ms", "msec", "msecs") or word.startswith("millisec") else UNIT_MS.get(word[0])
    epoch = text_ms(m[2], None)
    return None if size is None or epoch is None else (size, epoch)


def instant_ms(text: str | None, units: str | None, site: str | None) -> int | None:
    """UTC milliseconds of a delivered time, or None where the text doesn't fix one instant.

    With ``units`` the text is a number in them (text that is no number is read as a date); without, a bare number is
    only a compact date.  Zone-less dates are local time at ``site`` (UTC if that is None)."""
    if text is None:
        return None
    t = " ".join(text.split())
    site = site.strip() if site else None
    if not t or not any(c.isdigit() for c in t):
        return None
    if units and units.strip():
        try:
            number = Decimal(t)
        except InvalidOperation:
            return text_ms(t, site or None)
        scale = unit_epoch(units)
        if scale is None or not number.is_finite() or number in PLACEHOLDER_NUMBERS or abs(number) > Decimal(10) ** 18:
            return None
        ms = (number * scale[0] + scale[1]).quantize(Decimal(1), ROUND_HALF_UP)
        return int(ms) if abs(ms) < 2**62 else None
    return text_ms(t, site or None)

