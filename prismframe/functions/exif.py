"""SQL of labels for photo and stream metadata, and of angles."""

from __future__ import annotations

import math

#: Names of codec profiles.
PROFILES = (
    ("hevc", 1, "Main"), ("hevc", 2, "Main 10"), ("hevc", 3, "Main Still"), ("hevc", 4, "Range Ext"),
    ("h264", 66, "Baseline"), ("h264", 77, "Main"), ("h264", 88, "Extended"), ("h264", 100, "High"),
    ("h264", 110, "High 10"), ("h264", 122, "High 4:2:2"), ("h264", 244, "High 4:4:4"),
    ("av1", 0, "Main"), ("av1", 1, "High"), ("av1", 2, "Professional"), ("vp9", 0, "Profile 0"), ("vp9", 2, "Profile 2"),
)


def fixed(n: str, d: str, places: int) -> str:
    """n / d (whole, not negative, d > 0) with so many decimals; exact, ties go to the even digit."""
    scaled = f"({n}) * {10**places}L"
    q, r = f"({scaled} div ({d}))", f"({scaled} % ({d}))"
    up = f"({q} + if(2 * {r} > ({d}) or (2 * {r} = ({d}) and {q} % 2 = 1), 1, 0))"
    if not places:
        return f"cast({up} as string)"
    return f"concat({up} div {10**places}, '.', lpad(cast({up} % {10**places} as string), {places}, '0'))"


def exposure_time(n: str, d: str) -> str:
    return f"case when {n} = 0 or {d} = 0 then null when {d} > {n} then concat('1/', {d} div {n}) else concat({fixed(n, d, 1)}, 's') end"


def f_number(n: str, d: str) -> str:
    return f"case when {d} <> 0 then concat('f/', {fixed(n, d, 1)}) end"


def focal_length(n: str, d: str) -> str:
    return f"case when {d} <> 0 then concat({fixed(n, d, 0)}, ' mm') end"


def dpi(unit: str, xn: str, xd: str, yn: str, yd: str) -> str:
    """Resolution label: unit 1 has none, 3 is per centimetre; both axes where they differ by more than a half."""
    x, y = f"(2 * {xn} > {xd} and {xd} <> 0)", f"(2 * {yn} > {yd} and {yd} <> 0)"
    apart = f"(2 * abs({xn} * {yd} - {yn} * {xd}) > {xd} * {yd})"
    suffix = f"if(coalesce({unit}, 2) = 3, ' DPCM', ' DPI')"
    return (
        f"case when coalesce({unit}, 2) = 1 or not coalesce({x}, false) then null "
        f"when {y} and {apart} then concat({fixed(xn, xd, 0)}, ' × ', {fixed(yn, yd, 0)}, {suffix}) else concat({fixed(xn, xd, 0)}, {suffix}) end"
    )


def color_space(code: str) -> str:
    return f"case {code} when 1 then 'sRGB' when 65535 then 'Uncalibrated' end"


def degrees(parts: str) -> str:
    """parts: array of (num, den) of degrees, minutes and seconds."""
    good = f"size({parts}) >= 3 and {parts}[0].den <> 0 and {parts}[1].den <> 0 and {parts}[2].den <> 0"
    return f"if({good}, {parts}[0].num / {parts}[0].den + {parts}[1].num / {parts}[1].den / 60D + {parts}[2].num / {parts}[2].den / 3600D, null)"


def gps(lat: str, lat_ref: str, lon: str, lon_ref: str) -> str:
    """Signed decimal degrees of two arrays of (num, den); null if either is incomplete."""
    sign = lambda ref, letter: f"if(contains(coalesce({ref}, ''), '{letter}'), -1, 1)"
    a, b = f"({degrees(lat)}) * {sign(lat_ref, 'S')}", f"({degrees(lon)}) * {sign(lon_ref, 'W')}"
    units = lambda v: f"cast(floor(abs({v}) * 10000 + 0.5) as long)"
    label = lambda v: f"if({v} < 0, '-', ''), {units(v)} div 10000, '.', lpad(cast({units(v)} % 10000 as string), 4, '0')"
    return f"if(({a}) is null or ({b}) is null, null, concat({label(f'({a})')}, ', ', {label(f'({b})')}))"


def text_field(text: str) -> str:
    return rf"""nullif(regexp_replace(regexp_replace({text}, r'^\s+|\s+$', ''), r'^"+|"+$', ''), '')"""


def bit_depth(depth: str) -> str:
    return f"case when {depth} is null then null when {depth} = 32 then '32-bit float' when {depth} = 16 then '16-bit' else '8-bit' end"


def sample_rate(hz: str) -> str:
    return f"concat({fixed(hz, '1000', 1)}, ' kHz')"


def bitrate(bps: str) -> str:
    return f"case when {bps} <= 0 then null when {bps} >= 1000000 then concat({fixed(bps, '1000000', 1)}, ' Mbps') else concat({fixed(bps, '1000', 0)}, ' kbps') end"


def codec_label(name: str, profile: str) -> str:
    known = " ".join(f"when lower({name}) = '{codec}' and {profile} = {number} then ' ({label})'" for codec, number, label in PROFILES)
    return f"if(coalesce({name}, '') = '', null, concat(upper({name}), case {known} else '' end))"


def angle_diff(a: str, b: str) -> str:
    """The smaller angle between two, in radians."""
    d = f"pmod(({a}) - ({b}), {2 * math.pi!r}D)"
    return f"least({d}, {2 * math.pi!r}D - {d})"
