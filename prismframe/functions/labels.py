"""SQL expressions for labels: durations, sizes, counts, aspect ratios, names, colours."""

from __future__ import annotations


def format_duration(us: str) -> str:
    return f"format_string('%d:%02d.%03d', {us} div 60000000, {us} div 1000000 % 60, {us} div 1000 % 1000)"


def format_size(n: str) -> str:
    return f"case when {n} >= 1048576 then format_string('%.1f MB', bround({n} / 1048576D, 1)) when {n} >= 1024 then format_string('%.1f KB', bround({n} / 1024D, 1)) else format_string('%d B', {n}) end"


def format_count(n: str) -> str:
    """Millions and thousands with one decimal, of a 32-bit quotient whose exact decimal value is rounded, ties to the even digit."""
    short = lambda by: f"cast(bround(cast(cast(cast({n} as float) / cast({by} as float) as float) as decimal(38, 18)), 1) as string)"
    return f"case when {n} >= 1000000 then concat({short(1000000)}, 'M') when {n} >= 1000 then concat({short(1000)}, 'K') else cast({n} as string) end"


def gcd(a: str, b: str) -> str:
    """Euclid's steps over a bounded sequence: 48 suffice for 32-bit sides."""
    step = "(p, i) -> if(p.b = 0, p, named_struct('a', p.b, 'b', p.a % p.b))"
    return f"aggregate(sequence(1, 48), named_struct('a', cast({a} as long), 'b', cast({b} as long)), {step}, p -> p.a)"


def aspect_ratio(w: str, h: str) -> str:
    return f"concat(cast({w} div {gcd(w, h)} as string), ':', cast({h} div {gcd(w, h)} as string))"


def extension(path: str) -> str:
    return f"regexp_extract({path}, '[.]([^./]*)$', 1)"


def filename(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def truncate_filename(name: str, most: int = 18) -> str:
    ext = f"regexp_extract({name}, '[.][^.]*$', 0)"
    return (
        f"case when length({name}) <= {most} then {name} when {most} <= 1 + length({ext}) then substring({name}, 1, {most}) "
        f"else concat(substring({name}, 1, {most} - 1 - length({ext})), '~', {ext}) end"
    )


def hex_color(r: str, g: str, b: str, a: str) -> str:
    return f"concat(format_string('#%02X%02X%02X', {r}, {g}, {b}), if({a} < 255, format_string('%02X', {a}), ''))"


def channels(n: str) -> str:
    return f"case {n} when 1 then 'Mono' when 2 then 'Stereo' when 6 then '5.1' when 8 then '7.1' else concat(cast({n} as string), ' ch') end"
