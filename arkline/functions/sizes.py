"""Dictionary windows, packed header fields, recovery geometry and volume sizes as integer expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 0x20000  # the smallest dictionary
KIB, MIB = 1 << 10, 1 << 20
#: Dictionaries by method, the last for others (fixed values).
DEFAULT_DICT = {0: 0x20000, 1: 0x80000, 2: 0x100000, 3: 0x800000, 4: 0x1000000, 5: 0x4000000}
DICT_CEILING = {0: 0x20000, 1: 0x80000, 2: 0x200000, 3: 0x4000000, 4: 0x4000000, 5: 0x10000000}
AUTO = -1
MAX_WORKSPACE_DICT = 64 << 30


def whole(a: Column, b) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def ceil_div(a: Column, b) -> Column:
    return whole(a + b - 1, b)


def by_method(method: Column, table: dict[int, int], other: int) -> Column:
    return reduce(lambda c, kv: c.when(method == kv[0], F.lit(kv[1]).cast("long")), list(table.items())[1:], F.when(method == next(iter(table)), F.lit(table[next(iter(table))]).cast("long"))).otherwise(F.lit(other).cast("long"))


def power_for(size: Column, start: Column, ceiling: Column) -> Column:
    """start doubled until it covers size or reaches ceiling."""
    steps = F.sequence(F.lit(0), F.lit(24))
    doubled = F.transform(steps, lambda k: start * F.pow(F.lit(2), k).cast("long"))
    enough = F.filter(doubled, lambda w: (w >= size) | (w >= ceiling))
    return F.element_at(enough, 1)


def grid_window(window: Column) -> Column:
    """The largest size the header can express that is no larger: a power of two plus 32nds of it."""
    bits = F.least(F.length(F.bin(window)) - 1 - 17, F.lit(23))
    power = F.lit(FLOOR).cast("long") * F.pow(F.lit(2), bits).cast("long")
    parts = F.least(whole((window - power) * 32, power), F.lit(31))
    return F.when(window < FLOOR, window).otherwise(power + whole(power, 32) * parts)


def auto_dict(method: Column, size: Column) -> Column:
    """The window chosen for an input of a known size."""
    default, ceiling = by_method(method, DEFAULT_DICT, 0x800000), by_method(method, DICT_CEILING, 0x4000000)
    small = power_for(size, F.lit(FLOOR).cast("long"), default)
    large = power_for(size, default, ceiling)
    return F.when(size == 0, default).when(size < default, grid_window(small)).otherwise(grid_window(large))


def resolved_dict(requested: Column, method: Column, size: Column) -> Column:
    """AUTO by size, 1..15 as 128 KiB doubled, 0 the method's own shrunk to the input, else bytes."""
    default = by_method(method, DEFAULT_DICT, 0x800000)
    shrunk = F.when(size > 0, power_for(size, F.lit(FLOOR).cast("long"), default)).otherwise(default)
    scaled = F.lit(FLOOR).cast("long") * F.pow(F.lit(2), requested - 1).cast("long")
    return F.when(requested == AUTO, auto_dict(method, size)).when(requested.between(1, 15), scaled).when(requested == 0, shrunk).otherwise(requested)


def lz_window(declared: Column, size: Column) -> Column:
    covered = F.least(power_for(size, F.lit(FLOOR).cast("long"), declared), declared)
    return F.when((declared <= FLOOR) | (size == 0), declared).otherwise(covered)


def workspace_bytes(compressed: Column, window: Column, raw_size: Column) -> Column:
    """Memory to prepare an entry: five windows and 6 MiB, or a stored payload up to 16 MiB; 1 at least."""
    packed = F.least(window, F.lit(MAX_WORKSPACE_DICT)) * 5 + 6 * MIB
    return F.greatest(F.when(compressed, packed).otherwise(F.least(raw_size, F.lit(16 * MIB))), F.lit(1))


def compression_fields(info: Column) -> dict[str, Column]:
    """The packed compression field: version, solid, method, dictionary bits and fraction."""
    info = info.cast("long")
    field = lambda shift, mask: F.shiftright(info, shift).bitwiseAND(mask)
    bits, fraction = field(10, 31), field(15, 31)
    base = F.lit(FLOOR).cast("long") * F.pow(F.lit(2), F.least(bits, F.lit(23))).cast("long")
    version = field(0, 63)
    window = base + F.when(version > 0, whole(base, 32) * fraction).otherwise(0)
    return {"unp_ver": version.cast("int"), "is_solid": field(6, 1) == 1, "method": field(7, 7).cast("int"), "win_size": window}


def recovery_geometry(size: Column, percent: Column) -> dict[str, Column]:
    """Shards of an archive's recovery record: data and parity counts, group bytes, header scale."""
    large = 200 * KIB
    d = F.when(size >= large, F.lit(200).cast("long")).otherwise(F.least(F.greatest(ceil_div(size, KIB), F.lit(1)), F.lit(200)))
    wanted = F.least(whole(F.least(percent, F.lit(1000)) * d, 100), 10 * d)
    nr = F.when((wanted == 0) & (size < large), F.lit(1).cast("long")).otherwise(wanted)
    group = ceil_div(size, d)
    group = group + group % 2
    scale = F.greatest(whole(group + 0xFFFF, 0x10000), F.lit(1))
    header = (d * 8 + 0x48) * scale
    return {"d": d, "nr": nr, "group_count": group, "scale": scale, "header_size": header, "shard_size": header + group}


def sector_parameters(size: Column, percent: Column, sector: int = 512) -> dict[str, Column]:
    """Sectors of generic parity: the smallest doubling of the sector with at most 65530 in all; 0 where none."""
    def counts(s):
        data = F.greatest(ceil_div(size, s), F.lit(1))
        return data, F.greatest(ceil_div(data * percent, 100), F.lit(1))

    sizes = F.array(*[F.lit(sector << k).cast("long") for k in range(12) if sector << k <= MIB])
    fits = F.filter(sizes, lambda s: counts(s)[0] + counts(s)[1] <= 65530)
    chosen = F.try_element_at(fits, F.lit(1))
    data, parity = counts(F.coalesce(chosen, F.lit(MIB).cast("long")))
    none = chosen.isNull()
    return {"sector_size": F.coalesce(chosen, F.lit(MIB).cast("long")), "data_sectors": F.when(none, 0).otherwise(data), "recovery_sectors": F.when(none, 0).otherwise(parity)}


def volume_size(text: str) -> int | None:
    """Bytes of a volume size such as 1.5g; AUTO if empty, 0 for "-", None if it is none."""
    if text in ("", "-"):
        return AUTO if not text else 0
    m = re.match(r"([0-9]*\.?[0-9]*)(.?)", text, re.S)
    unit = {"": 0, "b": 0, "k": 1, "m": 2, "g": 3, "t": 4}.get(m[2].lower())
    if unit is None or not re.search("[0-9]", m[1]):
        return None
    value = max(float(m[1]) * 1024**unit, 1)
    return int(value) if value <= float(2**64 - 1) else None
