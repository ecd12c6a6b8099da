"""Scalar functions: time in ticks, wrapping counters, bits, parity, text forms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of 1/240000 s; one video unit is 1001/30000 s, one audio frame 1/48000 s.
TICKS_PER_SECOND = 240_000
TICKS_PER_UNIT = 8008
TICKS_PER_SAMPLE = 5


def unit_ticks(counter: Column) -> Column:
    return counter.cast("long") * TICKS_PER_UNIT


def sample_ticks(ordinal: Column) -> Column:
    return ordinal.cast("long") * TICKS_PER_SAMPLE


def unit_milliseconds(counter: Column) -> Column:
    """Whole milliseconds at which a unit starts."""
    return F.floor(counter.cast("long") * 1001 / 30).cast("long")


def nearest_sample(ticks: Column) -> Column:
    """(2 * ticks + 5) // 10 with floor division: the sample nearest to a time."""
    v = ticks.cast("long") * 2 + 5
    return ((v - F.pmod(v, F.lit(10))) / 10).cast("long")


def signed_distance(a: Column, b: Column) -> Column:
    """a - b of 16-bit counters, from -32768 to 32767."""
    return F.pmod(a - b + 32768, F.lit(65536)) - 32768


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def energy_ratio(second: Column, best: Column) -> Column:
    """second / best; 1 if both are zero, infinity if only the best is."""
    return F.when(best == 0, F.when(second == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))).otherwise(second / best)


def odd_parity(byte: Column) -> Column:
    return F.bit_count(byte) % 2 == 1


def xor_checksum(values: Column) -> Column:
    """XOR of an array of integers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.cast("long")))


def rounded(x: Column, digits: int) -> Column:
    """x at `digits` decimals by scaling: halves of the scaled double go away from zero. F.round rounds the shortest decimal form, which differs near halves of large values."""
    scaled = x * float(10**digits)
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(F.round(scaled) / float(10**digits))


def decibels(ratio: Column) -> Column:
    return 20 * F.log10(ratio)


def minutes(unit: Column) -> Column:
    """mm:ss.cc of a unit's start."""
    hundredths = F.floor(unit.cast("long") * 1001 * 100 / 30000).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(hundredths / 6000).cast("long"), F.pmod(F.floor(hundredths / 100), F.lit(60)).cast("long"), F.pmod(hundredths, F.lit(100)).cast("long"))


def flag_names(bits: Column, names: dict[int, str]) -> Column:
    """Names of the bits that are set, in order of the bits, joined by a plus."""
    return F.array_join(F.filter(F.array(*[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for b, n in sorted(names.items())]), lambda x: x.isNotNull()), "+")


def number_list(text: Column) -> Column:
    """Numbers parted by spaces as an array; null for an empty cell."""
    return F.when(F.trim(text) == "", None).otherwise(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")))


def strict_natural(text: Column) -> Column:
    """A decimal natural number without sign or spaces, as decimal(20,0); null if it is none or exceeds 64 bits."""
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    value = F.when(text.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 20), digits.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)


def clamp_offset(start: Column, offset: Column, lines: int = 525, height: int = 240) -> Column:
    """An offset from a field's first line such that all its `height` lines lie in the raster."""
    return F.least(F.greatest(offset, -start), F.lit(lines - height) - start)


def saturating_add(count: Column, more: Column, most: int = 2**32 - 1) -> Column:
    """A counter that stays at its greatest value."""
    return F.least(count + more, F.lit(most))


def names_of(code: Column, names: dict) -> Column:
    """The name of a code; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)


def shortest(x: Column, digits: int) -> Column:
    """A double with `digits` significant digits and no trailing zeros, as %g writes it: of its exact binary value, halves to even.

    Java's formats start from the shortest decimal form and pad it with zeros, so they are wrong from the 16th digit on.
    """

    @F.arrow_udf("string")
    def written(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format(v, f".{digits}g") for v in values.to_pylist()], pa.string())

    return written(x.cast("double"))


def ten_bit(code: Column) -> Column:
    """An 8-bit code as a 10-bit word: four times itself."""
    return F.shiftleft(code.cast("int"), 2)


def actions(text: Column) -> Column:
    """`line:action` tokens parted by spaces as an array of (line, action); empty for an empty cell."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.struct(F.substring_index(t, ":", 1).try_cast("int").alias("line"), F.substring_index(t, ":", -1).alias("action")))


def quoted(text: Column) -> Column:
    """A CSV cell in quotes, quotes within doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def run_label(first: Column, last: Column) -> Column:
    """`a` or `a-b`."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def wrap_count(nbytes: Column, base: Column, density: int) -> Column:
    """How often a 16-bit counter wrapped before a byte position, from the bytes a unit takes."""
    return F.bround((nbytes / density - base) / 65536).cast("long")


def mode_word(fields: list[tuple[Column, int]]) -> Column:
    """Bit fields (value, shift) in one word."""
    word = F.lit(0).cast("long")
    for value, shift in fields:
        word = word.bitwiseOR(F.shiftleft(value.cast("long"), shift))
    return word


# --- identity strips: 12 bytes that name a frame, with a checksum ------------------------------------

#: First byte, and bytes of the strip without its checksum.
STRIP_SYNC, STRIP_BYTES = 0xD3, 11


def _byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("long")


def _bytes_xor(data: Column, n: int) -> Column:
    return xor_checksum(F.array(*[_byte(data, i) for i in range(1, n + 1)]))


def strip(ordinal: Column, counter: Column, d1: Column, d2: Column) -> Column:
    """A frame's identity as bytes: sync, two 32-bit numbers with the high byte first, two signed bytes, XOR of all."""
    wide = lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(2**32))), 8, "0")
    narrow = lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(256))), 2, "0")
    body = F.unhex(F.concat(F.lit(f"{STRIP_SYNC:02X}"), wide(ordinal), wide(counter), narrow(d1), narrow(d2)))
    return F.concat(body, F.unhex(F.lpad(F.hex(_bytes_xor(body, STRIP_BYTES)), 2, "0")))


def read_strip(data: Column) -> Column:
    """Ordinal, counter, d1 and d2 of a strip; null if its length, sync or checksum is wrong."""
    wide = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    signed = lambda at: F.pmod(_byte(data, at) + 128, F.lit(256)) - 128
    whole = (F.octet_length(data) == STRIP_BYTES + 1) & (_byte(data, 1) == STRIP_SYNC) & (_bytes_xor(data, STRIP_BYTES) == _byte(data, STRIP_BYTES + 1))
    return F.when(whole, F.struct(wide(2).alias("ordinal"), wide(6).alias("counter"), signed(10).alias("d1"), signed(11).alias("d2")))


def drawn_bits(data: Column, cell: int = 7, dark: int = 16, light: int = 240) -> Column:
    """A strip's bytes as levels of a line, `cell` pixels a bit, high bits first."""
    at = lambda x: F.floor(x / cell).cast("int")
    bit = lambda x: F.getbit(_byte(data, F.floor(at(x) / 8).cast("int") + 1), 7 - F.pmod(at(x), F.lit(8)))
    return F.transform(F.sequence(F.lit(0), F.octet_length(data) * 8 * cell - 1), lambda x: F.when(bit(x) == 1, light).otherwise(dark))
