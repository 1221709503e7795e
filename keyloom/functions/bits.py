"""Bit fields, variable-length integers, fixed-width numbers and UTF-8, as column expressions.

A bit string is a string of 0 and 1, the most significant bit first. Positions count bits from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = "18446744073709551616"
#: Groups of seven bits in the longest variable-length integer.
MAX_GROUPS = 10


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def bit_string(data: Column) -> Column:
    """The bits of a binary value: hexadecimal digits, each replaced by its four bits."""
    out = F.translate(F.hex(data), "0123456789ABCDEF", "ghijklmnopqrstuv")
    for k, letter in enumerate("ghijklmnopqrstuv"):
        out = F.replace(out, F.lit(letter), F.lit(f"{k:04b}"))
    return out


def bytes_of(bits: Column) -> Column:
    """A bit string as binary, filled with zeros to whole bytes."""
    whole = align(bits)
    n = F.length(whole) / 8
    one = lambda i: F.lpad(F.conv(whole.substr(((i - 1) * 8 + 1).cast("int"), F.lit(8)), 2, 16), 2, "0")
    return F.when(F.length(whole) > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), one), ""))).otherwise(F.unhex(F.lit("")))


def align(bits: Column) -> Column:
    """A bit string filled with zeros to whole bytes."""
    return F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))


def aligned(position: Column) -> Column:
    """The next position that is a multiple of 8."""
    return position + F.pmod(-position, F.lit(8))


def is_aligned(position: Column) -> Column:
    return position % 8 == 0


def remaining(bits: Column, position: Column) -> Column:
    return F.length(bits) - position


def seek(bits: Column, position: Column) -> Column:
    """``position``, or an error beyond the end."""
    return F.when((position >= 0) & (position <= F.length(bits)), position).otherwise(F.raise_error(F.lit("position beyond the end")).cast("int"))


def read_bits(bits: Column, position: Column, n: int | Column) -> Column:
    """The unsigned number in ``n`` bits (1 to 64) at a position, as a decimal; null beyond the end."""
    size = F.lit(n) if isinstance(n, int) else n
    text = bits.substr(position.cast("int") + 1, size.cast("int"))
    return F.when((F.length(text) == size) & size.between(1, 64), F.conv(text, 2, 10).cast("decimal(20,0)"))


def read_bits_signed(bits: Column, position: Column, n: int) -> Column:
    """The number in ``n`` bits at a position, in two's complement; null beyond the end."""
    u = read_bits(bits, position, n)
    return F.when(u >= F.lit(str(1 << (n - 1))).cast("decimal(20,0)"), u - F.lit(str(1 << n)).cast("decimal(20,0)")).otherwise(u).cast("bigint")


def write_bits(x: Column, n: int) -> Column:
    """The low ``n`` bits (1 to 64) of a 64-bit integer."""
    return F.right(F.lpad(F.bin(x.cast("bigint")), 64, "0"), F.lit(n))


def read_uint(data: Column, offset: Column, size: int) -> Column:
    """The big-endian unsigned number in ``size`` bytes (1 to 8) from a byte offset, as a decimal; null beyond the end."""
    part = F.substring(data, offset.cast("int") + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("decimal(20,0)"))


def write_uint(x: Column, size: int) -> Column:
    """The low ``size`` bytes of a 64-bit integer, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("bigint")), 16, "0"), F.lit(2 * size)))


def read_bytes(data: Column, offset: Column, size: Column) -> Column:
    """``size`` bytes from an offset; null beyond the end."""
    part = F.substring(data, offset.cast("int") + 1, size.cast("int"))
    return F.when(F.octet_length(part) == size, part)


def append(*data: Column) -> Column:
    return F.concat(*data)


def copy_bits(bits: Column, position: Column, n: Column) -> Column:
    """``n`` bits from a position, as a bit string."""
    return bits.substr(position.cast("int") + 1, n.cast("int"))


def bits_needed(symbols: Column) -> Column:
    """Bits a symbol, for an alphabet of so many bytes and six control codes."""
    return F.length(F.bin((symbols + 5).cast("bigint")))


def _rest(x: Column, group: int) -> Column:
    """What is left of the 64 bits of ``x`` from a group of seven on."""
    return F.shiftrightunsigned(x.cast("bigint"), 7 * group)


def varint_bits(x: Column) -> Column:
    """The size in bits of a non-negative 64-bit integer as a variable-length one."""
    return F.when(x >= 0, 8 + sum((8 * (_rest(x, k) != 0).cast("int") for k in range(1, MAX_GROUPS - 1)), F.lit(0)))


def varint(x: Column) -> Column:
    """A 64-bit integer, taken as unsigned, in groups of seven bits, the least significant first (LEB128).

    A byte is a group, with the highest bit set if more follow; all arithmetic is on 64-bit integers.
    """

    def byte(x: Column, k: int) -> Column:
        code = _rest(x, k).bitwiseAND(F.lit(127))
        if k < MAX_GROUPS - 1:
            code = code + F.when(_rest(x, k + 1) != 0, 128).otherwise(0)
        digits = F.substring(F.hex(code + 256), 2, 2)
        return digits if k == 0 else F.when(_rest(x, k) != 0, digits).otherwise("")

    return let(x.cast("bigint"), lambda x: F.unhex(F.concat(*[byte(x, k) for k in range(MAX_GROUPS)])))


def _varint_hex(data: Column, offset: Column | None) -> Column:
    """The bytes of the variable-length integer at an offset, in hexadecimal; null if it doesn't end within ten."""
    start = F.lit(1) if offset is None else offset.cast("int") + 1
    return F.nullif(F.regexp_extract(F.hex(F.substring(data, start, F.lit(MAX_GROUPS))), r"^(?:[89A-F][0-9A-F])*[0-7][0-9A-F]", 0), F.lit(""))


def varint_length(data: Column, offset: Column | None = None) -> Column:
    """How many bytes the variable-length integer at a byte offset has; null if it doesn't end within ten."""
    return (F.length(_varint_hex(data, offset)) / 2).cast("int")


def _varint_value(data: Column, offset: Column | None) -> Column:
    """The 64 bits of the variable-length integer at a byte offset, as a signed integer; null if it is cut off or longer.

    Its bytes, filled with zeros, are two integers of eight and two bytes, from which every group is shifted to its place.
    """

    def number(code: Column) -> Column:
        high = F.conv(F.substring(code, 1, 16), 16, -10).cast("bigint")
        low = F.conv(F.substring(code, 17, 4), 16, 10).cast("bigint")
        return let(F.struct(high.alias("high"), low.alias("low")), lambda x: joined(x["high"], x["low"]))

    def joined(high: Column, low: Column) -> Column:
        groups = [F.shiftrightunsigned(high, 56 - 8 * k).bitwiseAND(F.lit(127)) for k in range(8)] + [F.shiftrightunsigned(low, 8).bitwiseAND(F.lit(127)), low.bitwiseAND(F.lit(127))]
        value = groups[0]
        for k in range(1, MAX_GROUPS):
            value = value.bitwiseOR(F.shiftleft(groups[k].cast("bigint"), 7 * k))
        return F.when(groups[-1] <= 1, value)

    return let(F.rpad(_varint_hex(data, offset), 2 * MAX_GROUPS, "0"), number)


def read_varint(data: Column, offset: Column | None = None) -> Column:
    """The unsigned variable-length integer at a byte offset, as a decimal; null if it is cut off or over 64 bits."""
    whole = F.lit(_WHOLE).cast("decimal(20,0)")
    return let(_varint_value(data, offset), lambda v: F.when(v < 0, (v.cast("decimal(20,0)") + whole).cast("decimal(20,0)")).otherwise(v.cast("decimal(20,0)")))


def zigzag(x: Column) -> Column:
    """Signed to unsigned so that small magnitudes are small: 0, -1, 1, -2 become 0, 1, 2, 3. The result's bits count as unsigned."""
    x = x.cast("bigint")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    z = z.cast("bigint")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def signed_varint(x: Column) -> Column:
    return varint(zigzag(x))


def read_signed_varint(data: Column, offset: Column | None = None) -> Column:
    """The signed variable-length integer at a byte offset; null if it is cut off or over 64 bits."""
    return let(_varint_value(data, offset), unzigzag)


def code_points(text: Column) -> Column:
    """The code points of a text."""
    return F.when(text == "", F.array().cast("array<int>")).when(text.isNotNull(), F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def utf8_length(code: Column) -> Column:
    """Bytes of a code point in UTF-8; null for a surrogate or beyond U+10FFFF."""
    good = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.when(code < 0x80, 1).when(code < 0x800, 2).when(code < 0x10000, 3).otherwise(4))


def utf8(code: Column) -> Column:
    """A code point in UTF-8; null where there is none."""
    c, n = code.cast("bigint"), utf8_length(code)
    tail = lambda shift: F.shiftright(c, shift).bitwiseAND(63) + 128
    byte = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    return F.unhex(F.when(n == 1, byte(c)).when(n == 2, F.concat(byte(F.shiftright(c, 6) + 0xC0), byte(tail(0)))).when(n == 3, F.concat(byte(F.shiftright(c, 12) + 0xE0), byte(tail(6)), byte(tail(0)))).when(n == 4, F.concat(byte(F.shiftright(c, 18) + 0xF0), byte(tail(12)), byte(tail(6)), byte(tail(0)))))


def is_utf8(data: Column) -> Column:
    """Whether a binary value is UTF-8 without overlong forms and surrogates."""
    return F.is_valid_utf8(data)


def crc32(data: Column) -> Column:
    return F.crc32(data)


def checksum(data: Column, method: str = "crc32") -> Column:
    """The checksum of a binary value in hexadecimal: crc32, sha256 or xxhash64 (of Spark's seed 42)."""
    if method == "crc32":
        return F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))
    if method == "sha256":
        return F.sha2(data, 256)
    if method == "xxhash64":
        return F.lower(F.lpad(F.hex(F.xxhash64(data)), 16, "0"))
    raise ValueError(f"unknown checksum {method}")
