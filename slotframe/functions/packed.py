"""Packed sizes, varints, integers and page identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A page id is device (8 bits), generation (24 bits), address (32 bits).
GENERATION_SHIFT, DEVICE_SHIFT = 32, 56
GENERATION_MASK, ADDRESS_MASK = (1 << 24) - 1, (1 << 32) - 1
MAX_GENERATION = GENERATION_MASK


def varint_size(n: Column) -> Column:
    """Bytes of the varint of an unsigned 64-bit value, given as the long of equal bits."""
    out = F.when(n < 0, 10)
    for size in range(1, 9):
        out = out.when(n < (1 << (7 * size)), size)
    return out.otherwise(9)


def slot_packed_size(payload_bytes: Column) -> Column:
    """A slot: varint head, one tag byte, payload."""
    body = payload_bytes + 1
    return varint_size(body) + body


def str_packed_size(text: Column) -> Column:
    """8 bytes, and the data outside them where it is longer than 4."""
    n = F.octet_length(text)
    return F.when(n <= 4, 8).otherwise(8 + n).cast("long")


def array_packed_size(n: Column, item_bytes: int) -> Column:
    return 8 + n * item_bytes


def varint_hex(n: Column) -> Column:
    """The varint as lower-case hex: 7 bits a byte, lowest first, high bit on all but the last."""
    last = varint_size(n) - 1
    one = lambda i: F.lpad(F.hex((F.call_function("shiftrightunsigned", n, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)).cast("long")), 2, "0")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), last), one), ""))


def _hex_bytes(text: Column) -> Column:
    size = F.floor(F.length(text) / 2).cast("int")
    spots = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.conv(F.call_function("substring", text, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def varint_decode(text: Column) -> Column:
    """Struct (n, consumed) of a varint in hex; nulls if it is cut short. Longer forms than needed are accepted."""
    data = _hex_bytes(text)
    ends = F.array_position(F.transform(data, lambda b: b < 128), F.lit(True)).cast("int")
    used = F.slice(data, 1, ends)
    value = F.aggregate(F.reverse(used), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 7).bitwiseOR(b.bitwiseAND(F.lit(127))))
    return F.when(ends > 0, F.struct(value.alias("n"), ends.alias("consumed")))


def int_hex(n: Column, size: int, little: bool = True) -> Column:
    """The low ``size`` bytes of a long as lower-case hex."""
    big = F.lower(F.substring(F.lpad(F.hex(n), 16, "0"), 17 - 2 * size, 2 * size))
    if not little:
        return big
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))))


def page_id(device: Column, generation: Column, address: Column) -> Column:
    bits = F.shiftleft(device.cast("long"), DEVICE_SHIFT).bitwiseOR(F.shiftleft(generation.cast("long").bitwiseAND(F.lit(GENERATION_MASK)), GENERATION_SHIFT))
    return bits.bitwiseOR(address.cast("long").bitwiseAND(F.lit(ADDRESS_MASK)))


def device_of(page: Column) -> Column:
    return F.shiftrightunsigned(page, DEVICE_SHIFT)


def generation_of(page: Column) -> Column:
    return F.shiftrightunsigned(page, GENERATION_SHIFT).bitwiseAND(F.lit(GENERATION_MASK))


def address_of(page: Column) -> Column:
    return page.bitwiseAND(F.lit(ADDRESS_MASK))


def advance_generation(page: Column) -> Column:
    """The same physical page, one generation on; the last generation is followed by 0."""
    return page_id(device_of(page), generation_of(page) + 1, address_of(page))


def same_physical_page(a: Column, b: Column) -> Column:
    return (device_of(a) == device_of(b)) & (address_of(a) == address_of(b))


def is_valid_page_id(page: Column) -> Column:
    """All ones is no page."""
    return page != -1


def generation_less_than(first: Column, second: Column) -> Column:
    """Circular: the difference, as an unsigned 64-bit value, is neither 0 nor half of all generations or more."""
    delta = second.cast("long") - first.cast("long")
    return (delta > 0) & (delta < MAX_GENERATION // 2)


def paired_page(page: Column, device: Column) -> Column:
    """The page of equal generation and address on another device."""
    return page_id(device, generation_of(page), address_of(page))


def page_shard(page: Column, shard_device: Column, page_log2: Column, shard_log2: Column, offset: Column) -> Column:
    """The page id of an aligned part of a page on a device of smaller pages; null where there is no such device."""
    ratio = (page_log2 - shard_log2).cast("int")
    part = F.call_function("shiftright", offset.cast("long"), shard_log2.cast("int"))
    address = F.call_function("shiftleft", address_of(page), ratio).bitwiseOR(part)
    return F.when(shard_device.isNotNull() & (ratio > 0), page_id(shard_device, generation_of(page), address))


def log2_ceil(n: Column) -> Column:
    """Least k with 2^k >= n, for n >= 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")
