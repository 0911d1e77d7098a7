"""Bit-string expressions: comparisons, packing and Hamming distance.

Bits travel as ``array<int>`` of 0/1 while they are being built and as
``array<bigint>`` of 64-bit words, most significant bit first, once packed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit spans of the descriptor, (name, first bit, length).
DESCRIPTOR_BITS = 742
SECTIONS = [("gridH", 0, 240), ("gridV", 240, 240), ("art", 480, 154), ("colour", 634, 108)]
STRIP_BITS = 116


def diff_bits(arr: Column) -> Column:
    """Bit i is 1 when element i+1 is greater than element i."""
    n = F.size(arr)
    return F.zip_with(
        F.slice(arr, 2, n - 1), F.slice(arr, 1, n - 1), lambda nxt, cur: (nxt > cur).cast("int"),
    )


def grid_diff_bits(arr: Column, width: int, height: int) -> Column:
    """Row-wise differences of a row-major grid, then column-wise ones."""
    across = [
        (arr[y * width + x + 1] > arr[y * width + x]).cast("int")
        for y in range(height) for x in range(width - 1)
    ]
    down = F.transform(
        F.sequence(F.lit(0), F.lit(width * (height - 1) - 1)),
        lambda i: (F.element_at(arr, i + 1 + width) > F.element_at(arr, i + 1)).cast("int"),
    )
    return F.concat(F.array(*across), down)


def median_of(arr: Column) -> Column:
    ordered = F.array_sort(arr)
    n = F.size(arr)
    low = F.element_at(ordered, ((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, (n / 2).cast("int") + 1)
    return (low + high) / 2


def median_bits(arr: Column) -> Column:
    """Bit i is 1 when element i is above the median of the array."""
    boxed = F.transform(F.array(median_of(arr)), lambda m: F.transform(arr, lambda x: (x > m).cast("int")))
    return boxed[0]


def pack_bits(bits: Column, n_bits: int) -> Column:
    """0/1 array of known length to 64-bit words, zero padded at the end."""
    words = []
    for start in range(0, n_bits, 64):
        take = min(64, n_bits - start)
        word = F.aggregate(
            F.slice(bits, start + 1, take), F.lit(0).cast("bigint"),
            lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")),
        )
        words.append(F.shiftleft(word, 64 - take) if take < 64 else word)
    return F.array(*words)


def bit_at(words: Column, i) -> Column:
    """Bit ``i`` (0-based, from the most significant end) of packed words."""
    if isinstance(i, int):
        return F.shiftright(words[i // 64], 63 - i % 64).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
    word = F.element_at(words, F.floor(i / 64).cast("int") + 1)
    return F.call_function("shiftright", word, (63 - i % 64).cast("int")).bitwiseAND(
        F.lit(1).cast("bigint")
    ).cast("int")


def unpack_bits(words: Column, n_bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: bit_at(words, i))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two word arrays of the same width."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda acc, n: acc + n,
    )


def span_masks(first: int, length: int, n_words: int) -> list[int]:
    """Signed 64-bit masks selecting bits [first, first + length)."""
    masks = []
    for w in range(n_words):
        mask = 0
        for bit in range(64):
            if first <= w * 64 + bit < first + length:
                mask |= 1 << (63 - bit)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def masked_hamming(a: Column, b: Column, first: int, length: int, n_words: int) -> Column:
    """Differing bits inside one span."""
    total = F.lit(0)
    for w, mask in enumerate(span_masks(first, length, n_words)):
        if mask:
            total = total + F.bit_count(a[w].bitwiseXOR(b[w]).bitwiseAND(F.lit(mask).cast("bigint")))
    return total


def section_distances(a: Column, b: Column, spans=SECTIONS, n_words: int = 12) -> Column:
    """``array<struct<name, d, of>>`` of the distance inside each span."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            masked_hamming(a, b, first, length, n_words).cast("bigint").alias("d"),
            F.lit(length).cast("bigint").alias("of"),
        )
        for name, first, length in spans
    ])


def words_from_binary(data: Column, n_bytes: int) -> Column:
    """Bytes to 64-bit words, the last one zero padded."""
    words = []
    for start in range(0, n_bytes, 8):
        piece = F.hex(F.substring(data, start + 1, min(8, n_bytes - start)))
        padded = F.rpad(piece, 16, "0")
        high = F.conv(F.substring(padded, 1, 8), 16, 10).cast("bigint")
        low = F.conv(F.substring(padded, 9, 8), 16, 10).cast("bigint")
        words.append(F.shiftleft(high, 32).bitwiseOR(low))
    return F.array(*words)


def words_to_binary(words: Column, n_words: int, n_bytes: int) -> Column:
    text = F.concat(*[F.lpad(F.hex(words[w]), 16, "0") for w in range(n_words)])
    return F.unhex(F.substring(text, 1, n_bytes * 2))
