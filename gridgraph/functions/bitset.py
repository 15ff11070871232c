"""Bitsets as arrays of 64-bit words: bit i is bit ``i % 64`` of word ``i div 64``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG = "bigint"


def _long(x: int | Column) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast(_LONG)


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _words(words: Column | str) -> Column:
    return F.col(words) if isinstance(words, str) else words


def empty(capacity: int) -> Column:
    """No bit set; capacity in bits, rounded up to whole words."""
    return F.array_repeat(_long(0), max(0, math.ceil(capacity / 64)))


def _one(i: Column) -> Column:
    return _shift("shiftleft", _long(1), F.pmod(i, F.lit(64)))


def _at(words: Column, i: Column, change) -> Column:
    word = F.call_function("div", _long(i), _long(64))
    return F.transform(words, lambda w, k: F.when(k == word, change(w)).otherwise(w))


def set_bit(words: Column | str, i: int | Column) -> Column:
    i = _long(i)
    return _at(_words(words), i, lambda w: w.bitwiseOR(_one(i)))


def unset_bit(words: Column | str, i: int | Column) -> Column:
    i = _long(i)
    return _at(_words(words), i, lambda w: w.bitwiseAND(F.bitwise_not(_one(i))))


def get_bit(words: Column | str, i: int | Column) -> Column:
    """Whether bit i is set; false beyond the capacity."""
    i = _long(i)
    word = F.get(_words(words), F.call_function("div", i, _long(64)).cast("int"))
    return F.coalesce(_shift("shiftright", word, F.pmod(i, F.lit(64))).bitwiseAND(_long(1)) == 1, F.lit(False))


def _zip(a: Column | str, b: Column | str, f) -> Column:
    return F.zip_with(_words(a), _words(b), lambda x, y: f(F.coalesce(x, _long(0)), F.coalesce(y, _long(0))))


def bits_and(a: Column | str, b: Column | str) -> Column:
    """The shorter operand counts as extended with zeros, here and below."""
    return _zip(a, b, lambda x, y: x.bitwiseAND(y))


def bits_or(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseOR(y))


def bits_xor(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseXOR(y))


def bits_and_not(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def _mask(low: Column, high: Column) -> Column:
    """Bits low to high of a word, both included, for 0 <= low <= high <= 63."""
    return _shift("shiftrightunsigned", _long(-1), F.lit(63) - high).bitwiseAND(_shift("shiftleft", _long(-1), low))


def _ranged(words: Column, start: Column, end: Column, inside, outside) -> Column:
    """Each word by what it has within bits start to end: inside(word, mask) or outside(word)."""

    def one(w: Column, k: Column) -> Column:
        low, high = F.greatest(start - k * 64, _long(0)), F.least(end - k * 64, _long(63))
        return F.when(low <= high, inside(w, _mask(low, high))).otherwise(outside(w))

    return F.transform(words, one)


def set_until(words: Column | str, n: int | Column) -> Column:
    """Bits 0 to n - 1 set."""
    return _ranged(_words(words), _long(0), _long(n) - 1, lambda w, m: w.bitwiseOR(m), lambda w: w)


def clear_until(words: Column | str, n: int | Column) -> Column:
    """Bits 0 to n - 1 cleared."""
    return _ranged(_words(words), _long(0), _long(n) - 1, lambda w, m: w.bitwiseAND(F.bitwise_not(m)), lambda w: w)


def clear(words: Column | str) -> Column:
    return F.transform(_words(words), lambda w: _long(0))


def count(words: Column | str, start: int | Column, end: int | Column) -> Column:
    """Set bits from start to end, both included; 0 if start > end. Only the words of the
    range are looked at, and only the first and last of them are masked."""
    w = _words(words)
    start, end = F.greatest(_long(start), _long(0)), F.least(_long(end), F.size(w).cast(_LONG) * 64 - 1)
    a, b = (F.call_function("div", x, _long(64)).cast("int") for x in (start, end))
    first, last = F.pmod(start, F.lit(64)), F.pmod(end, F.lit(64))
    one = F.bit_count(F.get(w, a).bitwiseAND(_mask(first, last)))
    ends = F.bit_count(F.get(w, a).bitwiseAND(_mask(first, _long(63)))) + F.bit_count(F.get(w, b).bitwiseAND(_mask(_long(0), last)))
    inner = F.aggregate(F.slice(w, a + 2, F.greatest(b - a - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.bit_count(x))
    return F.when(start > end, 0).when(a == b, one).otherwise(ends + inner)


def cardinality(words: Column | str) -> Column:
    return F.aggregate(_words(words), F.lit(0), lambda n, x: n + F.bit_count(x))


def positions(words: Column | str) -> Column:
    """Positions of set bits, ascending."""
    per_word = F.transform(
        _words(words),
        lambda w, k: F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: _shift("shiftright", w, b).bitwiseAND(_long(1)) == 1), lambda b: (k * 64 + b).cast(_LONG)
        ),
    )
    return F.flatten(per_word)


def next_set_bit(words: Column | str, n: int | Column) -> Column:
    """The first set bit at or after n, -1 if there is none."""
    w, n = _words(words), F.greatest(_long(n), _long(0))
    at = F.call_function("div", n, _long(64)).cast("int")
    here = F.coalesce(F.get(w, at).bitwiseAND(_mask(F.pmod(n, F.lit(64)), _long(63))), _long(0))
    # How many words without bits stand behind the first: the place of the first with some.
    later = F.slice(w, F.least(at + 2, F.size(w) + 1), F.greatest(F.size(w) - at - 1, F.lit(0)))
    empty_words = F.array_position(F.transform(later, lambda x: x != 0), True).cast("int")
    then = F.when(empty_words > 0, (at + empty_words).cast(_LONG) * 64 + _trailing_zeros(F.get(w, at + empty_words))).otherwise(_long(-1))
    return F.when(here != 0, at.cast(_LONG) * 64 + _trailing_zeros(here)).otherwise(then)


def _trailing_zeros(x: Column) -> Column:
    """Zeros below the lowest set bit of a word that is not 0. The lowest 63 bits can be
    negated without overflow; if none of them is set, the bit is the last."""
    low = x.bitwiseAND(_long(2**63 - 1))
    return F.when(low == 0, 63).otherwise(F.bit_count(F.bitwise_not(low.bitwiseOR(-low))))


def capacity(words: Column | str) -> Column:
    return F.size(_words(words)) * 64


def grow(words: Column | str, n: int) -> Column:
    """With room for n bits at least."""
    w = _words(words)
    return F.concat(w, F.array_repeat(_long(0), F.greatest(F.lit(math.ceil(n / 64)) - F.size(w), F.lit(0))))


def reverse(words: Column | str) -> Column:
    """Mirrored over the capacity: bit i stands where bit capacity - 1 - i stood."""

    def turned(w: Column) -> Column:
        # Steps of a binary reversal: neighbouring 1, 2, 4, 8, 16 and 32 bits change places.
        for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
            m = _long(mask)
            w = _shift("shiftrightunsigned", w, F.lit(width)).bitwiseAND(m).bitwiseOR(_shift("shiftleft", w.bitwiseAND(m), F.lit(width)))
        return w

    return F.reverse(F.transform(_words(words), turned))


def log(base: float, x: Column) -> Column:
    """Logarithm of x to a base."""
    return F.log10(x) / F.lit(math.log10(base))
