"""Bit strings as ``ARRAY<BIGINT>`` columns: words most significant bit first, the last one left-aligned.

The number of bits is a parameter where padding matters; padding bits are always 0. All functions are built-in
expressions, so they run in generated code and register in SQL without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_words(size: int) -> int:
    return -(-size // WORD)


def words_of(words, n: int) -> list[Column]:
    """The first ``n`` words as columns, a missing word as 0."""
    return [F.coalesce(F.get(_col(words), F.lit(i)), F.lit(0).cast("bigint")) for i in range(n)]


def wide(words, n: int, prefix: str = "w") -> list[Column]:
    """Flat columns ``w0 .. w{n-1}``, by which filters avoid array access."""
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(words_of(words, n))]


def count(words) -> Column:
    """Set bits (H7)."""
    return F.aggregate(_col(words), F.lit(0), lambda n, w: n + F.bit_count(w))


def distance(a, b) -> Column:
    """Hamming distance (H5). Words that only the longer operand has count all their set bits."""
    x = F.zip_with(_col(a), _col(b), lambda p, q: F.coalesce(p, F.lit(0).cast("bigint")).bitwiseXOR(F.coalesce(q, F.lit(0).cast("bigint"))))
    return count(x)


def distance_wide(a: list, b: list) -> Column:
    """Hamming distance over flat word columns: one sum of ``bit_count`` terms."""
    total = F.bit_count(_col(a[0]).bitwiseXOR(_col(b[0])))
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + F.bit_count(_col(x).bitwiseXOR(_col(y)))
    return total


def near(a, b, most: int) -> Column:
    """Whether the distance is at most ``most`` (H6)."""
    return distance(a, b) <= most


def _shift(pos) -> Column:
    return F.lit(WORD - 1) - F.pmod(pos, F.lit(WORD))


def get_bit(words, pos, size: int) -> Column:
    """Bit ``pos`` as 0 or 1; null outside ``0 .. size-1`` (H8)."""
    p = _col(pos) if isinstance(pos, (str, Column)) else F.lit(pos)
    word = F.get(_col(words), F.floor(p / WORD).cast("int"))
    value = F.call_function("shiftrightunsigned", word, _shift(p).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return F.when((p >= 0) & (p < size), value.cast("int"))


def set_bit(words, pos: int, value: int, size: int) -> Column:
    """The words with bit ``pos`` set to ``value``; null if ``pos`` is out of bounds (H8)."""
    if not 0 <= pos < size:
        return F.lit(None).cast("array<bigint>")
    at, mask = pos // WORD, 1 << (WORD - 1 - pos % WORD)
    mask -= 1 << 64 if mask >> 63 else 0
    one = F.lit(mask).cast("bigint")
    return F.transform(_col(words), lambda w, i: F.when(i == at, w.bitwiseOR(one) if value else w.bitwiseAND(F.bitwise_not(one))).otherwise(w))


def indices(words, size: int, value: int = 1) -> Column:
    """Positions of the set or unset bits in ascending order, padding aside."""
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: get_bit(words, p, size) == value)


def next_free(words, pos: int, size: int) -> Column:
    """The next unset position from ``pos`` on, going round; ``size`` if all are set (H9)."""
    free = indices(words, size, 0)
    after = F.filter(free, lambda p: p >= pos)
    return F.coalesce(F.get(after, F.lit(0)), F.get(free, F.lit(0)), F.lit(size))


def _mask(size: int) -> list[int]:
    full = [-1] * (size // WORD)
    rest = size % WORD
    return full + ([(((1 << rest) - 1) << (WORD - rest)) - (1 << 64)] if rest else [])


def _both(a, b, f) -> Column:
    x, y = _col(a), _col(b)
    return F.when(F.size(x) == F.size(y), F.zip_with(x, y, f))


def bit_and(a, b) -> Column:
    """Null if the numbers of words differ."""
    return _both(a, b, lambda p, q: p.bitwiseAND(q))


def bit_or(a, b) -> Column:
    return _both(a, b, lambda p, q: p.bitwiseOR(q))


def bit_xor(a, b) -> Column:
    return _both(a, b, lambda p, q: p.bitwiseXOR(q))


def bit_not(a, size: int) -> Column:
    """All bits but the padding inverted."""
    mask = F.array(*[F.lit(m).cast("bigint") for m in _mask(size)])
    return _both(a, mask, lambda w, m: F.bitwise_not(w).bitwiseAND(m))


def constant(size: int, value: int) -> Column:
    """All bits 0 or all 1."""
    return F.array(*[F.lit(m if value else 0).cast("bigint") for m in _mask(size)])


def to_text(words, size: int) -> Column:
    """Bits as 0 and 1 with ``|`` after every 64."""
    padded = F.transform(_col(words), lambda w: F.lpad(F.bin(w), WORD, "0"))
    rest = size % WORD
    if not rest:
        return F.array_join(padded, "|")
    n = n_words(size)
    return F.array_join(F.transform(padded, lambda t, i: F.when(i == n - 1, F.substring(t, 1, rest)).otherwise(t)), "|")


def to_hex(words) -> Column:
    """Words as one hex string: byte order, unlike that of signed numbers, is the order of bit strings."""
    return F.array_join(F.transform(_col(words), lambda w: F.lpad(F.hex(w), 16, "0")), "")


def from_hex(text, n: int) -> Column:
    """The words of a hex string of ``16 * n`` digits; null for another length."""
    t = _col(text)
    parts = [F.conv(F.substring(t, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(n)]
    return F.when(F.length(t) == 16 * n, F.array(*parts))


def less(a, b) -> Column:
    """Order by number of words, then by bytes."""
    x, y = _col(a), _col(b)
    return (F.size(x) < F.size(y)) | ((F.size(x) == F.size(y)) & (to_hex(x) < to_hex(y)))


def random_words(size: int, seed, salt: str = "weftline") -> Column:
    """Deterministic pseudo-random bits of a seed column, padding cleared."""
    return F.array(*[F.xxhash64(F.lit(salt), _col(seed), F.lit(i)).bitwiseAND(F.lit(m).cast("bigint")) for i, m in enumerate(_mask(size))])
