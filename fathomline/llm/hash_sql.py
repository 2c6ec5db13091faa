"""SQL for hashes that DuckDB has no function for, in unsigned 128-bit numbers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

#: The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_WHOLE = 1 << 64
_names = count()


def number(n: int) -> str:
    return f"{n % _WHOLE}::UHUGEINT"


def mod(expression: str) -> str:
    return f"(({expression}) % {_WHOLE}::UHUGEINT)"


def _let(value: str, body: Callable[[str], str]) -> str:
    """body of a name for the value, which is computed once."""
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _rotate(x: str, bits: int) -> str:
    return _let(x, lambda v: f"({mod(f'{v} * {number(1 << bits)}')} + {v} // {number(1 << (64 - bits))})")


def _shift(x: str, bits: int) -> str:
    return _let(x, lambda v: f"xor({v}, {v} // {number(1 << bits)})")


def _round(state: str, word: str) -> str:
    turned = _rotate(mod(f"{state} + {word} * {number(P2)}"), 31)
    return mod(f"{turned} * {number(P1)}")


def _word(first: str, size: int) -> str:
    """The little-endian number of `size` bytes from hex digit `first` on, counted from 0."""
    digits = " || ".join(f"substr(bytes, {first} + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"('0x' || {digits})::UBIGINT::UHUGEINT"


def xxh64(source: str, column: str, seed: int) -> list[str]:
    """Common table expressions, the last of them hashed(column, h): the XXH64 of each distinct text of the source's column in UTF-8."""
    lane = lambda k, start: f"list_reduce(list_filter(words, lambda x, j: j <= stripes * 4 AND (j - 1) % 4 = {k}), lambda a, w: {_round('a', 'w')}, {number(start)})"
    lanes = ", ".join(f"{lane(k, start)} AS lane{k}" for k, start in enumerate((seed + P1 + P2, seed + P2, seed, seed - P1)))
    merged = mod(" + ".join(_rotate(f"lane{k}", bits) for k, bits in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = mod(f"xor({merged}, {_round(number(0), f'lane{k}')}) * {number(P1)} + {number(P4)}")
    begun = mod(f"CASE WHEN n >= 32 THEN {merged} ELSE {number(seed + P5)} END + n::UHUGEINT")
    with_word = _rotate(f"xor(a, {_round(number(0), 'w')})", 27)
    half = mod(f"{_word('n // 8 * 16', 4)} * {number(P1)}")
    with_half = _rotate(f"xor(h, {half})", 23)
    with_byte = _rotate(f"xor(a, {mod(f'w * {number(P5)}')})", 11)
    once = mod(f"{_shift('h', 33)} * {number(P2)}")
    twice = mod(f"{_shift(once, 29)} * {number(P3)}")
    return [
        f"hash0 AS (SELECT {column}, hex(encode({column})) AS bytes, octet_length(encode({column})) AS n FROM (SELECT DISTINCT {column} FROM {source}))",
        f"hash1 AS (SELECT *, n // 32 AS stripes, list_transform(range(n // 8), lambda j: {_word('16 * j', 8)}) AS words FROM hash0)",
        f"hash2 AS (SELECT *, {lanes} FROM hash1)",
        f"hash3 AS (SELECT *, {begun} AS h FROM hash2)",
        f"hash4 AS (SELECT * REPLACE (list_reduce(list_filter(words, lambda x, j: j > stripes * 4), lambda a, w: {mod(f'{with_word} * {number(P1)} + {number(P4)}')}, h) AS h) FROM hash3)",
        f"hash5 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {mod(f'{with_half} * {number(P2)} + {number(P3)}')} ELSE h END AS h) FROM hash4)",
        f"hash6 AS (SELECT * REPLACE (list_reduce(list_transform(range(n // 4 * 4, n), lambda j: {_word('2 * j', 1)}), lambda a, w: {mod(f'{with_byte} * {number(P1)}')}, h) AS h) FROM hash5)",
        f"hashed AS MATERIALIZED (SELECT {column}, {_shift(twice, 32)}::UBIGINT AS h FROM hash6)",
    ]
