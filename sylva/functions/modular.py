"""Polynomials of trees of any size: many trees at once on numpy arrays modulo primes, put together by remainders.

The polynomial of a tree is evaluated at the roots of unity of a power of two modulo each of some primes below 2^31, colour
by colour and vertex by vertex as in ``packed_polynomial``; an inverse transform gives the coefficients modulo the primes, and
Garner's algorithm the coefficients themselves as arrays of digits. No step handles a tree's or a coefficient's big integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sylva.functions.trees import slot_bits

#: Transforms have 2^ROOTS points at most; numbers of a state array that are held at once.
ROOTS, HELD = 18, 4_000_000


@cache
def primes(count: int) -> tuple[int, ...]:
    """The largest primes below 2^31 that are 1 modulo 2^ROOTS."""
    small = np.arange(3, 46341, 2)
    out, c = [], (1 << 31 - ROOTS) - 1
    while len(out) < count and c:
        p = (c << ROOTS) + 1
        if (p % small).all():
            out.append(p)
        c -= 1
    if len(out) < count:
        raise ValueError(f"coefficients need {count} primes, there are {len(out)}")
    return tuple(out)


@cache
def root(p: int, points: int) -> int:
    """An element of order ``points`` (a power of two) modulo p."""
    return next(w for w in (pow(x, (p - 1) // points, p) for x in range(2, p)) if points == 1 or pow(w, points // 2, p) == p - 1)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo p, doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, p)) % np.uint64(p)
        have += step
    return out


def _inverse_transform(values: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p of polynomials from their values at all powers of ``root``, one a row."""
    t, n = values.shape
    q = np.uint64(p)
    bits = n.bit_length() - 1
    turned = np.zeros(n, np.int64)
    for k in range(bits):
        turned |= (np.arange(n) >> k & 1) << (bits - 1 - k)
    a = values[:, turned].copy()
    back = _powers(pow(root(p, n), -1, p), max(n // 2, 1), p)
    half = 1
    while half < n:
        a = a.reshape(t, n // (2 * half), 2, half)
        low, high = a[:, :, 0], a[:, :, 1] * back[:: n // (2 * half)][:half] % q
        a = np.stack([(low + high) % q, (low + q - high) % q], 2).reshape(t, n)
        half *= 2
    return a * np.uint64(pow(n, -1, p)) % q


def _values(parent: np.ndarray, colours: int, points: np.ndarray, p: int) -> np.ndarray:
    """The polynomials of trees (rows of ``parent``, all of one size) at some points modulo p."""
    t, n = parent.shape
    q, rows = np.uint64(p), np.arange(t)
    leaf = np.empty((colours, len(points)), np.uint64)
    leaf[0] = 1
    for c in range(1, colours):
        leaf[c] = leaf[c - 1] * points % q
    state = np.broadcast_to(leaf, (t, n, *leaf.shape)).copy()
    for v in range(n - 1, 0, -1):
        own = state[:, v]
        toll = (own.sum(1) % q)[:, None] + q - own
        up = parent[:, v]
        state[rows, up] = state[rows, up] * toll % q
    return state[:, 0].sum(1) % q


def residues(parent: np.ndarray, colours: int, p: int) -> np.ndarray:
    """Coefficients modulo p of the trees' polynomials, low degree first: n (k - 1) + 1 of them a row."""
    t, n = parent.shape
    top = n * (colours - 1)
    points = 1 << top.bit_length()
    if points > 1 << ROOTS:
        raise ValueError(f"{n} vertices in {colours} colours have more than {1 << ROOTS} coefficients")
    w = root(p, points)
    at = _powers(w, points // 2 + 1, p)
    values = np.empty((t, points), np.uint64)
    some = max(1, HELD // (t * n * colours))
    for low in range(0, len(at), some):
        part = at[low : low + some]
        values[:, low : low + len(part)] = _values(parent, colours, part, p)
    # coefficients are a palindrome: the value at 1/x is the value at x over x^top
    j = np.arange(points // 2 + 1, points)
    turn = _powers(pow(w, top, p), points, p)[j]
    values[:, j] = values[:, points - j] * turn % np.uint64(p)
    return _inverse_transform(values, p)[:, : top + 1]


def mixed_digits(rest: list[np.ndarray], moduli: tuple[int, ...]) -> list[np.ndarray]:
    """Garner: digits d of x = d0 + d1 p0 + d2 p0 p1 + .. from x modulo each p."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):
        q, x, weight = np.uint64(p), np.zeros_like(rest[0]), 1
        for d, m in zip(digits, moduli, strict=False):
            x = (x + d % q * np.uint64(weight)) % q
            weight = weight * m % p
        digits.append((rest[i] + q - x) % q * np.uint64(pow(weight, -1, p)) % q)
    return digits


def limbs(digits: list[np.ndarray], moduli: tuple[int, ...], base: int, count: int) -> np.ndarray:
    """The numbers in ``count`` limbs of ``base`` (2^32 at most), the lowest first, along a new last axis."""
    out = np.zeros((*digits[0].shape, count), np.uint64)
    b = np.uint64(base)
    for d, p in zip(digits[::-1], moduli[::-1], strict=True):
        carry = d.copy()
        for k in range(count):
            x = out[..., k] * np.uint64(p) + carry
            out[..., k], carry = x % b, x // b
    return out


def _texts(numbers: np.ndarray, size: np.ndarray) -> list[str]:
    """Comma-joined decimals of the first ``size`` numbers of each row; numbers are limbs of 10^9."""
    t, m, count = numbers.shape
    tens = 10 ** np.arange(8, -1, -1, dtype=np.uint64)
    keep = np.arange(m) < size[:, None]
    digits = (numbers[keep][:, ::-1, None] // tens % np.uint64(10)).astype(np.uint8).reshape(-1, 9 * count)
    shown = np.maximum.accumulate(digits > 0, 1)
    shown[:, -1] = True
    text = np.concatenate([digits + np.uint8(48), np.full((len(digits), 1), 44, np.uint8)], 1)
    shown = np.concatenate([shown, np.ones((len(digits), 1), bool)], 1)
    ends = np.cumsum(shown.sum(1))[np.cumsum(size) - 1]
    body, begin, out = text[shown].tobytes(), 0, []
    for e in ends.tolist():
        out.append(body[begin : e - 1].decode())
        begin = e
    return out


def _digests(numbers: np.ndarray, size: np.ndarray, width: int) -> list[bytes]:
    """BLAKE2b of 256 bits over the bytes of the packed integers; numbers are limbs of 2^32."""
    out = []
    for row, n in zip(numbers, size.tolist(), strict=True):
        bits = np.unpackbits(row[:n].astype("<u4").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        if bits.shape[1] < width:
            bits = np.pad(bits, ((0, 0), (0, width - bits.shape[1])))
        data = np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes().rstrip(b"\0")
        out.append(hashlib.blake2b(data or b"\0", digest_size=32).digest())
    return out


def _batches(parents: list[list[int]], colours: int | None) -> Iterator[tuple[list[int], list[np.ndarray], tuple[int, ...], int, np.ndarray, np.ndarray]]:
    """Of some trees of one size at a time: their places, mixed digits, moduli, slot width, coefficients in limbs of 2^32, lengths."""
    sizes: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        sizes.setdefault(len(p), []).append(i)
    for n, members in sizes.items():
        k = colours or n
        width = slot_bits(n, k)
        moduli = primes(-(-width // 30))
        step = max(1, HELD // (16 * n * k))
        for low in range(0, len(members), step):
            some = members[low : low + step]
            parent = np.array([parents[i] for i in some], np.int64).reshape(len(some), n)
            digits = mixed_digits([residues(parent, k, p) for p in moduli], moduli)
            binary = limbs(digits, moduli, 1 << 32, -(-width // 32))
            there = (binary > 0).any(2)
            yield some, digits, moduli, width, binary, np.where(there.any(1), there.shape[1] - there[:, ::-1].argmax(1), 1)


def polynomial_texts(parents: list[list[int]], colours: int | None = None) -> list[tuple[str, bytes]]:
    """Comma-joined coefficients, low degree first, and digest of each tree's polynomial; ``colours`` defaults to the vertices."""
    out: list[tuple[str, bytes]] = [("", b"")] * len(parents)
    for some, digits, moduli, width, binary, size in _batches(parents, colours):
        decimal = limbs(digits, moduli, 10**9, -(-int(width * 0.30103 + 2) // 9))
        for i, text, digest in zip(some, _texts(decimal, size), _digests(binary, size, width), strict=True):
            out[i] = text, digest
    return out


def polynomial_decimals(parents: list[list[int]], colours: int | None = None) -> tuple[pa.Array, pa.Array]:
    """Coefficients as lists of DECIMAL(38, 0) and digests, as Arrow arrays; an OverflowError where 38 digits don't hold one."""
    parts: list[np.ndarray] = [np.zeros((0, 2), np.uint64)] * len(parents)
    digests = [b""] * len(parents)
    for some, digits, moduli, width, binary, size in _batches(parents, colours):
        if width > 126:  # 10^38 lies between 2^126 and 2^127
            high = limbs(digits, moduli, 10**9, -(-int(width * 0.30103 + 2) // 9))
            if (high[..., 4] >= 100).any() or high[..., 5:].any():
                raise OverflowError("a coefficient has more than 38 digits; wide_polynomials has no such bound")
        four = np.zeros((*binary.shape[:2], 4), np.uint64)
        four[..., : min(4, binary.shape[2])] = binary[..., :4]
        two = four[..., ::2] | four[..., 1::2] << np.uint64(32)
        for i, row, n, digest in zip(some, two, size.tolist(), _digests(binary, size, width), strict=True):
            parts[i], digests[i] = row[:n], digest
    flat = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    values = pa.Array.from_buffers(pa.decimal128(38, 0), len(flat), [None, pa.py_buffer(flat.astype("<u8").tobytes())])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), pa.array(digests, pa.binary())


def polynomial_values(parents: pa.ListArray, colours: int, points: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The values of the trees' exact polynomials at points (x, p) modulo p (below 2^31), trees by points.

    The fold over vertices runs modulo p itself, for all points and for trees of all sizes at once; no coefficient is made, and
    a tree of n vertices takes n steps.
    """
    flat, size = parents.flatten().to_numpy(), pc.list_value_length(parents).to_numpy()
    begin, order = np.cumsum(size) - size, np.argsort(size, kind="stable")
    q = np.array([p for _, p in points], np.uint64)[:, None]
    leaf = np.array([[pow(x, c, p) for c in range(colours)] for x, p in points], np.uint64)
    out = np.zeros((len(size), len(points)), np.int64)
    low = 0
    while low < len(order):  # the smallest first, so that trees of a block are of like sizes
        some = order[low : low + max(1, HELD // (int(size[order[low]]) * leaf.size))]
        some = some[: max(1, HELD // (int(size[some[-1]]) * leaf.size))]
        sizes, longest = size[some], int(size[some[-1]])
        place = np.arange(longest)
        parent = flat[np.where(place < sizes[:, None], begin[some][:, None] + place, 0)]
        state = np.broadcast_to(leaf, (len(some), longest, *leaf.shape)).copy()
        for v in range(longest - 1, 0, -1):
            rows = np.arange(np.searchsorted(sizes, v, "right"), len(some))
            own = state[rows[0] :, v]
            toll = (own.sum(2, keepdims=True) % q) + q - own
            up = parent[rows, v]
            state[rows, up] = state[rows, up] * toll % q
        out[some] = (state[:, 0].sum(2, keepdims=True) % q)[:, :, 0]
        low += len(some)
    return out
