"""Keyed draws in bulk: the MD5 of many texts that differ in their last number only, and sums of drawn values.

A draw is the same number as ``resample.keyed_draw`` gives. No row is made per draw: a worker holds the values
of one cluster in order, works out the drawn positions in blocks, and hands on a sum per replicate and cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import unless_large

BLOCK = 1 << 15         # draws worked on at once
_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_S = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_G = [g for i in range(16) for g in (i,)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


def _one_step(i: int, a: int, b: int, c: int, d: int, word: int) -> tuple[int, int, int, int]:
    f = (d ^ (b & (c ^ d))) if i < 16 else (c ^ (d & (b ^ c))) if i < 32 else (b ^ c ^ d) if i < 48 else (c ^ (b | (~d & _MASK)))
    t = (a + f + _K[i] + word) & _MASK
    return d, (b + ((t << _S[i] | t >> (32 - _S[i])) & _MASK)) & _MASK, b, c


def _block(state: list, words: list, steps: int) -> list:
    """State (a, b, c, d) after ``steps`` steps over 16 words; words and state are numbers or arrays."""
    i, now = 0, list(state)
    while i < steps and not any(isinstance(x, np.ndarray) for x in (*now, words[_G[i]])):
        now = list(_one_step(i, *now, words[_G[i]]))
        i += 1
    if i == steps:
        return now
    n = next(len(x) for x in (*now, *words) if isinstance(x, np.ndarray))
    a, b, c, d = (x.copy() if isinstance(x, np.ndarray) else np.full(n, x, np.uint32) for x in now)
    t = np.empty(n, np.uint32)
    for i in range(i, steps):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        word = words[_G[i]]
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a)
            word = 0
        np.add(a, np.uint32((_K[i] + word) & _MASK), out=a)
        np.left_shift(a, np.uint32(_S[i]), out=t)
        np.right_shift(a, np.uint32(32 - _S[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def _plus(x, y):
    if isinstance(x, np.ndarray) or isinstance(y, np.ndarray):
        return np.add(x, np.uint32(y)) if not isinstance(y, np.ndarray) else np.add(np.uint32(x), y) if not isinstance(x, np.ndarray) else x + y
    return (x + y) & _MASK


def first_bits(prefix: bytes, start: int, stop: int) -> np.ndarray:
    """First 32 bits of the MD5 of ``prefix`` followed by each of ``start .. stop - 1``, which have equally many digits."""
    digits, numbers = len(str(start)), np.arange(start, stop, dtype=np.int64)
    length = len(prefix) + digits
    text = bytearray(prefix + b"0" * digits + b"\x80")
    text += bytes(-(len(text) + 8) % 64) + (8 * length).to_bytes(8, "little")
    words: list = [int(w) for w in np.frombuffer(bytes(text), "<u4")]
    for j in range(digits - 1, -1, -1):
        numbers, digit = np.divmod(numbers, 10)
        at = len(prefix) + j
        words[at // 4] = _plus(words[at // 4], digit.astype(np.uint32) << np.uint32(8 * (at % 4)))
    state: list = list(_START)
    for k in range(0, len(words), 16):
        last = k + 16 == len(words)
        got = _block(state, words[k:k + 16], 61 if last else 64)
        if last:
            return np.asarray(_plus(got[1], state[0]), np.uint32).byteswap()      # the three steps left move this word to the front
        state = [_plus(x, y) for x, y in zip(got, state, strict=True)]
    raise AssertionError("a text has a block")


def positions(prefix: str, n: int) -> Iterator[np.ndarray]:
    """The ``n`` keyed draws out of ``0 .. n-1`` in blocks: first 8 digits of the MD5 of prefix and number, modulo ``n``."""
    key, start = prefix.encode(), 0
    while start < n:
        stop = min(n, start + BLOCK, 10 ** len(str(start)))
        bits = first_bits(key, start, stop)
        yield bits if n > _MASK else bits - (bits // np.uint32(n)) * np.uint32(n)
        start = stop


def drawn_sums(rows: DataFrame, sizes: DataFrame, chosen: DataFrame, group: Sequence[str], prefix: Column) -> DataFrame:
    """Sum ``_s`` and number ``_m`` of the values drawn in each row of ``chosen`` (group, _rep, _c, _n): (group, _rep, _s, _m).

    ``rows`` has the values (group, _c, _x), ``sizes`` a row per cluster, stored. Values go to the workers packed, eight bytes each,
    once per share of the replicates; a worker holds those of one cluster.
    """
    cores, clusters = rows.sparkSession.sparkContext.defaultParallelism, max(1, sizes.count())
    shares, parts = max(1, -(-16 * cores // clusters)), max(4 * cores, clusters // 64)
    key = [*group, "_c"]
    put = (F.pmod(F.xxhash64("_rep"), F.lit(shares))).cast("int").alias("_share")

    def pack(batches):
        for batch in batches:
            ids, x = batch["_id"].to_numpy(), batch["_x"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ends = np.concatenate([[0], np.flatnonzero(np.diff(ids[order])) + 1, [len(order)]])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids[order[ends[:-1]]]), pa.array([x[order[p:q]].tobytes() for p, q in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["_id", "_b"])

    def add(one, two):
        values = np.sort(np.concatenate([np.frombuffer(b.as_buffer()) for b in two["_b"]] or [np.empty(0)]))
        sums = [float(sum(values[p].sum() for p in positions(k, n))) for k, n in zip(one["_key"].to_pylist(), one["_n"].to_pylist(), strict=True)]
        return pa.table([one["_id"], one["_rep"], pa.array(sums, pa.float64()), one["_n"]], names=["_id", "_rep", "_s", "_m"])

    numbered = unless_large(sizes)
    packs = rows.join(numbered, key).select("_id", "_x").mapInArrow(pack, "_id bigint, _b binary")
    packs = packs.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(parts, "_id", "_share")
    asked = chosen.select("_id", put, "_rep", "_n", prefix.alias("_key")).repartition(parts, "_id", "_share")
    sums = asked.groupBy("_id", "_share").cogroup(packs.groupBy("_id", "_share")).applyInArrow(add, "_id bigint, _rep int, _s double, _m bigint")
    return sums.join(numbered.select("_id", *group), "_id").groupBy(*group, "_rep").agg(F.sum("_s").alias("_s"), F.sum("_m").alias("_m"))
