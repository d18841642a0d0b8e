"""Parity signatures of sets in numpy: the helpers of set overlap for the tiles and pairs of one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a signature, at least and at most; both are powers of two.
LEAST, MOST = 256, 65_536


def signature_bits(n, limit: float):
    """Bits for a set of ``n`` elements: twice the size of the largest set it can link to, or more."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) * 2 / max(limit, 0.05))), LEAST, MOST).astype(np.int64)


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The signature: bit b is set if an odd number of hashes are b modulo ``bits``."""
    slot = np.asarray(hashes, np.int64) & int(bits - 1)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(bool), bitorder="little").view(np.int64)


def runs(images: pa.Array) -> dict:
    """First and last place + 1 of each image in an ordered list."""
    if not len(images):
        return {}
    codes = images.dictionary_encode()
    index = codes.indices.to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1, [len(index)]])
    return {codes.dictionary[int(index[x])].as_py(): (int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)}


def _folded(sig: np.ndarray, ends: np.ndarray, rows: np.ndarray, words: int) -> np.ndarray:
    """Signatures of ``rows`` as a matrix of ``words`` columns; each has as many words or a multiple of them."""
    out = np.empty((len(rows), words), np.uint64)
    width = ends[rows + 1] - ends[rows]
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        one = sig[ends[rows[at]][:, None] + np.arange(w)]
        out[at] = np.bitwise_xor.reduce(one.reshape(len(at), w // words, words), axis=1)
    return out


def close_pairs(runs_a: dict, n_a: np.ndarray, sig_a: np.ndarray, runs_b: dict, n_b: np.ndarray, sig_b: np.ndarray, same: bool, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in tiles a and b of pairs of one image whose signatures allow an overlap above ``limit``.

    Tile b is tile a (``same``; then only later places meet) or comes after it in the order of size, so its sets are as
    large or larger and their signatures as wide or wider. Half the signature is compared first, then all of it.
    """
    words_a, words_b = signature_bits(n_a, limit) // 64, signature_bits(n_b, limit) // 64
    ends_a, ends_b = np.concatenate([[0], np.cumsum(words_a)]), np.concatenate([[0], np.cumsum(words_b)])
    sig_a, sig_b = sig_a.view(np.uint64), sig_b.view(np.uint64)
    apart = 1 - 2 * limit / (1 + limit)         # share of both sizes by which linked sets differ at most
    found_p, found_q = [], []
    for image in runs_a.keys() & runs_b.keys():
        (a0, a1), (b0, b1) = runs_a[image], runs_b[image]
        for words in np.unique(words_a[a0:a1]):
            s0, s1 = a0 + np.searchsorted(words_a[a0:a1], [words, words + 1])
            size = n_a[s0:s1]
            first = s0 if same else b0
            last = b0 + np.searchsorted(limit * n_b[b0:b1] - 1e-9, size[-1])      # larger sets than these link to none here
            if last <= first:
                continue
            full_a, full_b = _folded(sig_a, ends_a, np.arange(s0, s1), words), _folded(sig_b, ends_b, np.arange(first, last), words)
            half_a = np.ascontiguousarray((full_a[:, :words // 2] ^ full_a[:, words // 2:]).T)
            half_b = full_b[:, :words // 2] ^ full_b[:, words // 2:]
            low = np.searchsorted(size, limit * n_b[first:last] - 1e-9, "right")
            for k in range(last - first):
                lo, hi = low[k], min(first + k - s0, s1 - s0) if same else s1 - s0
                if lo >= hi:
                    continue
                most = apart * (size[lo:hi] + n_b[first + k]) + 2e-9
                differ = np.bitwise_count(half_a[:, lo:hi] ^ half_b[k][:, None]).sum(axis=0, dtype=np.uint16)
                at = np.flatnonzero(differ < most)
                if len(at):
                    at = at[np.bitwise_count(full_a[lo + at] ^ full_b[k]).sum(axis=1, dtype=np.int64) < most[at]]
                    found_p.append(s0 + lo + at)
                    found_q.append(np.full(len(at), first + k))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_p]), np.concatenate([none, *found_q])


def packed(table: pa.RecordBatch | pa.Table, sets: str) -> bytes:
    """Rows as compressed bytes. The elements of the arrays ``sets`` are written once each, in order, with the first row.

    An array is the numbers of its elements there, rising and as differences; its own order is not kept.
    """
    table = pa.table(table).combine_chunks()
    lists = table[sets].combine_chunks() if table.num_rows else pa.array([], table.schema.field(sets).type)
    size = pc.list_value_length(lists).to_numpy()
    codes = lists.flatten().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(codes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    owner = np.repeat(np.arange(len(size)), size) * max(len(order), 1)
    rising = np.sort(owner + rank[codes.indices.to_numpy()]) - owner
    numbers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.diff(rising, prepend=0), pa.int32()))
    words = pa.ListArray.from_arrays(pa.array([0, *[len(order)] * len(size)], pa.int32()), codes.dictionary.take(order))
    table = table.set_column(table.schema.get_field_index(sets), sets, numbers).append_column("_words", words)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(blobs: list[bytes], sets: str) -> pa.Table:
    """The rows of all ``blobs`` with plain arrays again."""
    out = []
    for blob in blobs:
        table = pa.ipc.open_stream(blob).read_all().combine_chunks()
        numbers, words = (table[c].combine_chunks() for c in (sets, "_words"))
        plain = pa.ListArray.from_arrays(numbers.offsets, words.flatten().take(pa.array(np.cumsum(numbers.values.to_numpy(), dtype=np.int64))))
        out.append(table.drop_columns("_words").set_column(table.schema.get_field_index(sets), sets, plain))
    return pa.concat_tables(out)


def shared(codes: np.ndarray, ends: np.ndarray, n_codes: int, p: np.ndarray, q: np.ndarray, at_once: int = 4_000_000) -> np.ndarray:
    """Number of shared elements of sets ``p`` and ``q``; set s has the codes from ``ends[s]`` up to ``ends[s + 1]``."""
    out, here = np.zeros(len(p), np.int64), np.zeros(n_codes, bool)
    order = np.argsort(p, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(p[order])) + 1, [len(p)]]) if len(p) else [0]
    for x, y in zip(starts[:-1], starts[1:], strict=True):
        own = codes[ends[p[order[x]]]:ends[p[order[x]] + 1]]
        here[own] = True
        sizes = ends[q[order[x:y]] + 1] - ends[q[order[x:y]]]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1, [y - x]])
        for u, v in zip(cuts[:-1], cuts[1:], strict=True):
            if u == v:
                continue
            some, long = q[order[x + u:x + v]], sizes[u:v]
            begin = np.concatenate([[0], np.cumsum(long)[:-1]])
            place = np.repeat(ends[some] - begin, long) + np.arange(long.sum())
            out[order[x + u:x + v]] = np.add.reduceat(here[codes[place]], begin, dtype=np.int64)
        here[own] = False
    return out
