"""Corpus-wide counts of hashed keys, dealt to shards and answered bucket by bucket.

A bucket of rows sends each distinct key once, with its own count, to the shard of the key's range; the
shard adds up and answers every bucket with the totals of exactly the keys that it sent, in their order.
A key that a third of all rows hold is thus one entry per bucket. Nothing is gathered in one place.

Keys are the first bits of a hash, as many as bits_for() gives for the corpus: what moves of a key is then
little more than its distance from the one before. Keys whose counts must be exact carry a check as well.
What moves is a row for each bucket and shard that share keys, so never more rows than keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

KEY_BITS = 56
SPARE_BITS = 16  #: two different keys of a corpus agree with a chance of two to the minus this
BLOBS = "bucket long, shard long, level int, keys binary, checks binary, counts binary"
TOTALS = "bucket long, shard long, level int, counts binary, tokens long, types long"


def bits_for(size: int) -> int:
    """Bits of a key in a corpus of about size keys."""
    return min(KEY_BITS, max(1, int(size)).bit_length() + SPARE_BITS)


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Byte planes: the empty high bytes of small numbers stand together and compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def from_planes(raw: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def slices(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    edges = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def blobs(bucket: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, int]], shards: int) -> pa.Table:
    """Sorted distinct keys, counts, checks and bits of each level (1, 2, ...), cut by shard."""
    out = {"bucket": [], "shard": [], "level": [], "keys": [], "checks": [], "counts": []}
    for level, (distinct, counts, checks, bits) in enumerate(levels, 1):
        cuts = slices(distinct, shards, bits)
        for s in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[s], cuts[s + 1]
            out["bucket"].append(bucket)
            out["shard"].append(int(s))
            out["level"].append(level)
            out["keys"].append(planes(np.diff(distinct[a:b], prepend=np.uint64(0))))
            out["checks"].append(planes(checks[a:b], 3) if checks is not None else None)
            out["counts"].append(planes(counts[a:b]))
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=list(out))


def sums(keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The total of each entry's key, and the totals of the distinct keys."""
    order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
    own = keys[order]
    fresh = np.r_[True, own[1:] != own[:-1]]
    if checks is not None:
        fresh[1:] |= np.diff(checks[order].astype(np.int64)) != 0
    total = np.add.reduceat(counts[order], np.flatnonzero(fresh))
    out = np.empty(len(keys), np.uint64)
    out[order] = total[np.cumsum(fresh) - 1]
    return out, total


def add_up(rows: pa.Table) -> pa.Table:
    """Answers each bucket with the total counts of its n-grams; one more row, of bucket -1, has what the shard adds to the corpus figures."""
    out = {"bucket": [], "shard": [], "level": [], "counts": [], "tokens": [], "types": []}

    def put(*values):
        for column, v in zip(out.values(), values):
            column.append(v)

    at = rows.column("level").to_numpy()
    shard = rows.column("shard")[0].as_py()
    for level in np.unique(at):
        own = rows.filter(pa.array(at == level))
        keys = [np.cumsum(from_planes(k.as_buffer()), dtype=np.uint64) for k in own.column("keys")]
        checks = [from_planes(k.as_buffer(), 3) for k in own.column("checks") if k.is_valid]
        counts = np.concatenate([from_planes(k.as_buffer()) for k in own.column("counts")])
        answer, distinct = sums(np.concatenate(keys), np.concatenate(checks) if checks else None, counts)
        end = 0
        for bucket, k in zip(own.column("bucket").to_pylist(), keys):
            put(bucket, shard, level, planes(answer[end : end + len(k)]), 0, 0)
            end += len(k)
        if level == 1:
            put(-1, shard, level, b"", int(distinct.sum()), int((distinct > 0).sum()))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def answered(answers: pa.Table, levels: int) -> list[np.ndarray]:
    """The totals of a bucket's distinct keys, by level, in the order of the keys."""
    answers = answers.sort_by([("level", "ascending"), ("shard", "ascending")])
    at = answers.column("level").to_numpy()
    own = [from_planes(c.as_buffer()) for c in answers.column("counts")]
    return [np.concatenate([c for c, k in zip(own, at) if k == level] or [np.zeros(0)]).astype(np.float64) for level in range(1, levels + 1)]
