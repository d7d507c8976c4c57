"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

import numpy as np

#: Bytes of text in one numpy step.
STEP = 1 << 21

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix(x):
    """A bijection on 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int):
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), _BASE if kind == "up" else _BACK, dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def _hash_words(raw: bytes, gaps=_GAP):
    """Hashes, start and end offsets of the words of one buffer; gaps marks the bytes that part words."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = gaps[data]
    inside = np.concatenate(([True], gap, [True]))
    starts = np.flatnonzero(inside[:-1] & ~inside[1:])
    ends = np.flatnonzero(~inside[:-1] & inside[1:])
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=total[1:])
    hashes = (total[ends] - total[starts]) * _power("down", len(data))[starts]
    return mix(hashes ^ (ends - starts).astype(np.uint64)), starts, ends


def words(texts: list):
    """Lower-cased (A-Z) words between ASCII white space of all texts: hashes, and bounds (texts + 1) into them.

    A null text has no words. Texts are read in steps of about STEP bytes, cut at white space, so memory follows the
    step, but for a longer single word.
    """
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    raws = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    row, size, first = [], 0, 0

    def flush(upto):
        nonlocal row, size, first
        if row:
            buffer = b"\n".join(row)
            hashes, starts, _ = _hash_words(buffer)
            bounds = np.cumsum([0] + [len(r) + 1 for r in row])
            counts[first:upto] += np.diff(np.searchsorted(starts, bounds))
            parts.append(hashes)
        row, size, first = [], 0, upto

    for i, raw in enumerate(raws):
        if len(raw) > STEP:
            flush(i)
            at = 0
            while at < len(raw):
                cut = min(len(raw), at + STEP)
                while cut < len(raw) and raw[cut] not in b" \t\n\v\f\r":
                    cut += 1
                hashes, _, _ = _hash_words(raw[at:cut])
                parts.append(hashes)
                counts[i] += len(hashes)
                at = cut
            first = i + 1
            continue
        row.append(raw)
        size += len(raw) + 1
        if size > STEP:
            flush(i + 1)
    flush(len(raws))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def chain(hashes, n: int):
    """Hash of every n consecutive words (len - n + 1 of them), as if no text ended between."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + m])
    return out


def shingle_sets(texts: list, n: int = 5) -> list:
    """Sorted distinct hashes of the n-word shingles of each text; with fewer words the whole sequence as one."""
    hashes, bounds = words(texts)
    runs = chain(hashes, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(chain(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
