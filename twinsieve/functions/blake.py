"""BLAKE3 with 32 bytes of output, in numpy over all chunks of a message at once; used where the blake3 library is missing."""

from __future__ import annotations

import numpy as np

# Fixed values of the published algorithm.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """chain (8, n), words (16, n) -> the new chain (8, n) of n blocks."""
    n = chain.shape[1]
    s = np.empty((16, n), "u4")
    s[:8], s[8:12] = chain, np.array(IV[:4], "u4")[:, None]
    s[12], s[13], s[14], s[15] = counter & 0xFFFFFFFF, counter >> 32, length, flags
    order = list(range(16))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_QUARTERS):
            for word, turn_d, turn_b in ((order[2 * k], 16, 12), (order[2 * k + 1], 8, 7)):
                s[a] += s[b] + words[word]
                x = s[d] ^ s[a]
                s[d] = x >> turn_d | x << (32 - turn_d)
                s[c] += s[d]
                x = s[b] ^ s[c]
                s[b] = x >> turn_b | x << (32 - turn_b)
        order = [order[p] for p in PERMUTATION]
    return s[:8] ^ s[8:]


def blake3(data: bytes) -> bytes:
    return blake3_many([data])[0]


def blake3_many(messages: list[bytes]) -> list[bytes]:
    """Digests of many messages: all their chunks, and then the nodes of all trees level by level, are computed at once."""
    if not messages:
        return []
    lengths = np.array([len(m) for m in messages])
    chunks = np.maximum(1, -(-lengths // 1024))
    owner = np.repeat(np.arange(len(messages)), chunks)
    counter = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    words = np.frombuffer(b"".join(m.ljust(int(c) * 1024, b"\0") for m, c in zip(messages, chunks, strict=True)), "<u4").reshape(-1, 16, 16)
    sizes = np.minimum(1024, lengths[owner] - 1024 * counter)
    blocks = np.maximum(1, -(-sizes // 64))
    lone = chunks[owner] == 1
    chain = np.repeat(np.array(IV, "u4")[:, None], len(owner), 1)
    for k in range(16):
        on = np.flatnonzero(blocks > k)
        if not len(on):
            break
        last = blocks[on] == k + 1
        flags = (k == 0) * _START + last * _END + (last & lone[on]) * _ROOT
        length = np.where(last, sizes[on] - 64 * k, 64)
        chain[:, on] = _compress(chain[:, on], words[on, k].T.copy(), counter[on].astype("u8"), length.astype("u4"), flags.astype("u4"))
    # the left subtree of a node is the largest power of two of chunks: pairing neighbours level by level gives that
    while len(owner) > len(messages):
        count = np.bincount(owner, minlength=len(messages))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[owner]))
        start = np.repeat(np.array(IV, "u4")[:, None], len(left), 1)
        flags = np.where(count[owner[left]] == 2, _PARENT | _ROOT, _PARENT).astype("u4")
        chain[:, left] = _compress(start, np.concatenate([chain[:, left], chain[:, left + 1]]), np.zeros(len(left), "u8"), np.full(len(left), 64, "u4"), flags)
        stay = np.ones(len(owner), bool)
        stay[left + 1] = False
        chain, owner = chain[:, stay], owner[stay]
    return [c.tobytes() for c in np.ascontiguousarray(chain.T).astype("<u4")]
