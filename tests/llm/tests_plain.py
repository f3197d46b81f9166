"""Plain versions that operators are held against."""

import re
from collections import defaultdict

import numpy as np
from xxhash import xxh64_intdigest


def plain_hits(text, items):
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    hit, found = set(), set()
    for i, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(words), len(hit), sorted(found)


def plain_place(key, leaves):
    """Descent in plain Python: among regions, then among the racks of the region, then among the shards of the rack."""
    text, at = "null" if key is None else str(key), ()
    for depth in (1, 2, 3):
        weights = defaultdict(float)
        for x in leaves:
            path = (x.region, x.rack, x.shard)
            if x.weight > 0 and path[: depth - 1] == at:
                weights[path[:depth]] += x.weight
        # xxhash64 of two columns: the first one's hash is the second one's seed
        seed = xxh64_intdigest(text.encode(), 42)
        draws = []
        for path, w in weights.items():
            h = xxh64_intdigest("/".join(map(str, path)).encode(), seed)
            draws.append((-np.log(((h >> 11) + 0.5) * 2.0**-53) / w, path))
        at = min(draws)[1]
    return at
