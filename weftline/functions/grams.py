"""Cosines of tf-idf weighted character n-grams, of all texts of one block with all of another.

The n-grams that most texts have are columns of two matrices that are multiplied; the others go by lists
of the texts that hold them. Both are in single precision and only choose what is scored again in double
precision, from all n-grams, with room for their error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

#: n-grams that are columns of the matrices, and rows that are multiplied at once.
DENSE, ROWS = 1024, 64
#: More than twice what single precision can be off on sums of products of vectors of length 1.
SLACK = np.float32(5e-4)
#: Places of which only the largest value is looked at first.
_RUN = 64


def counted(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, n-gram, count) of the n-grams of 2 to 4 characters of each text's words, which single spaces
    part, and the n-grams. A word has a space on both sides; n-grams don't reach over it."""
    padded = [f" {t.replace(' ', '  ')} " if t else "" for t in texts]
    whole = "".join(padded)
    row = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    flat = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(flat):
        return row, row, row, []
    letters, c = np.unique(flat, return_inverse=True)
    c, base = c.astype(np.int64), len(letters)
    inside = ~((flat[:-1] == 32) & (flat[1:] == 32))
    distinct, two = np.unique(c[:-1] * base + c[1:], return_inverse=True)
    ok = {2: inside, 3: inside[:-1] & inside[1:], 4: inside[:-2] & inside[1:-1] & inside[2:]}
    key = {2: two, 3: two[:-1] * base + c[2:], 4: two[:-2] * len(distinct) + two[2:]}
    names: list[str] = []
    rows, grams = [], []
    for n in (2, 3, 4):
        at = np.flatnonzero(ok[n])
        _, first, which = np.unique(key[n][at], return_index=True, return_inverse=True)
        rows.append(row[at])
        grams.append(which + len(names))
        names += [whole[i : i + n] for i in at[first].tolist()]
    cells, count = np.unique(np.concatenate(rows) * len(names) + np.concatenate(grams), return_counts=True)
    return cells // len(names), cells % len(names), count, names


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def nearest(texts: Sequence[str], others: Sequence[str], idf: Mapping[str, float], left_out: frozenset[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, other, cosine): for each text the k others with the highest cosines over 0 to nine places,
    of equal ones the first. n-grams without ``idf`` don't count; those left out count in lengths only."""
    n, m = len(texts), len(others)
    row, gram, count, names = counted([*texts, *others])
    weight = np.array([idf.get(g, 0.0) for g in names])[gram] * (1 + np.log(count)) if names else np.empty(0)
    length = np.sqrt(np.bincount(row, weight * weight, n + m)) if names else np.zeros(n + m)
    held = (weight > 0) & ~np.array([g in left_out for g in names], bool)[gram] if left_out and names else weight > 0
    row, gram, weight = row[held], gram[held], weight[held] / length[row[held]]
    first = np.searchsorted(row, np.arange(n + m + 1))
    mine, theirs = slice(0, first[n]), slice(first[n], None)
    uses, lists = np.bincount(gram[mine], minlength=len(names)), np.bincount(gram[theirs], minlength=len(names))
    often = np.argsort(-(uses * lists), kind="stable")[:DENSE]
    column = np.full(len(names), -1)
    column[often] = np.arange(len(often))
    width = max(1, -(-m // _RUN)) * _RUN
    b = np.zeros((len(often), width), np.float32)
    dense = column[gram] >= 0
    at = np.flatnonzero(dense[theirs]) + first[n]
    b[column[gram[at]], row[at] - n] = weight[at]
    # Lists of the other n-grams, by n-gram.
    at = np.flatnonzero(~dense[theirs]) + first[n]
    at = at[np.argsort(gram[at], kind="stable")]
    list_text, list_weight = (row[at] - n).astype(np.int64), weight[at]
    sizes = np.bincount(gram[at], minlength=len(names))
    starts = np.cumsum(sizes) - sizes
    own = np.zeros(len(names))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for lo in range(0, n, ROWS):
        hi = min(n, lo + ROWS)
        part = np.arange(first[lo], first[hi])
        a = np.zeros((hi - lo, len(often)), np.float32)
        x = part[dense[part]]
        a[row[x] - lo, column[gram[x]]] = weight[x]
        s = a @ b
        x = part[~dense[part]]
        x = x[sizes[gram[x]] > 0]
        many = sizes[gram[x]]
        if len(x):
            places = _ranges(starts[gram[x]], many)
            cells = np.repeat((row[x] - lo) * width, many) + list_text[places]
            s += np.bincount(cells, np.repeat(weight[x], many) * list_weight[places], s.size).reshape(s.shape).astype(np.float32)
        # The k-th of the largest values of runs is no more than the k-th value.
        tops = s.reshape(hi - lo, -1, _RUN).max(axis=2)
        least = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else np.zeros(hi - lo, np.float32)
        q, c = np.nonzero((s > 0) & (s >= (least - SLACK)[:, None]))
        ends = np.searchsorted(q, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            near = c[ends[i] : ends[i + 1]]
            if not len(near):
                continue
            mine = slice(first[lo + i], first[lo + i + 1])
            if len(near) > k:
                value = s[i, near]
                near = near[value >= np.partition(value, -k)[-k] - SLACK]
            own[gram[mine]] = weight[mine]
            size = first[n + near + 1] - first[n + near]
            places = _ranges(first[n + near], size)
            score = np.add.reduceat(own[gram[places]] * weight[places], np.cumsum(size) - size)
            own[gram[mine]] = 0.0
            best = np.lexsort((near, -np.round(score, 9)))[:k]
            found.append((lo + i, near[best], score[best]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
