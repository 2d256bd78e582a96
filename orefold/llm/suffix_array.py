"""Suffix arrays of byte strings by induced sorting, on whole numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbours; the leftmost S
suffixes (LMS) divide the string into substrings. These are sorted by inducing, named, and the string
of their names is sorted recursively where names repeat. The order of the LMS suffixes then induces
the whole array: one pass over the buckets upwards places the L suffixes, one downwards the S
suffixes. The passes take many buckets of a large alphabet in one step, so that the recursion, whose symbols are
names, needs no step for each name. Inside the buckets they go in rounds, each over all entries known so far, so a batch
needs as many rounds as its longest run of one symbol, not as many steps as entries.
"""

from __future__ import annotations

import numpy as np


#: 2**0, 2**8, ... 2**56: a difference below 2**(8 k) leaves the first 8 - k bytes equal.
_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)


#: So many symbols are induced entry by entry: batches of a short string are too small to gain by.
SINGLE = 1 << 16


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is S. The end of the string counts as smaller than every symbol."""
    n = len(text)
    kind = np.zeros(n, bool)
    if n < 2:
        return kind
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = text[change] < text[change + 1]
    lengths = np.diff(np.concatenate([[-1], change]))
    kind[: change[-1] + 1 if len(change) else 0] = np.repeat(rising, lengths)
    return kind


def induce(text: np.ndarray, kind: np.ndarray, lms: np.ndarray, single: int = SINGLE) -> np.ndarray:
    """The suffix array that the given order of the LMS suffixes induces. Symbols are 0, 1, ... and all occur.

    Strings of up to ``single`` symbols are induced entry by entry, longer ones in batches; both give the same.
    """
    return (_one_by_one if len(text) <= single else _in_batches)(text, kind, lms)


def _one_by_one(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Both passes over plain lists."""
    n, symbols, small = len(text), text.tolist(), kind.tolist()
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    fill, tail, out = (ends - counts).tolist(), ends.tolist(), [-1] * n
    for i in lms[::-1].tolist():
        c = symbols[i]
        tail[c] -= 1
        out[tail[c]] = i
    c = symbols[n - 1]
    out[fill[c]] = n - 1
    fill[c] += 1
    for p in range(n):
        i = out[p] - 1
        if i >= 0 and not small[i]:
            c = symbols[i]
            out[fill[c]] = i
            fill[c] += 1
    tail = ends.tolist()
    for p in range(n - 1, -1, -1):  # what stood in a bucket's end is replaced before the pass comes there
        i = out[p] - 1
        if i >= 0 and small[i]:
            c = symbols[i]
            tail[c] -= 1
            out[tail[c]] = i
    return np.array(out, text.dtype)


def _in_batches(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Both passes by buckets, on whole arrays.

    Each pass takes as many buckets at once as place no suffix into one another. What they place into themselves
    comes first, in rounds over what is new; a round that reaches another bucket of the batch ends the batch before that.
    A step is a few calls on whole arrays.
    """
    n = len(text)
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    heads, sigma = ends - counts, len(counts)
    out = np.full(n, -1, text.dtype)
    numbers = np.arange(max(n, sigma) + 1)
    large = ~kind

    def places(ordered: np.ndarray) -> np.ndarray:
        """Place of each among its equals, in sorted symbols."""
        m = len(ordered)
        start = numbers[:m].copy()
        start[1:] *= ordered[1:] != ordered[:-1]
        return numbers[:m] - np.maximum.accumulate(start)

    def push(before: np.ndarray, symbols: np.ndarray) -> None:
        """Append L suffixes to their buckets, in the order given."""
        order = symbols.argsort(kind="stable")
        symbols = symbols[order]
        spot = fill[symbols] + places(symbols)
        out[spot] = before[order]
        fill[symbols] = spot + 1

    def push_down(before: np.ndarray, symbols: np.ndarray) -> None:
        """Put S suffixes before those that their buckets' ends have, in the order given."""
        order = symbols.argsort(kind="stable")
        symbols = symbols[order]
        spot = tail[symbols] - 1 - places(symbols)
        out[spot] = before[order]
        tail[symbols] = spot

    def preceding(entries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        before = entries[entries > 0] - 1
        return before[wanted[before]]

    def take_back(first: int, stop: int, start: np.ndarray, end: np.ndarray) -> None:
        """Empty the places from start to end of the buckets from the first on."""
        many = end - start
        if first < stop and many.any():
            out[np.repeat(start - (np.cumsum(many) - many), many) + numbers[: many.sum()]] = -1

    fill, tail = heads.copy(), ends.copy()
    if len(lms):
        push_down(lms[::-1], text[lms[::-1]])
    seeds = np.flatnonzero(out >= 0)
    tail = ends.copy()
    last = np.array([n - 1], text.dtype)
    push(last, text[last])
    c, wide = 0, 1
    while c < sigma:
        stop = min(sigma, c + wide)
        before = preceding(out[heads[c] : ends[stop - 1]], large)
        if not len(before):
            c, wide = stop, 2 * wide
            continue
        into, of = text[before], text[before + 1]
        own = into == of
        # the first buckets of the batch, up to the least other bucket that anything so far goes into
        reach = np.minimum.accumulate(np.where(own, sigma, into))
        late = int((reach <= of).argmax()) if reach[-1] <= of[-1] else len(of)
        edge = min(stop if late == len(of) else int(of[late]), int(reach[late - 1]))
        late = int(of.searchsorted(edge))
        if own[:late].any():
            asked, was = edge, fill[c:edge].copy()
            now = before[:late][own[:late]]
            while len(now):
                push(now, text[now])
                now = preceding(now, large)
                into, of = text[now], text[now + 1]
                own = into == of
                edge = min(edge, int(into[~own].min(initial=edge)))
                now = now[own & (of < edge)]
            take_back(edge, asked, was[edge - c :], fill[edge:asked])
            fill[edge:asked] = was[edge - c :]
            before = preceding(out[heads[c] : ends[edge - 1]], large)
            into = text[before]
            other = into != text[before + 1]
            before, into = before[other], into[other]
        else:
            before, into = before[:late], into[:late]
        if len(before):
            push(before, into)
        c, wide = edge, 2 * wide if edge == stop else edge - c
    out[seeds] = -1
    c, wide = sigma - 1, 1
    while c >= 0:
        stop = max(-1, c - wide)
        before = preceding(out[heads[stop + 1] : ends[c]][::-1], kind)
        if not len(before):
            c, wide = stop, 2 * wide
            continue
        into, of = text[before], text[before + 1]
        own = into == of
        reach = np.maximum.accumulate(np.where(own, -1, into))
        late = int((reach >= of).argmax()) if reach[-1] >= of[-1] else len(of)
        edge = max(stop if late == len(of) else int(of[late]), int(reach[late - 1]))
        late = int((of <= edge).argmax()) if of[-1] <= edge else len(of)
        if own[:late].any():
            asked, was = edge, tail[edge + 1 : c + 1].copy()
            now = before[:late][own[:late]]
            while len(now):
                push_down(now, text[now])
                now = preceding(now, kind)
                into, of = text[now], text[now + 1]
                own = into == of
                edge = max(edge, int(into[~own].max(initial=edge)))
                now = now[own & (of > edge)]
            take_back(asked + 1, edge + 1, tail[asked + 1 : edge + 1], was[: edge - asked])
            tail[asked + 1 : edge + 1] = was[: edge - asked]
            before = preceding(out[heads[edge + 1] : ends[c]][::-1], kind)
            into = text[before]
            other = into != text[before + 1]
            before, into = before[other], into[other]
        else:
            before, into = before[:late], into[:late]
        if len(before):
            push_down(before, into)
        c, wide = edge, 2 * wide if edge == stop else c - edge
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order; a suffix that ends first is smaller."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if n >= 1 << 31:
        raise ValueError("a part has 2 GB or more")
    _, text = np.unique(text, return_inverse=True) if text.dtype != np.int32 else (None, text)
    return _sorted_suffixes(text.astype(np.int32)).astype(np.int64)


def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of a string of dense symbols, by recursion on the names of its LMS substrings."""
    kind = classify(text)
    lms = (np.flatnonzero(kind[1:] & ~kind[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        rough = induce(text, kind, lms)
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        names = _names(text, lms, rough[is_lms[rough]])
        if int(names.max()) + 1 < len(names):
            lms = lms[_sorted_suffixes(names)]
        else:
            lms = lms[np.argsort(names)]
    return induce(text, kind, lms)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, equal ones alike, in text order; the last one is unlike all."""
    n = len(text)
    follow = np.append(lms[1:], n)
    width = np.empty(n + 1, np.int64)
    width[lms] = follow - lms + 1
    length = width[ordered]
    last = lms[-1]
    same = (length[1:] == length[:-1]) & (ordered[1:] != last) & (ordered[:-1] != last)
    left, right, open_ = ordered[:-1], ordered[1:], np.flatnonzero(same)
    j = 0
    while len(open_):
        equal = text[left[open_] + j] == text[right[open_] + j]
        same[open_[~equal]] = False
        open_ = open_[equal]
        j += 1
        open_ = open_[j < length[1:][open_]]
    rank = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)
    at = np.empty(n, np.int32)
    at[ordered] = rank
    return at[lms]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position, in text order, how long its suffix agrees with the
    one before it in suffix order, up to ``most``; 0 for the first suffix."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(most + 8, np.uint8)])
    word = np.zeros(n + most, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : n + most + j]
    result = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    for step in range(0, most, 8):
        mine, other = word[at + step], word[before[at] + step]
        differ = mine ^ other
        bad = differ != 0
        agree = 8 - np.searchsorted(_BYTES, differ, "right")
        result[at] += agree
        at = at[~bad]
    room = np.where(before >= 0, np.minimum(n - np.arange(n), n - before), 0)
    return np.minimum(np.minimum(result, most), room)
