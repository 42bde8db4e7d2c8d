"""Pairs of texts whose Ratcliff-Obershelp ratio may reach a bound, without loss, for two blocks of texts at a time.

A ratio r of texts of T characters together needs M >= r T / 2 matched ones. The matched ones are a common subsequence, so M is
at most the common characters counted one by one, which is cheap for a text against a whole block; it is at most the longest
common subsequence of what is left of both in some letters, plus the common ones of the others (one machine word a text), and
so on with a second group of letters; and at most the longest common subsequence of both. Each bound is asked only of the pairs that the one before it leaves.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Buckets of characters: the most frequent ones have their own, the rest share the last. LETTERS are the two groups of the middle bounds.
BUCKETS, LETTERS = 32, ((0, 3, 5, 7, 9, 11, 13, 15), (1, 2, 4, 6, 8, 10, 12, 14))
#: Texts with more letters of a group than this aren't asked its bound.
WORD = 64


def least_matched(least: float, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many characters must match for the ratio."""
    return np.ceil(least / 2 * (na + nb) - 1e-9).astype(np.int64)


class Block:
    """Texts as codes of characters in the order of frequency (1 is the most frequent one), and counts by bucket."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.n = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        order = np.argsort(alphabet, kind="stable")
        self.codes = order[np.searchsorted(alphabet, raw, sorter=order)]
        self.row = np.repeat(np.arange(len(texts)), self.n)
        self.start = np.cumsum(self.n) - self.n
        bucket = np.minimum(self.codes, BUCKETS - 1)
        kind = np.uint8 if len(texts) and self.n.max() < 256 else np.uint16
        self.counts = np.bincount(bucket * len(texts) + self.row, minlength=BUCKETS * len(texts)).reshape(BUCKETS, len(texts)).astype(kind)
        self.groups = [Group(bucket, self.row, g, len(texts)) for g in LETTERS]


class Group:
    """What is left of the texts in some letters, and the places of each letter as a word a text."""

    def __init__(self, bucket: np.ndarray, row: np.ndarray, letters: tuple, texts: int):
        inner = np.flatnonzero(np.isin(bucket, letters))
        self.codes, rows = bucket[inner], row[inner]
        self.n = np.bincount(rows, minlength=texts)
        self.start = np.cumsum(self.n) - self.n
        place = np.arange(len(inner)) - self.start[rows]
        self.places, fits = np.zeros((BUCKETS, texts), np.uint64), place < WORD
        np.bitwise_or.at(self.places, (self.codes[fits], rows[fits]), np.uint64(1) << place[fits].astype(np.uint64))

    def letters(self, i: int) -> np.ndarray:
        return self.codes[self.start[i] : self.start[i] + self.n[i]]


def alphabet_of(*texts: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join("".join(t) for t in texts).encode("utf-32-le"), np.uint32)
    chars, n = np.unique(raw, return_counts=True)
    return chars[np.argsort(-n, kind="stable")]


def _first_group(a: np.ndarray, g: Group, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of the texts `at` those whose letters have a common subsequence with the letters `a` of `room` or more."""
    kept = at
    state, both, rest = (np.full(len(at), ~np.uint64(0)) for _ in range(3))
    has = {c: g.places[c][at] for c in set(a.tolist())}
    for k, c in enumerate(a.tolist(), 1):
        np.bitwise_and(state, has[c], out=both)
        np.subtract(state, both, out=rest)
        np.add(state, both, out=state)
        np.bitwise_or(state, rest, out=state)
        if k % 8 == 0 and k >= 16:  # what is left of a can match no more than itself
            stay = np.flatnonzero(np.bitwise_count(~state) + (len(a) - k) >= room)
            if len(stay) < 0.7 * len(kept):
                state, kept, room, has = state[stay], kept[stay], room[stay], {x: y[stay] for x, y in has.items()}
                both, rest = both[: len(stay)], rest[: len(stay)]
    return kept[np.bitwise_count(~state) >= room]


def _group(a: Group, i: np.ndarray, b: Group, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the letters of the pairs (i, j)."""
    order = np.argsort(-a.n[i], kind="stable")  # long ones first, so that those still going are a prefix
    i, j, state, out = i[order], j[order], np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.int64)
    for k in range(int(a.n[i].max(initial=0))):
        m = int(np.searchsorted(-a.n[i], -k, side="left"))
        v = state[:m]
        both = v & b.places[a.codes[a.start[i[:m]] + k], j[:m]]
        state[:m] = (v + both) | (v - both)
    out[order] = np.bitwise_count(~state)
    return out


def _groups(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """How many characters of the pairs match at most, by both groups and the common ones of all other buckets."""
    most = np.zeros(len(i), np.int64)
    for k in set(range(BUCKETS)) - set(LETTERS[0]) - set(LETTERS[1]):
        most += np.minimum(a.counts[k][i], b.counts[k][j])
    for letters, x, y in zip(LETTERS, a.groups, b.groups):
        common = sum(np.minimum(a.counts[k][i], b.counts[k][j]).astype(np.int64) for k in letters)
        most += np.where(y.n[j] > WORD, common, _group(x, i, y, j))
    return most


def common_subsequence(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs (i, j), bit-parallel over 64 places of b at a time."""
    words, out = -(-int(b.n[j].max(initial=1)) // 64), np.zeros(len(i), np.int64)
    used, row = np.unique(j, return_inverse=True)
    place = np.concatenate([np.arange(b.start[x], b.start[x] + b.n[x]) for x in used]) if len(used) else np.zeros(0, np.int64)
    chars, code = np.unique(b.codes[place], return_inverse=True)
    rows, off = np.repeat(np.arange(len(used)), b.n[used]), place - np.repeat(b.start[used], b.n[used])
    has = np.zeros((words, len(chars) + 1, len(used)), np.uint64)  # the last one: characters that b lacks
    np.bitwise_or.at(has, (off // 64, code, rows), np.uint64(1) << (off % 64).astype(np.uint64))
    known = np.full(int(max(a.codes.max(initial=0), b.codes.max(initial=0))) + 1, len(chars))
    known[chars] = np.arange(len(chars))
    state = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
    order = np.argsort(-a.n[i], kind="stable")  # long ones first, so that those still going are a prefix
    i, row, na = i[order], row[order], a.n[i][order]
    for k in range(int(na.max(initial=0))):
        m = int(np.searchsorted(-na, -k, side="left"))
        c, carry = known[a.codes[a.start[i[:m]] + k]], np.zeros(m, np.uint64)
        for w in range(words):
            v = state[w][:m]
            x = v & has[w, c, row[:m]]
            s = v + x
            t = s + carry
            carry = ((s < v) | (t < s)).astype(np.uint64)
            state[w][:m] = t | (v & ~x)
    out[order] = sum(np.bitwise_count(~s).astype(np.int64) for s in state)
    return out


def pairs(left: list[str], right: list[str], least: float, same: bool = False, batch: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of left[i], right[j] that pass all bounds; of one block with itself (`same`) only i < j."""
    if not left or not right:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet = alphabet_of(left, right)
    a = Block(left, alphabet)
    b = a if same else Block(right, alphabet)
    kind, order = b.counts.dtype, np.argsort(b.n, kind="stable")
    lengths, counts, full = b.n[order], np.ascontiguousarray(b.counts[:, order]), b.groups[0].n > WORD
    outer = [k for k in range(BUCKETS) if k not in LETTERS[0]]
    # Rows of one number: numpy takes the lesser of two rows far faster than that of a row and a number.
    level: dict[int, np.ndarray] = {}
    need_of: dict[int, np.ndarray] = {}
    out, waiting, held = [], [], 0

    def settle():
        i, j = (np.concatenate(x) for x in zip(*waiting))
        for bound in (_groups, common_subsequence):
            ok = bound(a, i, b, j) >= least_matched(least, a.n[i], b.n[j])
            i, j = i[ok], j[ok]
        out.append((i, j))
        waiting.clear()

    for i in range(len(left)):
        na = int(a.n[i])
        # 2 min(na, nb) >= least (na + nb)
        low, high = np.searchsorted(lengths, [na * least / (2 - least) - 1e-6, na * (2 - least) / least + 1e-6])
        if low == high:
            continue
        if na not in need_of:
            need_of[na] = np.minimum(least_matched(least, na, lengths), np.iinfo(kind).max).astype(kind)
        mine, need = a.counts[:, i], need_of[na][low:high]
        total = np.zeros(high - low, kind)
        for k in (*outer, *LETTERS[0]):
            if x := int(mine[k]):
                if x not in level:
                    level[x] = np.full(len(right), x, kind)
                total += np.minimum(counts[k, low:high], level[x][: high - low])
            if k == outer[-1]:
                other = total.copy()
        found = np.flatnonzero(total >= need)
        at = order[low + found]
        if same:
            after = at > i
            at, found = at[after], found[after]
        if not len(at):
            continue
        room = need[found].astype(np.int64) - other[found]
        long = full[at]
        kept = _first_group(a.groups[0].letters(i), b.groups[0], at, room)
        if long.any():  # letters beyond the word: not asked
            kept = np.union1d(kept, at[long])
        if len(kept):
            waiting.append((np.full(len(kept), i), kept))
            held += len(kept)
            if held >= batch:
                settle()
                held = 0
    if waiting:
        settle()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


#: Windows that are counted for long texts, and their hashes.
WINDOW, HASHES = 6, 1 << 16


class Windows:
    """The distinct windows of WINDOW characters of each text, by hash, and how often it holds each character."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), self.n)
        self.chars, code = np.unique(codes, return_inverse=True)
        self.counts = np.bincount(code * len(texts) + row, minlength=len(self.chars) * len(texts)).reshape(len(self.chars), len(texts))
        keys = row[: max(0, len(row) - WINDOW + 1)] * HASHES + windows(codes)
        keys = np.unique(keys[row[: len(keys)] == row[len(row) - len(keys) :]])
        self.hash, self.row = keys % HASHES, keys // HASHES


def windows(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of characters, 0 to HASHES - 1."""
    m = max(0, len(codes) - WINDOW + 1)
    h = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m]
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def _may_reach(sources: Windows, t: str, least: float) -> np.ndarray:
    """Which sources may reach the ratio with t.

    Every matched block but the one at the start of both holds a character that difflib doesn't call popular in t, so there
    are at most as many blocks as common ones of these, and one; all windows of t inside of a block are windows of the source.
    """
    need = least_matched(least, sources.n, np.int64(len(t)))
    may = (np.minimum(sources.n, len(t)) >= need) & (sources.n > 0)
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
    chars, n = np.unique(codes, return_counts=True)
    rare = n <= len(t) // 100 + 1 if len(t) >= 200 else np.ones(len(n), bool)
    at = np.searchsorted(sources.chars, chars)
    known = (at < len(sources.chars)) & (sources.chars[np.minimum(at, len(sources.chars) - 1)] == chars)
    common = np.minimum(sources.counts[at[known]], n[known][:, None])
    may &= common.sum(axis=0) >= need
    blocks = 1 + common[rare[known]].sum(axis=0)
    weight = np.bincount(windows(codes), minlength=HASHES)
    covered = np.bincount(sources.row, weights=weight[sources.hash], minlength=len(sources.n))
    return may & (covered >= need - blocks * (WINDOW - 1))


def first_reaching(sources: list[str], targets: list[str], limits: list[int], least: float) -> list[int]:
    """For each target the number of the first source, of those before its limit, that has the ratio with it; -1 without one.
    Sources are tried in their order until one has it. The ratio is that of (source, target), which isn't symmetric."""
    out = []
    if max(map(len, targets), default=0) < 256 and least >= 0.7:
        i, j = pairs(targets, sources, least)
        found = {}
        for x, y in zip(i.tolist(), j.tolist()):
            found.setdefault(x, []).append(y)
        tried = [sorted(found.get(k, [])) for k in range(len(targets))]
    else:
        known = Windows(sources)
        tried = (np.flatnonzero(_may_reach(known, t, least)).tolist() for t in targets)
    for t, limit, order in zip(targets, limits, tried):
        m = difflib.SequenceMatcher(None, "", t)
        hit = -1
        for k in order:
            if k >= limit:
                break
            m.set_seq1(sources[k])
            if m.ratio() >= least:
                hit = k
                break
        out.append(hit)
    return out
