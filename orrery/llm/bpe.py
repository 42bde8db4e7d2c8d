"""Byte-level BPE by speculation and verification, and decoding.

A text is cut at single spaces between two non-space characters, where no token can span, so equal pieces are encoded
once and kept in a bounded cache. Pieces are cut into words where the classes of the tokenizer's pattern change; pieces
with more than that in them (apostrophes, runs of white space, special strings) by the pattern itself. All new words of
a batch are then encoded together, as arrays:
  speculate: the longest vocabulary entry at each place is proposed, from left to right;
  verify: a sequence is what merging yields if and only if every adjacent pair is compatible, that is, if no merge
    across their border comes before both tokens are complete. All distinct pairs of the batch are tested at once, by
    taking the later-made token of a pair apart, step by step, and looking up merges across the border;
  only words with an incompatible pair undergo exact merging, one merge of each word a round.
Compatibility needs a vocabulary in which later merges have larger ids, and every entry must be reached by merging its
own bytes; entries for which that fails are not proposed. Without that order of ids every word is merged exactly.

Texts hold the tokenizer's special strings as their special ids, as the tokenizers library has it by default. Code
points for which the `regex` module's classes differ from the library's go through the library's own word cutter.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each on
their own; an empty table gives an empty result; further columns are ignored. Memory of a task is one Arrow batch, the
vocabulary and the cache (CACHE pieces; where more come together, those of the last batch only).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from orrery.llm.common import bounded_batches

#: The word pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 600_000
LONG_PIECE = 512
#: Words of up to so many bytes are merged together, as rows of one array.
WIDTHS = (8, 12, 16, 24, 32, 64)
NONE = np.iinfo(np.int32).max
_WHITE = "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if re.match(r"\s", chr(c)))
#: Where a space may be no border, for Arrow: white space before or after it.
UNSAFE = f" [{_WHITE}]|[{_WHITE}] "
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Classes of characters: others, letters, numbers, white space, those that need the pattern itself, and not known yet.
OTHER, LETTER, NUMBER, BLANK, RARE, UNKNOWN = 0, 1, 2, 3, 4, 255


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if printable, else 256 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges that begin at `first` and have these sizes, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def borders_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings without nulls, and where each string begins and the last one ends."""
    if not len(strings):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if strings.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, at, data = strings.buffers()
    at = np.frombuffer(at, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    return data, at - at[0]


class Lookup:
    """Values of integer keys, -1 for others. Open addressing in arrays, so that many keys are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._at(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            place, who = np.unique(at[free], return_index=True)
            self.keys[place], self.values[place] = keys[left[free[who]]], values[left[free[who]]]
            more = np.ones(len(left), bool)
            more[free[who]] = False
            left, at = left[more], self._after(at[more])

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _after(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = self._after(at[left])
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Encoder:
    def __init__(self, path: str | None = None):
        self.path = path or default_path()
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"]}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = raw[t]
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.id_of = {raw[t]: i for t, i in vocab.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        left, right, made = [], [], []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a]), right.append(vocab[b]), made.append(vocab[a + b])
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # Splits and merge keys as arrays, for the verification.
        self.first, self.second = np.arange(size), np.arange(size)
        self.first[made], self.second[made] = left, right
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.made = size, keys[order], np.array(made, dtype=np.int64)[order]
        self.ordered = made == sorted(set(made)) and (not made or min(made) > max(self.id_of[bytes([b])] for b in range(256)))
        self.proposable = dict(self.id_of)
        self.longest: dict[bytes, int] = {}
        for b in self.proposable:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.one = [self.id_of[bytes([b])] for b in range(256)]
        self.trie, self.token = self._trie()
        self.root = np.array([self.trie_of[bytes([b])] for b in range(256)], np.int64)
        del self.trie_of
        # Merges by rank: the id that each makes, and the rank of each pair of ids and of each pair of bytes.
        pairs = np.array([a * size + b for a, b in self.merge], np.int64)
        self.rank = Lookup(pairs, np.array([r for r, _ in self.merge.values()], np.int32))
        self.makes = np.array(made, np.int32)
        ones = np.array(self.one, np.int64)
        self.bytes_rank = np.where((r := self.rank((ones[:, None] * size + ones).ravel())) < 0, NONE, r)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.binary = pa.array(self.bytes, pa.large_binary())
        self.numbers = pa.array([f"{i}," for i in range(size)], pa.large_binary())
        self.forget()
        self.cutter = None
        self.seen: set[str] = set()
        self.odd: set[str] = set()
        self.n_words = self.n_exact = 0

    def _odd(self, text: str) -> bool:
        """Whether a text has a character that the library's word cutter classes otherwise than `regex` does."""
        here = set(text)
        if not here <= self.seen:
            if self.cutter is None:
                from tokenizers import Tokenizer

                self.cutter = Tokenizer.from_file(self.path).pre_tokenizer
            for c in here - self.seen:
                probe = f"a{c}{c}1{c} {c}"
                if [(m.start(), m.end()) for m in self.words.finditer(probe)] != [tuple(o) for _, o in self.cutter.pre_tokenize_str(probe)]:
                    self.odd.add(c)
            self.seen |= here
        return bool(self.odd) and not here.isdisjoint(self.odd)

    # Exact merging.

    def merged(self, word: bytes) -> list[int]:
        """Merge by rank, the leftmost first; a heap and links, so n log n for long words."""
        ids = [self.one[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        get = self.merge.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or not alive[i] or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], new, m[1]))
        return [t for t, ok in zip(ids, alive) if ok]

    # Speculation and verification.

    def proposed(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        get, longest = self.proposable.get, self.longest
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                if (t := get(word[i:j])) is not None:
                    break
            out.append(t)
            i = j
        return out

    def _trie(self) -> tuple[Lookup, np.ndarray]:
        """The vocabulary's beginnings as nodes: the one that follows node and byte, and the id that ends at each, or -1."""
        child: dict[int, int] = {}
        token, self.trie_of = [-1], {}
        for entry, i in self.proposable.items():
            node = 0
            for b in entry:
                if (after := child.get(node << 8 | b)) is None:
                    after = child[node << 8 | b] = len(token)
                    token.append(-1)
                node = after
            token[node] = i
            if len(entry) == 1:
                self.trie_of[entry] = node
        return Lookup(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child))), np.array(token, np.int64)

    def propose(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`proposed` for all words that lie one after the other in data: ids, and how many each word has."""
        place, end, rounds, counts = at[:-1].copy(), at[1:], [], np.zeros(len(at) - 1, np.int64)
        long = np.flatnonzero(np.diff(at) > LONG_PIECE)
        far = {i: self.proposed(data[at[i] : at[i + 1]].tobytes()) for i in long.tolist()}
        counts[long] = [len(far[i]) for i in long.tolist()]
        words = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) <= LONG_PIECE))
        place, end = place[words], end[words]
        while len(words):
            node = self.root[data[place]]
            best, size = self.token[node], np.ones(len(words), np.int64)
            live, depth = np.arange(len(words)), 1
            while len(live):
                more = place[live] + depth < end[live]
                live, node = live[more], node[more]
                after = self.trie(node << 8 | data[place[live] + depth])
                more = after >= 0
                live, node, depth = live[more], after[more].astype(np.int64), depth + 1
                found = self.token[node]
                whole = found >= 0
                best[live[whole]], size[live[whole]] = found[whole], depth
            rounds.append((words, best))
            counts[words] += 1
            place = place + size
            more = place < end
            words, place, end = words[more], place[more], end[more]
        first = borders_of(counts)
        ids = np.empty(first[-1], np.int64)
        for k, (words, best) in enumerate(rounds):
            ids[first[words] + k] = best
        for i, found in far.items():
            ids[first[i] : first[i + 1]] = found
        return ids, counts

    def merge_all(self, data: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merged` for some of the words that lie in data: ids, and how many each of them has."""
        begin, sizes = at[:-1][words], np.diff(at)[words]
        counts, parts, low = np.zeros(len(words), np.int64), [], 0
        for width in WIDTHS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(mine):
                columns = np.arange(width)
                inside = columns < sizes[mine][:, None]
                rows = self._merged_rows(np.where(inside, data[np.where(inside, begin[mine][:, None] + columns, 0)], 0), sizes[mine])
                counts[mine] = (rows >= 0).sum(axis=1)
                parts.append((mine, rows[rows >= 0]))
            low = width
        for i in np.flatnonzero(sizes > low).tolist():
            found = self.merged(data[begin[i] : begin[i] + sizes[i]].tobytes())
            counts[i] = len(found)
            parts.append((np.array([i]), np.array(found)))
        ids = np.empty(int(counts.sum()), np.int64)
        first = borders_of(counts)[:-1]
        for mine, found in parts:
            ids[spread(first[mine], counts[mine])] = found
        return ids, counts

    def _merged_rows(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of words in rows of bytes, then -1. A round merges the pair of least rank, the leftmost first, of every word."""
        m, width = raw.shape
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], np.array(self.one, np.int32)[raw], np.int32(-1))
        rank = np.full((m, width), NONE, np.int32)
        rank[:, :-1] = np.where(columns[1:] < sizes[:, None], self.bytes_rank[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], NONE)
        out, rows = np.empty_like(ids), np.arange(m)
        while len(rows):
            j = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), j]
            more = least < NONE
            if not more.all():
                out[rows[~more]] = ids[~more]
                rows, ids, rank, j, least = rows[more], ids[more], rank[more], j[more], least[more]
            here, new = np.arange(len(rows)), self.makes[least]
            # What follows the merged pair moves up.
            later = columns[:-1] > j[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[here, j] = new
            rank[here, j] = self._ranks(new, ids[here, np.minimum(j + 1, width - 1)])
            second = np.flatnonzero(j > 0)
            rank[second, j[second] - 1] = self._ranks(ids[second, j[second] - 1], new[second])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.rank(a.astype(np.int64) * self.size + b)
        return np.where((found < 0) | (b < 0), NONE, found)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together yields a and b again; arrays of ids."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = (self.keys[at] == key) & (self.made[at] < limit) if len(self.keys) else np.zeros(len(a), bool)
            ok[live[hit]] = False
            # Take apart the token that was made later; a single byte can't be, then the other one is.
            first = a > b
            part_a, part_b = self.second[a], self.first[b]
            can_a, can_b = part_a != a, part_b != b
            use_a = np.where(first, can_a, ~can_b & can_a)
            use_b = ~use_a & can_b
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            na, nb = np.where(use_a, part_a, a), np.where(use_b, part_b, b)
            keep = ~hit & (use_a | use_b)
            live, a, b, limit = live[keep], na[keep], nb[keep], limit[keep]
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        ids, counts = self.encode_all(np.frombuffer(b"".join(words), np.uint8), borders_of(np.fromiter(map(len, words), np.int64, len(words))))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if words else []

    def encode_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie one after the other in data, and how many each has."""
        n = len(at) - 1
        self.n_words += n
        if not self.ordered:
            self.n_exact += n
            return self.merge_all(data, at, np.arange(n))
        ids, counts = self.propose(data, at)
        if not len(ids):
            return ids, counts
        word = np.repeat(np.arange(n), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, where = np.unique(ids[inside] * self.size + ids[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        wrong = np.zeros(n, bool)
        wrong[word[inside[~good[where]]]] = True
        words = np.flatnonzero(wrong)
        self.n_exact += len(words)
        exact, sizes = self.merge_all(data, at, words)
        kept = ids[~wrong[word]]
        counts[words] = sizes
        first, right = borders_of(counts)[:-1], np.flatnonzero(~wrong)
        out = np.empty(int(counts.sum()), np.int64)
        out[spread(first[right], counts[right])] = kept
        out[spread(first[words], sizes)] = exact
        return out, counts

    # Pieces and texts.

    def words_of(self, text: str) -> list[bytes]:
        if not text.isascii() and self._odd(text):
            return [text[s:e].encode() for _, (s, e) in self.cutter.pre_tokenize_str(text)]
        return [w.encode() for w in self.words.findall(text)]

    def _classes(self, chars: np.ndarray) -> np.ndarray:
        found = self.classes[chars]
        if (new := np.unique(chars[found == UNKNOWN])).size:
            for c in map(chr, new.tolist()):
                rare = c == "'" or not c.isascii() and self._odd(c)
                self.classes[ord(c)] = RARE if rare else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else BLANK if regex.match(r"\s", c) else OTHER
            found = self.classes[chars]
        return found

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        n = len(pieces)
        data, at = bytes_of(pieces)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self._classes(chars)
        borders = np.searchsorted(place, at)
        piece = np.repeat(np.arange(n), np.diff(borders))
        first = np.zeros(len(chars), bool)
        first[borders[:-1][np.diff(borders) > 0]] = True
        space = chars == 32
        changed, before = np.ones(len(chars), bool), np.zeros(len(chars), bool)
        changed[1:] = kind[1:] != kind[:-1]
        before[1:] = (first & space)[:-1]
        rare = (kind == RARE) | (~first & (space | ((kind == BLANK) & ~changed)))
        slow = np.zeros(n, bool)
        slow[piece[rare]] = True
        for s in self.special:
            slow |= pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        # A word begins where a piece does or the class changes, but for a space at the start, which belongs to what follows.
        begin = np.flatnonzero(first | (changed & ~before))
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(place[begin], len(data)).astype(np.int32)), pa.py_buffer(data)])
        of = piece[begin]
        if slow.any():
            words, of = words.filter(pa.array(~slow[of])), of[~slow[of]]
        counts = np.bincount(of, minlength=n)
        others, parts = [], []
        for i in np.flatnonzero(slow).tolist():
            here = len(parts)
            text = data[at[i] : at[i + 1]].tobytes().decode()
            for k, seg in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
                if k % 2:
                    parts.append(-1 - self.special[seg])
                elif seg:
                    cut = self.words_of(seg)
                    parts += range(len(others), len(others) + len(cut))
                    others += cut
            counts[i] = len(parts) - here
        coded = pa.concat_arrays([words, pa.array(others, pa.binary())]).dictionary_encode()
        ids, sizes = self.encode_all(*bytes_of(coded.dictionary))
        # Each special id as one more word; then the words of the pieces in order, those of slow ones last.
        specials = sorted(set(self.special.values()))
        ids, sizes = np.append(ids, specials).astype(np.uint32), np.append(sizes, np.ones(len(specials), np.int64))
        codes, n_words = coded.indices.to_numpy(), len(coded.dictionary)
        tail = [codes[len(words) + p] if p >= 0 else n_words + specials.index(-1 - p) for p in parts]
        codes = np.append(codes[: len(words)], np.array(tail, np.int64)).astype(np.int64)
        flat = ids[spread(borders_of(sizes)[:-1][codes], sizes[codes])]
        order = np.concatenate([np.flatnonzero(~slow), np.flatnonzero(slow)])
        ends = borders_of(sizes[codes])
        stops = borders_of(counts[order])
        lens = np.empty(n, np.int64)
        lens[order] = ends[stops[1:]] - ends[stops[:-1]]
        if slow.any():
            start = np.empty(n, np.int64)
            start[order] = ends[stops[:-1]]
            flat = flat[spread(start, lens)]
        return flat, lens

    def _known(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of these distinct pieces begin and how many they are; the cache has them from now on."""
        at = pc.index_in(keys, value_set=self.pieces)
        new = pc.is_null(at)
        fresh = keys.filter(new)
        found, lens = self._encoded(fresh) if len(fresh) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        n_held = len(self.pieces)
        ids, sizes = np.concatenate([self.ids, found]), np.concatenate([self.sizes, lens])
        first = borders_of(sizes)[:-1]
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        at[new.to_numpy(zero_copy_only=False)] = n_held + np.arange(len(fresh))
        if n_held + len(fresh) <= CACHE:
            short = pc.less_equal(pc.binary_length(fresh), LONG_PIECE).to_numpy(zero_copy_only=False)
            held = np.append(np.ones(n_held, bool), short)
            self.pieces = pa.concat_arrays([self.pieces, fresh.filter(pa.array(short))])
        else:
            short = pc.less_equal(pc.binary_length(keys), LONG_PIECE).to_numpy(zero_copy_only=False)
            held = at[short]
            self.pieces = keys.filter(pa.array(short))
        if isinstance(held, np.ndarray) and held.dtype == bool and held.all():
            self.ids, self.sizes = ids, sizes
        else:
            self.ids, self.sizes = ids[spread(first[held], sizes[held])], sizes[held]
        return ids, first[at], sizes[at]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin and the last ones end.

        Pieces are cut and numbered by Arrow, so each distinct one of a batch is looked for once, and ids are gathered by numbers.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        hard = pc.match_substring_regex(texts, UNSAFE)
        cut = pc.split_pattern(texts.filter(pc.invert(hard)), " ")
        borders, values = cut.offsets.to_numpy().astype(np.int64), cut.values
        rest = np.ones(len(values), bool)
        heads = [values.take(pa.array(borders[:-1]))]
        rest[borders[:-1]] = False
        values, counts = [values.filter(pa.array(rest))], [np.diff(borders) - 1]
        hard = hard.to_numpy(zero_copy_only=False)
        if hard.any():
            parts = [CUT.split(t) for t in texts.filter(pa.array(hard)).to_pylist()]
            heads.append(pa.array([p[0] for p in parts], pa.string()))
            values.append(pa.array([x for p in parts for x in p[1:]], pa.string()))
            counts.append(np.array([len(p) - 1 for p in parts], np.int64))
        # Every text's first piece, and the others without the space that each begins with; texts with hard borders are last.
        first, column = pa.concat_arrays(heads).dictionary_encode(), pa.concat_arrays(values).dictionary_encode()
        count = np.concatenate(counts)
        named = pc.binary_join_element_wise(" ", column.dictionary, "")
        ids, place, sizes = self._known(pa.concat_arrays([named, first.dictionary]))
        stops = borders_of(count + 1)
        codes = np.empty(stops[-1], np.int64)
        head = np.zeros(len(codes), bool)
        head[stops[:-1]] = True
        codes[head], codes[~head] = first.indices.to_numpy().astype(np.int64) + len(named), column.indices.to_numpy()
        if hard.any():
            order = np.empty(len(texts), np.int64)
            order[np.concatenate([np.flatnonzero(~hard), np.flatnonzero(hard)])] = np.arange(len(texts))
            codes = codes[spread(stops[:-1][order], count[order] + 1)]
            stops = borders_of(count[order] + 1)
        sizes = sizes[codes]
        return ids[spread(place[codes], sizes)], borders_of(sizes)[stops]

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, ends = self.encode_texts(pa.array(texts, pa.string()))
        ids, ends = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
        return [bytes(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def forget(self) -> None:
        """Drops the pieces that are held: a worker outlives its task, and idle ones shouldn't keep what they knew."""
        self.pieces, self.ids, self.sizes = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8."""
        return utf8(b"".join([self.bytes[i] for i in ids]))


def utf8(raw: bytes) -> bytes:
    """Bytes that are no UTF-8 become replacement characters, as in the library."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()


@lru_cache(maxsize=4)
def encoder(path: str | None) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: array<int> of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in e.encode_batch(b["text"])]})
        e.forget()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [e.decode([] if i is None else list(i)).decode() for i in b["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids, ends = e.encode_texts(b.column("text"))
            numbers, written = bytes_of(e.numbers.take(pa.array(ids)))
            raw, said = bytes_of(e.binary.take(pa.array(ids)))
            n, a, d = np.diff(ends), [], []
            for k, m, i, j in zip(written[ends[:-1]].tolist(), written[ends[1:]].tolist(), said[ends[:-1]].tolist(), said[ends[1:]].tolist()):
                a.append(hashlib.sha256(numbers[k : max(k, m - 1)]).hexdigest())
                d.append(hashlib.sha256(utf8(raw[i:j].tobytes())).hexdigest())
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
