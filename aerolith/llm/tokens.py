"""Token ids of whole texts by a tokenizer file, each distinct part encoded once.

Where the file's rules allow it, a shard's texts are cut at places that no token can cross:
before a single space, around a single line feed, and between a letter and an ASCII mark.
Parts are hashed with numpy; the tokenizer sees only parts that are not in the table of
known ones yet, many joined in one text. Other files, and texts with white space other
than ASCII's, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import words

#: Parts in the table before it is emptied, and the longest part that is kept (bytes).
TABLE_PARTS = 1_000_000
LONGEST_PART = 64
#: New parts that are encoded as one text.
JOINED_PARTS = 128
#: Good sizes of the shards that encode() gets (bytes of text).
SHARD_BYTES = 1 << 20
#: White space outside ASCII.
_RARE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = "\x01"
_WHITE = ~words.NON_SPACE
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes, after 0xC3, of characters that are no letters.
_NO_LETTER = (0x97, 0xB7)


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where parts begin; each text's line feed at its end is a part of its own."""
    white = _WHITE[data]
    seen = ~white
    before, after = np.append(False, seen[:-1]), np.append(seen[1:], False)
    alone = white & before & after
    feed = alone & (data == 0x0A)
    out = feed | (alone & (data == 0x20))
    out[1:] |= feed[:-1]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & ~np.isin(data[1:], _NO_LETTER)
    letter = _LETTER[data] | latin
    out[1:] |= _PUNCT[data[1:]] & letter[:-1]
    out[begins[:-1]] = True
    out[begins[1:] - 1] = True
    return np.flatnonzero(out)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
        steps = [x.get("type") for x in normal.get("normalizers", [])]
        self.cut = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
            if len(feed) == 1:
                self.cut, self.feed = "before space", feed[0]
                self.begins = np.zeros(self.vocab_size + 1, bool)
                self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        elif steps == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
            if len(mark) == 1:
                self.cut, self.mark = "space dropped", mark[0]
        self._empty()

    def _empty(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str], join) -> list[np.ndarray]:
        """Ids of parts, JOINED_PARTS in a text; join makes it and finds the bounds in its ids."""
        groups = [parts[i : i + JOINED_PARTS] for i in range(0, len(parts), JOINED_PARTS)]
        out = []
        for g, ids in zip(groups, self._whole([join(g, None) for g in groups]), strict=True):
            lo, hi = join(g, ids)
            out += [ids[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)] if len(lo) == len(g) else self._whole(g)
        return out

    def _by_space(self, g: list[str], ids: np.ndarray | None):
        if ids is None:
            return "".join(g)
        lo = np.flatnonzero(self.begins[ids])
        return lo, np.append(lo[1:], len(ids))

    def _by_feed(self, g: list[str], ids: np.ndarray | None):
        if ids is None:
            return "\n".join(g)
        hi = np.append(np.flatnonzero(ids == self.feed), len(ids))
        return np.append(0, hi[:-1] + 1), hi

    def _by_mark(self, g: list[str], ids: np.ndarray | None):
        if ids is None:
            return f" {_MARK} ".join(g)
        hi = np.append(np.flatnonzero(ids == self.mark), len(ids))
        return np.append(0, hi[:-1] + 1), hi

    def _new(self, parts: list[str]) -> list[np.ndarray]:
        kind = np.zeros(len(parts), np.int8)
        for i, x in enumerate(parts):
            body = x[1:] if x[:1] == " " else x
            if _MARK not in x and body and not any(c.isspace() for c in body):
                kind[i] = 3 if self.cut == "space dropped" else 1 if body is not x else 2
        out: list = [None] * len(parts)
        for k, encode in enumerate((self._whole, lambda p: self._joined(p, self._by_space), lambda p: self._joined(p, self._by_feed), lambda p: self._joined(p, self._by_mark))):
            own = np.flatnonzero(kind == k).tolist()
            if own:
                for i, ids in zip(own, encode([parts[i] for i in own]), strict=True):
                    out[i] = ids
        return out

    def _keep(self, first: np.ndarray, second: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        at = self.used + np.cumsum(size) - size
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        place = np.searchsorted(self.first, first)
        self.first, self.second = np.insert(self.first, place, first), np.insert(self.second, place, second)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        whole = {i for i, t in enumerate(texts) if t and (self.cut is None or not t.isascii() and any(c in t for c in _RARE))}
        apart = dict(zip(sorted(whole), self._whole([texts[i] for i in sorted(whole)]), strict=True))
        data, begins = words.joined(["" if i in whole else t for i, t in enumerate(texts)])
        start = cuts(data, begins)
        end = np.append(start[1:], len(data))
        real = np.ones(len(start), bool)
        real[np.searchsorted(start, begins[1:] - 1)] = False
        start, end = start[real], end[real]
        bound = np.searchsorted(start, begins)
        if len(self.first) > TABLE_PARTS:
            self._empty()
        h = words.hashes(data, start, end, words.TABLE)
        unique, sample, back = np.unique(h, return_index=True, return_inverse=True)
        by = np.argsort(sample)
        second = np.empty(len(unique), np.uint64)
        second[by] = words.hashes(data, start[sample[by]], end[sample[by]], words.SECOND)
        place = np.minimum(np.searchsorted(self.first, unique), max(len(self.first) - 1, 0))
        known = (self.first[place] == unique) & (self.second[place] == second) if len(self.first) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        taken = (self.first[place[new]] == unique[new]) if len(self.first) else np.zeros(len(new), bool)
        raw = data.tobytes()
        ids = self._new([raw[a:b].decode() for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)])
        short = (end - start)[sample[new]] <= LONGEST_PART
        stay = np.flatnonzero(short & ~taken)
        self._keep(unique[new[stay]], second[new[stay]], [ids[i] for i in stay.tolist()])
        # this shard's own table: kept parts by place, the others behind the kept ids
        place = np.minimum(np.searchsorted(self.first, unique), max(len(self.first) - 1, 0))
        at, size = (self.at[place], self.size[place]) if len(self.first) else (np.zeros(len(unique), np.int64),) * 2
        pool = self.ids
        rest = np.flatnonzero(~short | taken).tolist()
        if rest:
            at, size = at.copy(), size.copy()
            extra = [ids[i] for i in rest]
            size[new[rest]] = [len(x) for x in extra]
            at[new[rest]] = self.used + np.cumsum([0, *map(len, extra)])[:-1]
            pool = np.concatenate([self.ids[: self.used], *extra])
        n = size[back]
        ends = np.cumsum(n)
        flat = pool[np.repeat(at[back] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edge = (4 * np.append(0, ends)[bound]).tolist()
        return [apart[i].tobytes() if i in apart else flat[edge[i] : edge[i + 1]] for i in range(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
