"""Token ids of a public byte-level BPE vocabulary, with a word cache.

Most texts are cut into the vocabulary's pre-tokens by vectorised class runs; each distinct pre-token is encoded
once per worker (the cache holds ``CACHE`` of them at most). Texts with other characters go through the
library as a whole, and texts that hold a special token's string through the tokenizer file itself.
"""

from __future__ import annotations

import base64
import itertools
import json

import numpy as np

from doselab.llm import textnp as tx

CACHE = 200_000
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x20, 0x0A]] = _SPACE
_PLAIN = np.zeros(256, bool)
_PLAIN[0x20:0x7F] = _PLAIN[0x0A] = _PLAIN[0xC3] = _PLAIN[0x80:0xC0] = True
_PLAIN[0x27] = False
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True
_SIGN = np.zeros(256, bool)
_SIGN[[0x97, 0xB7]] = True


def plain_rows(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ASCII (no controls but newline, no apostrophe) and the letters U+00C0 to U+00FF only."""
    bad = ~_PLAIN[buf]
    follows = _FOLLOWS[buf]
    lead = np.zeros(len(buf), bool)
    lead[1:] = buf[:-1] == 0xC3
    bad |= follows != lead
    bad |= follows & _SIGN[buf]
    return tx.counts_between(np.flatnonzero(bad), offsets) == 0


def pre_tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain rows: runs of letters, digits or signs, with one space before."""
    kind = _CLASS[buf]
    flag = np.ones(len(buf), bool)
    flag[1:] = kind[1:] != kind[:-1]
    row_start = np.zeros(len(buf) + 1, bool)
    row_start[offsets] = True
    flag |= row_start[:-1]
    # A white-space run gives its last character away: a space to the run that follows, a newline to itself.
    after = np.flatnonzero(flag & (kind != _SPACE) & ~row_start[:-1])
    after = after[kind[after - 1] == _SPACE]
    flag[after - 1] = True
    flag[after[buf[after - 1] == 0x20]] = False
    starts = np.flatnonzero(flag)
    return starts, np.append(starts[1:], len(buf))


class Encoder:
    """path: tokenizer file; ranks and pattern: the same vocabulary as merge ranks, for the library that is faster."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.args = (path, ranks, pattern)
        self.ready = False

    def __getstate__(self):
        return {"args": self.args, "ready": False}

    def _open(self) -> None:
        path, ranks, pattern = self.args
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        self._full, self.fast = None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self._forget()
        self.ready = True

    @property
    def full(self):
        """The tokenizer file itself, opened where a text asks for it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.args[0])
        return self._full

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.size = np.zeros(1 << 12, np.int64)
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        """Encode new pre-tokens."""
        encode = self.fast._core_bpe.encode_single_piece
        found = [encode(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
        k = len(self.slot)
        while k + len(keys) > len(self.size):
            self.size, self.at = np.concatenate([self.size, self.size]), np.concatenate([self.at, self.at])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.size[k : k + len(keys)] = size
        self.at[k : k + len(keys)] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(keys, range(k, k + len(keys)), strict=True))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        if not self.ready:
            self._open()
        n = len(offsets) - 1
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        raw = buf.tobytes()
        plain = plain_rows(buf, offsets) if self.fast else np.zeros(n, bool)
        if any(s in raw for s in self.special):
            plain &= [not any(s in raw[offsets[i] : offsets[i + 1]] for s in self.special) for i in range(n)]
        for i in np.flatnonzero(~plain).tolist():
            part = raw[offsets[i] : offsets[i + 1]]
            if self.fast and not any(s in part for s in self.special):
                out[i] = np.array(self.fast.encode_ordinary(part.decode()), np.uint32)
            else:
                out[i] = np.array(self.full.encode(part.decode(), add_special_tokens=False).ids, np.uint32)
        rows = np.flatnonzero(plain & (np.diff(offsets) > 0))
        if not len(rows):
            return out
        if len(rows) == n:
            own, bounds = buf, offsets
        else:
            own = np.concatenate([buf[offsets[i] : offsets[i + 1]] for i in rows.tolist()])
            bounds = np.concatenate([[0], np.cumsum(np.diff(offsets)[rows])])
        starts, ends = pre_tokens(own, bounds)
        keys, first, back = np.unique(tx.hash_runs(own, starts, ends), return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > CACHE:
            self._forget()
        listed = keys.tolist()
        slots = np.fromiter((-1 if k is None else k for k in map(self.slot.get, listed)), np.int64, len(listed))
        new = np.flatnonzero(slots < 0)
        if len(new):
            text = own.tobytes()
            at = first[new]
            base = len(self.slot)
            self._learn([listed[j] for j in new.tolist()], [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slots[new] = base + np.arange(len(new))
        slots = slots[back]
        size = self.size[slots]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[slots] - sums[:-1], size) + np.arange(sums[-1])]
        edges = sums[np.searchsorted(starts, bounds)]
        for k, i in enumerate(rows.tolist()):
            out[i] = ids[edges[k] : edges[k + 1]]
        return out
