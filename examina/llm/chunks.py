"""Cutting texts at spaces where a byte-level BPE tokenizer cuts too.

Such a tokenizer first cuts a text into pieces; a piece never runs past a space that
follows a non-space or precedes one. Between such spaces a text can be encoded chunk by
chunk, and most chunks are words seen before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: The Unicode characters with the White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_UNSAFE = re.compile(f"[{SPACES}] (?:[{SPACES}]|$)")
_SAFE_CUT = re.compile(f"(?<=[^{SPACES}]) | (?=[^{SPACES}])")


def chunks(text: str) -> list[str]:
    """The text cut before every space that is a safe cut; every chunk but the first
    lacks the space that stands before it."""
    if _UNSAFE.search(text):
        return _SAFE_CUT.split(text)
    return text.split(" ")


class _Index(dict):
    """Numbers chunks as they come. What exceeds the capacity is numbered for one batch only."""

    def __init__(self, capacity: int):
        super().__init__()
        self.capacity, self.known, self.pending, self.extra = capacity, 0, [], {}

    def __missing__(self, chunk: str) -> int:
        i = self.extra.get(chunk)
        if i is None:
            i = self.known + len(self.pending)
            self.pending.append(chunk)
            (self if len(self) < self.capacity else self.extra).__setitem__(chunk, i)
        return i


class ChunkEncoder:
    """Encodes texts through a bounded cache of chunks.

    encode gets distinct strings and returns the little-endian uint32 ids of each as
    bytes. What no longer fits in the cache is encoded anew in every batch that has it,
    so results don't depend on the cache. special: strings that are one id wherever they
    stand, as bytes.
    """

    #: Characters that, after a letter, begin a piece which runs to the chunk's end if only these follow.
    TAIL = ".,;:!?*#%$&|()"

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: dict[str, bytes], capacity: int = 450_000):
        self.encode, self.special, self.capacity = encode, special, capacity
        self.index, self.table = _Index(capacity), []
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def _parts(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        return self.cut.split(text)

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        number, heads = self.index.__getitem__, dict.fromkeys([])
        split = []
        for text in texts:
            own = []
            for part in self._parts(text):
                if part in self.special:
                    own.append((part, None))
                elif part:
                    head, *rest = chunks(part)
                    if head:
                        heads[head] = None
                    own.append((head, list(map(number, rest))))
            split.append(own)
        heads = self._single(self.heads, list(heads), self.capacity // 8)
        if self.index.pending:
            self._resolve()
        item, out = self.table.__getitem__, []
        for own in split:
            ids = []
            for head, rest in own:
                if rest is None:
                    ids.append(self.special[head])
                    continue
                if head:
                    ids.append(heads[head])
                ids += map(item, rest)
            out.append(b"".join(ids))
        if self.index.extra:
            self.index.extra.clear()
            del self.table[len(self.index):]
            self.index.known = len(self.table)
        return out

    def _single(self, known: dict[str, bytes], wanted: list[str], most: int) -> dict[str, bytes]:
        new = [w for w in wanted if w not in known]
        found = dict(zip(new, self.encode(new), strict=True)) if new else {}
        if len(known) + len(found) <= most:
            known.update(found)
        return {w: found[w] if w in found else known[w] for w in wanted}

    def _resolve(self) -> None:
        """Encodes the chunks that were numbered since the last batch."""
        index, base = self.index, self.index.known
        ended, plain = [], []
        for i, w in enumerate(index.pending):  # grows by stems
            stem = w.rstrip(self.TAIL)
            if len(stem) < len(w) and stem.isalpha():
                ended.append((base + i, index[stem], w[len(stem):]))
            else:
                plain.append((base + i, w))
        tails = self._single(self.tails, list({t for *_, t in ended}), self.capacity // 80)
        self.table += [b""] * len(index.pending)
        for (i, _), ids in zip(plain, self.encode([" " + w for _, w in plain]), strict=True):
            self.table[i] = ids
        for i, stem, tail in ended:
            self.table[i] = self.table[stem] + tails[tail]
        index.pending.clear()
        index.known = len(self.table)
