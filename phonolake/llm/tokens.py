"""Token ids by the public tokenizers, each distinct unit of text being encoded once in a worker.

A unit is a stretch of text at whose ends the tokenizer's own pre-tokenizer always cuts, so that joining the ids
of the units gives the ids of the whole text. Both patterns below are tested against whole-text encoding.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import hold

# White space as Unicode defines it (fixed values).
_WS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts with a character of these kinds are cut by the patterns below, others by plain splitting, to the same units.
_ODD = re.compile("[\x00\x1c-\x1f]")
_ODD_SPACED = re.compile(rf"[\x00{_WS.replace(' ', '').replace(chr(10), '')}]")
_GAPS = ("  ", " \n", "\n ", "\n\n")
#: Words between white space, for tokenizers that drop white space.
WORDS = rf"[^{_WS}]+"
#: A word with at most one space before it, else white space, for byte-level tokenizers that keep it.
SPACED_WORDS = rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Units that each of the two generations of an encoder holds, at most, about.
MAX_UNITS = 400_000
_encoders: dict[tuple[str, str], Encoder] = {}


# Units of this kind are encoded many at once: one run of letters, then at most one run of marks.
_PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([.,;:!?|$*&%#]*)")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Known units are held in two generations of at most max_units each, so that frequent ones stay and memory is
    bounded.
    """

    def __init__(self, path: str, pattern: str, max_units: int = MAX_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.find, self.max_units, self.known, self.older = re.compile(pattern).findall, max_units, {}, {}
        self.spaced = pattern == SPACED_WORDS
        self.odd = _ODD_SPACED if self.spaced else _ODD
        edge = [False] * (1 + max(self.tokenizer.get_vocab().values()))
        for token, k in self.tokenizer.get_vocab().items():
            edge[k] = token.startswith("\u0120") if self.spaced else token.endswith("</w>")
        self.edge = np.array(edge)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.spaced and len(line) == 1 else None

    def _units(self, text: str) -> list[str]:
        """Keys of a text's units. Where spaces count, a mark stands before the unit itself; a key without it is a word and the space before it."""
        if self.odd.search(text) or (self.spaced and text and (text[0] in " \n" or text[-1] in " \n" or any(g in text for g in _GAPS))):
            units = self.find(text)
            return [f"\0{u}" for u in units] if self.spaced else units
        if not self.spaced:
            return text.split()
        return f"\0{text}".replace("\n", " \0\n \0").split(" ") if text else []

    def _together(self, units: list[str], edges: list[int]) -> list[bytes] | None:
        """Ids of plain units by one call; a unit ends before a token that begins with a space, or with its last word-end token."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units) if self.spaced else " ".join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != sum(edges):
            return None
        cuts = [*at.tolist(), len(ids)] if self.spaced else [0, *(at[np.cumsum(edges) - 1] + 1).tolist()]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _by_line(self, units: list[str]) -> list[bytes] | None:
        """Ids of plain units without a space before them by one call, each on a line."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == self.line)
        if len(at) != len(units) - 1:
            return None
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)]

    def _learn(self, new: list[str]) -> None:
        plain, edges, marked, rest = [], [], [], []
        for u in new:
            m = _PLAIN.fullmatch(u)
            if m:
                plain.append(u)
                edges.append(1 if self.spaced or not m[1] else 2)
            elif self.line is not None and u[:1] == "\0" and _PLAIN.fullmatch(u, 1):
                marked.append(u)
            else:
                rest.append(u)
        for i in range(0, len(marked), 400):
            part = marked[i : i + 400]
            got = self._by_line([u[1:] for u in part])
            if got is None:
                rest += part
            else:
                self.known.update(zip(part, got, strict=True))
        for i in range(0, len(plain), 400):
            part = plain[i : i + 400]
            got = self._together([f" {u}" for u in part] if self.spaced else part, edges[i : i + 400])
            if got is None:
                rest += part
            else:
                self.known.update(zip(part, got, strict=True))
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            texts = [u[1:] if u[0] == "\0" else f" {u}" for u in part] if self.spaced else part
            for u, e in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.known[u] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            units = [self._units(t) for t in texts[i : i + 256]]
            if len(self.known) > self.max_units:
                self.older, self.known = self.known, {}
            new = []
            for u in set().union(*units).difference(self.known):
                if (ids := self.older.get(u)) is None:
                    new.append(u)
                else:
                    self.known[u] = ids
            self._learn(new)
            out += [b"".join(map(self.known.__getitem__, us)) for us in units]
        return out


def encoder(path: str, pattern: str, max_units: int = MAX_UNITS) -> Encoder:
    """The worker's own encoder, kept from task to task; one that held more units goes."""
    hold("tokens", _encoders.clear)
    e = _encoders.get((path, pattern))
    if e is None or e.max_units != max_units:
        _encoders[path, pattern] = e = Encoder(path, pattern, max_units)
    return e


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
