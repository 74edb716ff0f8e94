"""The part that token counts and SentencePiece share: a table of the last token of every prefix.

In a byte-pair encoding whose tokens come of pairwise merges, a sequence of tokens is what the encoder
makes of their text exactly if it makes each adjacent pair of theirs. So every prefix of a text has one
last token: the automaton's match ending there that is compatible with the last token of the prefix
before it. The table takes one pass; ids come out of it backwards, counts forwards.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick

#: Pairs of tokens whose test a worker keeps; it starts anew beyond that.
MAX_PAIRS = 1_000_000
#: Longer strings than this have their table in packed integers.
PACKED = 1 << 16
#: Code points of a text that are looked at together, about: a long text is cut before a space.
PIECE = 1 << 18
#: Bytes that a cache holds in each of its two generations, with ENTRY for an entry besides its texts; longer strings than LONG are not kept.
CACHE_BYTES, ENTRY, LONG = 40 << 20, 120, 64

_CUT = re.compile("(?<=[0-9A-Za-z]) ")


def cut(text: str) -> Iterator[str]:
    """The text in pieces that begin with a space after a letter or digit: no word crosses them."""
    at = 0
    while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Kept(dict):
    """What a function gives for short strings, in two generations that are bounded in bytes: those of late, and those before them that come up again."""

    def __init__(self, make: Callable):
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, s: str):
        if (got := self.old.get(s)) is None:
            got = self.make(s)
        if len(s) <= LONG:
            if self.held > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += ENTRY + (len(s) if s.isascii() else 4 * len(s)) + (len(got) + 33 if isinstance(got, bytes) else 0)
            self[s] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


NEVER = float("inf")


def derivation(symbols: list[int], priority: Callable[[int, int], tuple[float, int] | None]) -> tuple[list[int], list[tuple[float, int, int]]]:
    """The encoder on a few symbols: always the merge of the lowest priority, the leftmost among equals.

    Returns the tokens, and for each merge its priority and the first and last token after it.
    """
    ids, steps = list(symbols), []
    while True:
        found = [(m[0], k, m[1]) for k in range(len(ids) - 1) if (m := priority(ids[k], ids[k + 1]))]
        if not found:
            return ids, steps
        p, k, merged = min(found)
        ids[k : k + 2] = [merged]
        steps.append((p, ids[0], ids[-1]))


class PrefixTable:
    """tokens: text -> id. symbols(text) gives the ids that the encoder starts from, priority(a, b) the
    merge of two tokens: its priority (lower goes first) and the token it makes, or None.

    Only tokens that the encoder yields for their own text take part. `unknown` is the id of a symbol that
    no token holds (None: there is none, every symbol is a token).
    """

    def __init__(self, tokens: dict[str, int], symbols: Callable[[str], list[int]], priority: Callable[[int, int], tuple[float, int] | None], unknown: int | None = None):
        self.priority, self.unknown = priority, unknown
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.firsts: dict[int, list[tuple[float, int]]] = {}
        self.lasts: dict[int, list[tuple[float, int]]] = {}
        for text, i in tokens.items():
            start = symbols(text)
            ids, steps = derivation(start, priority)
            if ids == [i]:
                self.automaton.add_word(text, (i, len(text)))
                self.firsts[i] = [(p, before) for p, before in zip([*(s[0] for s in steps), NEVER], [start[0], *(s[1] for s in steps)], strict=True)]
                self.lasts[i] = [(p, before) for p, before in zip([*(s[0] for s in steps), NEVER], [start[-1], *(s[2] for s in steps)], strict=True)]
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoder makes [a, b] of the text of a and b. Kept under a * 2**20 + b.

        Until something merges across the border, each side goes through its own derivation; so it is
        enough to follow both, always the next merge of the lower priority, and see whether at some time
        the tokens at the border merge before either.
        """
        if a == self.unknown or b == self.unknown:
            return True
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        left, right, priority, i, j = self.lasts[a], self.firsts[b], self.priority, 0, 0
        fits = True
        while fits:
            (p, x), (q, y) = left[i], right[j]
            if (m := priority(x, y)) and m[0] < p and m[0] <= q:
                fits = False
            elif p == q == NEVER:
                break
            elif p <= q:
                i += 1
            else:
                j += 1
        self.pairs[a << 20 | b] = fits
        return fits

    def last_tokens(self, s: str):
        """Of each prefix s[:i]: its last token, and that token's length (at 0: -1, 0)."""
        whole = (lambda x: array("i", [x])) if len(s) > PACKED else (lambda x: [x])
        last, size = whole(-1) * (len(s) + 1), whole(0) * (len(s) + 1)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(s):
            end += 1
            if size[end]:
                continue
            if start := end - n:
                if not size[start]:
                    self._fill(s, start, last, size)
                before = last[start]
                if (fits := pairs.get(before << 20 | token)) is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, n
        self._fill(s, len(s), last, size)
        return last, size

    def _fill(self, s: str, end: int, last: list[int], size: list[int]) -> None:
        """Symbols up to end that stand in no token."""
        while end and not size[end]:
            if self.unknown is None:
                raise ValueError(f"no token for {s[end - 1]!r}")
            last[end], size[end] = self.unknown, 1
            end -= 1

    def encode(self, s: str) -> list[int]:
        """Ids of s, recovered from the last prefix backwards; an unknown symbol gives `unknown`."""
        last, size = self.last_tokens(s)
        ids, i = [], len(s)
        while i:
            ids.append(last[i])
            i -= size[i]
        return ids[::-1]

    def count(self, s: str) -> int:
        """The number of tokens of s."""
        _, size = self.last_tokens(s)
        n, i = 0, len(s)
        while i:
            n, i = n + 1, i - size[i]
        return n

    def counts(self, s: str):
        """The number of tokens of every prefix of s, the empty one first."""
        _, size = self.last_tokens(s)
        out = (array("i", [0]) if len(s) > PACKED else [0]) * (len(s) + 1)
        for i in range(1, len(s) + 1):
            out[i] = out[i - size[i]] + 1
        return out
