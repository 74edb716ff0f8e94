"""Token counts by prefix dynamic programming: exact counts at every prefix of every text.

A byte-level BPE file (tokenizers' .json with the usual split pattern) is loaded. Each piece of the
split has a table of token counts at all its prefixes (see prefix_tokens); a text adds its pieces up. So
`longest(budget)`, `count(i)` and cuts into windows read the table and encode nothing again. A worker
keeps the totals of short pieces within bounds in bytes; a long text is cut before spaces, so that its
pieces aren't held together.

Defined results: a null or empty text has 0 bytes and 0 tokens. Special strings inside a text are one
token each, as the tokenizers library takes them by default. Repeated rows are counted each for itself.
An empty table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memlake.llm import common as C
from memlake.llm.prefix_tokens import Kept, PrefixTable, cut

#: The pattern that splits text before the merges. A fixed value of this kind of file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks whose letters and digits the regex and the tokenizers library class alike, whatever Unicode
#: version each has. Texts with other characters are split by the library.
_OTHER = re.compile("[^\u0000-ԣ -⁯₠-₵℀-⅏←-⏧ぁ-ゖ゠-ヿ一-龥가-힣]")


class ByteBpe:
    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is asked for")
        to_byte = {c: chr(b) for b, c in _byte_letters().items()}
        raw = lambda s: "".join(map(to_byte.__getitem__, s))
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        rank = {(vocab[raw(a)], vocab[raw(b)]): (r, vocab[raw(a + b)]) for r, (a, b) in enumerate(merges)}
        self.table = PrefixTable(vocab, lambda s: [vocab[c] for c in s], lambda a, b: rank.get((a, b)))
        self.split = regex.compile(SPLIT)
        self.by_library = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.total = Kept(lambda piece: self.table.count(piece.encode().decode("latin-1"))).__getitem__

    def pieces(self, text: str) -> list[str]:
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.by_library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts at the code-point prefixes of one piece; an apostrophe's ending splits when cut."""
        counts = self.table.counts(piece.encode().decode("latin-1"))
        if piece.isascii():
            out = counts
        else:
            ends, n = [0], 0
            for c in piece:
                n += len(c.encode())
                ends.append(n)
            out = [counts[e] for e in ends]
        if piece in ("'re", "'ve", "'ll"):
            out[2] = 2
        return out

    def count(self, text: str) -> int:
        plain = lambda t: sum(sum(map(self.total, self.pieces(part))) for part in cut(t))
        if self.special is None or not (parts := self.special.split(text))[1:]:
            return plain(text)
        return len(parts) - 1 + sum(plain(p) for p in parts if p)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such files: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixCounts:
    """Exact token counts at every prefix of one text, held as the counts at its units' starts.

    A unit is a special string, or a piece of the split; white space goes with the piece after it, as a
    cut inside it changes how it splits.
    """

    def __init__(self, bpe: ByteBpe, text: str):
        self.bpe, self.text = bpe, text
        self.units: list[str] = []
        self.special: set[int] = set()
        at = 0
        for m in [*(bpe.special.finditer(text) if bpe.special else ()), None]:
            pending = ""
            for p in bpe.pieces(text[at : m.start() if m else len(text)]):
                pending += p
                if not p.isspace():
                    self.units.append(pending)
                    pending = ""
            if pending:
                self.units.append(pending)
            if m:
                self.special.add(len(self.units))
                self.units.append(m.group())
                at = m.end()
        self.starts, self.before, i, n = [], [], 0, 0
        for k, u in enumerate(self.units):
            self.starts.append(i)
            self.before.append(n)
            i += len(u)
            n += 1 if k in self.special else sum(map(bpe.total, bpe.pieces(u)))
        self.n_tokens = n

    def _inside(self, k: int) -> list[int]:
        """Counts at the prefixes of unit k but the whole one, and the whole one's."""
        u, bpe = self.units[k], self.bpe
        if k in self.special:
            # cut special strings are ordinary text, which may join the text before them
            lead = self.units[k - 1] if k else ""
            if not lead or k - 1 in self.special:
                return [bpe.count(u[:j]) for j in range(len(u))] + [1]
            base = sum(map(bpe.total, bpe.pieces(lead)))
            return [0] + [bpe.count(lead + u[:j]) - base for j in range(1, len(u))] + [1]
        space = len(u) - len(u.lstrip())
        if space == 0 or space == len(u):
            whole = bpe.pieces(u)
            if len(whole) == 1:
                return bpe.piece_counts(u)
        out = bpe.piece_counts(u[:space]) if space else [0]
        rest = bpe.pieces(u)
        done, total = 0, 0
        for p in rest:
            got = bpe.piece_counts(p)
            for j in range(1, len(p) + 1):
                if done + j > space:
                    out.append(total + got[j])
            done, total = done + len(p), total + got[-1]
        return out

    def count(self, i: int) -> int:
        """Tokens of text[:i]."""
        if i <= 0 or not self.units:
            return 0
        if i >= len(self.text):
            return self.n_tokens
        k = bisect_right(self.starts, i) - 1
        return self.before[k] + (self._inside(k)[i - self.starts[k]] if i > self.starts[k] else 0)

    def longest(self, budget: int) -> int:
        """The largest i with count(i) <= budget."""
        if budget >= self.n_tokens:
            return len(self.text)
        if budget < 0:
            raise ValueError("a budget of 0 tokens at least")
        k = bisect_right(self.before, budget) - 1
        counts = self._inside(k)
        return self.starts[k] + max(j for j, n in enumerate(counts[:-1] if self.before[k] + counts[-1] > budget else counts) if self.before[k] + n <= budget)


@lru_cache(maxsize=4)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512, carry: list[str] | None = None) -> DataFrame:
    """Add n_bytes, n_tokens, over_limit and limit_chars: code points of the longest prefix of at most `limit` tokens."""

    def make():
        bpe = loaded(path)

        def work(texts: list) -> list[pa.Array]:
            texts = [t or "" for t in texts]
            tokens = [bpe.count(t) for t in texts]
            cut = [len(t) if n <= limit else _cut(bpe, t, limit) for t, n in zip(texts, tokens, strict=True)]
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(cut, pa.int64())]

        return work

    fields = [C.field("n_bytes", T.LongType()), C.field("n_tokens", T.LongType()), C.field("over_limit", T.BooleanType()), C.field("limit_chars", T.LongType())]
    return C.map_rows(docs, text_col, make, fields, carry)


def _cut(bpe: ByteBpe, text: str, limit: int) -> int:
    """longest(limit), from a table over the one unit in which the limit falls.

    Every token that is not special has at least one byte and at most a vocabulary entry's length, so a head
    that holds more than `limit` tokens before its last pieces settles the question.
    """
    size = 8 * limit
    while size < len(text) and not (bpe.special and bpe.special.search(text, 0, size + 64)):
        pieces, n = bpe.pieces(text[:size]), 0
        for k, p in enumerate(pieces):
            n += bpe.total(p)
            if n > limit:
                break
        first = last = k
        while first and pieces[first - 1].isspace():
            first -= 1
        while last < len(pieces) - 2 and pieces[last].isspace():
            last += 1
        if n > limit and last < len(pieces) - 2:
            before = n - sum(map(bpe.total, pieces[first : k + 1]))
            return sum(map(len, pieces[:first])) + PrefixCounts(bpe, "".join(pieces[first : last + 1])).longest(limit - before)
        size *= 4
    return PrefixCounts(bpe, text).longest(limit)
