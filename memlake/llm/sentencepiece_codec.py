"""SentencePiece encoding and decoding by a merge-type prefix table.

A BPE model file with byte fallback and identity normalisation is loaded; the table of last tokens (see
prefix_tokens) gives each text's ids, backwards. As no piece holds a space mark after another character
and none holds a line feed, texts fall into segments that are encoded each for itself; a worker keeps
the ids of short segments it has met, within bounds in bytes. Decoding joins the pieces of the ids.
A segment's table takes 8 bytes a character; long texts are cut before spaces, so only their ids, not
their segments, are held together.

Defined results: a null or empty text has the end id only (no ids without `add_eos`) and decodes to ''.
Repeated rows are encoded each for itself. An empty table gives an empty result. Input columns named
like a result are replaced.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm import common as C
from memlake.llm.prefix_tokens import Kept, PrefixTable, cut

SPACE = "▁"
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_BYTES = re.compile(r"<0x([0-9A-F]{2})>")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(m[1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i) and (m := _BYTES.fullmatch(p))}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        normal = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if len(self.byte_ids) < 256 or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal) or sp.encode(" a", out_type=str)[:1] == [SPACE + "a"]:
            raise ValueError("a BPE model with byte fallback, a leading space and no pieces across words is asked for")
        merge = {p: (-sp.get_score(i), i) for p, i in normal.items()}
        pieces, unk = self.pieces, self.unk
        priority = lambda a, b: merge.get(pieces[a] + pieces[b]) if a != unk and b != unk else None
        self.table = PrefixTable(normal, lambda s: [normal.get(c, unk) for c in s], priority, unknown=unk)
        self.kept = Kept(self.segment)
        self.texts = ["" if i in self.control else " ⁇ " if i == unk else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.is_byte = np.array([i in self.id_bytes for i in range(n)])

    def segment(self, s: str) -> bytes:
        """The ids of one segment, as packed 32-bit integers."""
        ids = array("i")
        last, size = self.table.last_tokens(s)
        i = len(s)
        while i:
            if last[i] == self.unk:
                ids.extend([self.byte_ids[b] for b in reversed(s[i - 1].encode())])
            else:
                ids.append(last[i])
            i -= size[i]
        ids.reverse()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if not text:
            return b""
        out, kept = bytearray(), self.kept.__getitem__
        for k, part in enumerate(cut(text)):
            marked = part.replace(" ", SPACE)
            out += b"".join(map(kept, _SEGMENTS.findall(marked if k else SPACE + marked)))
        return bytes(out)

    def _text(self, packed: bytes) -> str:
        """The text of some ids, with its leading space."""
        ids = np.frombuffer(packed, np.int32)
        texts, bytes_at = self.texts, self.is_byte[ids]
        if not bytes_at.any():
            return "".join(map(texts.__getitem__, ids.tolist()))
        out, run = [], bytearray()
        for i, is_byte in zip(ids.tolist(), bytes_at.tolist(), strict=True):
            if is_byte:
                run.append(self.id_bytes[i])
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
            out.append(texts[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of any packed ids: control pieces vanish, runs of byte pieces are read as UTF-8, one leading space goes."""
        first = next((i for i in array("i", packed) if i not in self.control), None)
        text = self._text(packed)
        return text[1:] if first is not None and first not in self.id_bytes and self.pieces[first].startswith(SPACE) else text


def _utf8(run: bytearray) -> str:
    """UTF-8, with one replacement character for each byte that belongs to no character."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        if not n:
            out.append("�")
        i += n or 1
    return "".join(out)


@lru_cache(maxsize=4)
def loaded(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", add_eos: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Add ids (array<int>) and decoded, the text that these ids decode to."""

    def make():
        model = loaded(path)
        end = array("i", [model.eos]).tobytes() if add_eos else b""

        def work(texts: list) -> list[pa.Array]:
            data = [model.encode(t or "") + end for t in texts]
            offsets = np.zeros(len(data) + 1, np.int32)
            np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(data))])
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(map(model.decode, data), pa.string())]

        work.close = model.kept.forget
        return work

    return C.map_rows(docs, text_col, make, [C.field("ids", T.ArrayType(T.IntegerType())), C.field("decoded", T.StringType())], carry)


def decode(df: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Add decoded, the text of ids_col (null or empty: '')."""

    def make():
        model = loaded(path)
        return lambda lists: [pa.array([model.decode(array("i", [i for i in ids or () if i is not None]).tobytes()) for ids in lists], pa.string())]

    return C.map_rows(df, ids_col, make, [C.field("decoded", T.StringType())], carry)


def ids_digest(ids: str = "ids"):
    """Hex digest of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256)
