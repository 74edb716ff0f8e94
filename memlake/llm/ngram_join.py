"""N-gram Jaccard join with token-combination prefixes, and the classes of documents that it links.

A document's set is its distinct 5-word shingles, A-Z lower-cased; with fewer words, the whole sequence
is one; without words it is empty and linked with nothing. Two documents link when
100 * intersection >= 75 * union. The result is exact but for collisions of 64-bit hashes.

1. Documents with equal sets are one node. Very frequent shingles (in a thousandth of all documents or
   more) are found as in two-pass frequent-item counting and put last in the global order.
2. A set of n shingles has the prefix of n - ceil(0.75 n) + k in that order, k = 1 + n // 10: similar sets
   share k shingles of their prefixes at least. Prefixes are dealt out by shingle and counted; a shingle
   of one prefix alone can't be shared.
3. The rest of the prefix is indexed once for each band of sizes that a partner may have (bands are an
   eighth of a power of two wide). Two sizes fix the least overlap, and so how many shingles the prefixes
   must share at least: a document with fewer that others have is left out, and of the others all but that
   many less one, the rarest first, are indexed. Rare shingles are indexed one by one, frequent ones in
   pairs. Pairs are formed within groups of shingles, and the prefix is extended by as many shingles as
   there are groups: so one more common shingle than groups makes a common pair.
4. Keys that hold much the same documents are merged: a key's representative is the least node hash among its
   documents, and the documents of all keys with one representative make a group. Groups are cut into blocks of
   BLOCK_DOCS documents and BLOCK_TOKENS shingles. A task holds the whole sets of a few blocks and emits links
   between classes, never pairs: less than one for each document. Sets that are in one class already are not
   compared, others only if their bitmaps allow it.
5. Groups of one block are done then. Larger ones are dealt to blocks SALTED times at random, which costs as much
   as they have documents and joins what is similar to many; at last each block of those documents that aren't
   in the group's largest class meets every other block, so that no link is lost.

Defined results: null and empty texts have n_shingles 0 and are their own component. Rows with equal ids
are separate documents that may fall into different classes. An empty table gives an empty result. Other
columns are not carried, unless asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import common as C
from memlake.operators.graph import components

WORDS, PERCENT = 5, 75
#: Shingles in one document of this many are very frequent.
HEAVY_SHARE = 1000
#: Shingles in more prefixes than this are indexed in pairs.
FREQUENT = 64
#: Tokens (8 bytes each) that a task holds before it counts them, that it holds before it deals them out, and that a group of the shuffle has at most, about.
COUNTED, HELD, GROUP_TOKENS = 1_000_000, 300_000, 250_000
#: Documents and tokens of a block that is compared at once, and tokens of the blocks that a task holds at once.
BLOCK_DOCS, BLOCK_TOKENS, PART_TOKENS = 1024, 1_000_000, 1_000_000
#: Times that large groups are dealt to blocks at random.
SALTED = 2
#: Hashes of rows are broadcast up to this number (one long, some 50 bytes each), and rows of blocks (some 100 bytes); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS, MAX_BROADCAST_ROWS = 4_000_000, 500_000
#: Bits of a bitmap.
LEAST_BITS, MOST_BITS = 1024, 1 << 16
#: Bytes of words, with some 150 a word for the table, whose hashes a task keeps; longer words than this are not kept; bytes of text cut into words at once; nodes that a task remembers.
WORDS_BYTES, LONG_WORD, PIECE, SEEN = 16 << 20, 64, 1 << 20, 200_000
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_ALL = np.iinfo(np.int32).max


class _Words(dict):
    """Hashes of words."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            self.held += len(word) + 150
            if self.held > WORDS_BYTES:
                self.clear()
                self.held = 0
            self[word] = got
        return got


class _Seen(set):
    """Nodes that a task has met lately: repeats that it lets pass cost work, not results."""

    def new(self, node: int) -> bool:
        if node in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(node)
        return True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashed(text: str, words: dict) -> np.ndarray:
    """The words' hashes; the text is cut at spaces into pieces, so that few words are held at once."""
    raw, made, at = text.encode().lower(), [], 0
    while at < len(raw):
        end = _SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = end.end() if end else len(raw)
        found = raw[at:end].split()
        made.append(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)))
        at = end
    return np.concatenate(made) if len(made) > 1 else made[0] if made else np.empty(0, np.uint64)


def shingles(text: str | None, words: dict | None = None, width: int = WORDS) -> np.ndarray:
    """The sorted hashes of the text's set."""
    w = _hashed(text or "", words if words is not None else _Words())
    if not len(w):
        return np.empty(0, np.uint64)
    if len(w) < width:
        return _mixed(np.array([(w * _M[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
    n = len(w) - width + 1
    return np.unique(_mixed(sum(w[j : j + n] * _M[j] for j in range(width))))


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_common(n, percent: int = PERCENT):
    return -(-percent * n // 100)


def extra(n: int) -> int:
    return 1 + n // 10


def prefix_length(n: int) -> int:
    return n - least_common(n) + extra(n)


#: Least sizes of the bands.
BANDS = sorted({int(np.ceil(2 ** (k / 8))) for k in range(8 * 40)})


def band_of(n: int) -> int:
    return bisect_right(BANDS, n) - 1


def _shared(x, y):
    """Prefix shingles that similar sets of sizes x and y share at least."""
    overlap = -(-PERCENT * (x + y) // (100 + PERCENT))
    return np.minimum(overlap - least_common(x) + 1 + x // 10, overlap - least_common(y) + 1 + y // 10)


@lru_cache(maxsize=1 << 16)
def least_shared(n: int, band: int) -> int:
    """The same for a set of n and any similar one of a band; 0 where there is none."""
    low, high = max(BANDS[band], least_common(n)), min(BANDS[band + 1] - 1, 100 * n // PERCENT)
    return int(_shared(n, np.arange(low, high + 1)).min()) if low <= high else 0


@lru_cache(maxsize=1 << 14)
def groups_of(first: int, second: int) -> int:
    """Groups within which pairs of shingles are formed, for sets of two bands: one less than any two similar ones share. 0: no pairs."""
    sizes = [np.unique(np.linspace(BANDS[b], BANDS[b + 1] - 1, 257).astype(np.int64)) for b in (first, second)]
    x, y = np.meshgrid(*sizes)
    fits = (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y))
    slack = 1 if BANDS[max(first, second) + 1] - BANDS[max(first, second)] <= 257 else 2 + (BANDS[max(first, second) + 1] - BANDS[max(first, second)]) // 256
    return max(0, int(_shared(x, y)[fits].min()) - slack) if fits.any() else 0


# -- nodes and very frequent shingles ---------------------------------------------------------------


def text_key(text_col: str) -> Column:
    """A hash of the text: with the id it tells rows apart whose ids are equal or null."""
    return F.xxhash64(F.col(text_col))


def _nodes(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows (doc, key, n, node) for each document, and (shingle, times) for what is frequent in a task's documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held, size, docs_held = _Words(), _Seen(), [], 0, 0

        def frequent() -> pa.RecordBatch:
            nonlocal held, size, docs_held
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = n >= max(3, docs_held / (4 * HEAVY_SHARE))
            h, n = h[at].view(np.int64), n[at]
            held, size, docs_held = [], 0, 0
            return _batch([pa.nulls(len(h), ids), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(h), pa.array(n, pa.int64())])

        ids = None
        for batch in batches:
            ids = batch.column(0).type
            n, node = [], []
            for text in batch.column(1):
                t = shingles(text.as_py(), words)
                n.append(len(t))
                node.append(node_of(t) if len(t) else None)
                if len(t) and seen.new(node[-1]):
                    held.append(t)
                    size, docs_held = size + len(t), docs_held + 1
                    if size > COUNTED:
                        yield frequent()
            yield _batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())])
        if held:
            yield frequent()

    def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=["doc", "key", "n", "node", "shingle", "times"])

    return C.stored(docs.select(id_col, text_col, text_key(text_col).alias("key")).mapInArrow(C.released(run), f"doc {kind}, key long, n long, node long, shingle long, times long"), "nodes")


def _heavy(found: DataFrame, n_docs: int) -> np.ndarray:
    """Very frequent shingles: at most HEAVY_SHARE times the mean set's size of them, whatever the corpus."""
    least = max(FREQUENT, n_docs // (2 * HEAVY_SHARE))
    rows = found.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("shingle")
    return np.sort(np.fromiter((r[0] for r in rows.toLocalIterator()), np.int64).view(np.uint64))


# -- prefixes, their shared shingles, index keys ----------------------------------------------------

_BLOB = "part int, kind int, size long, a binary, b binary, c binary"
_BLOB_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_BLOB_NAMES = ["part", "kind", "size", "a", "b", "c"]


def _blobs(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_BLOB_TYPES)], names=_BLOB_NAMES)


def _dealt(parts: np.ndarray, n_parts: int, kind: int, *columns: np.ndarray) -> list[tuple]:
    """One row per part that has elements: the columns' elements of that part, packed."""
    order = np.argsort(parts, kind="stable")
    ends = np.searchsorted(parts[order], np.arange(n_parts + 1))
    columns = [c[order] for c in columns]
    out = []
    for p in range(n_parts):
        a, b = ends[p], ends[p + 1]
        if b > a:
            packed = [c[a:b].tobytes() for c in columns] + [None] * (3 - len(columns))
            out.append((p, kind, b - a, *packed))
    return out


def _prefixes(docs: DataFrame, heavy, n_parts: int, text_col: str) -> DataFrame:
    """Blobs of (shingle, node) of the prefixes by shingle, and of (node, n, shingle) of the very frequent ones by node (shingle 0: just n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, words, seen = heavy.value, _Words(), _Seen()
        tokens, nodes, h_node, h_n, h_token, size = [], [], [], [], [], 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            t, n = np.concatenate(tokens), np.concatenate(nodes)
            rows = _dealt((t % np.uint64(n_parts)).astype(np.int64), n_parts, 0, t, n)
            node = np.concatenate(h_node)
            rows += _dealt(node.view(np.uint64).astype(np.uint64) % np.uint64(n_parts), n_parts, 1, node, np.concatenate(h_n), np.concatenate(h_token))
            for x in (tokens, nodes, h_node, h_n, h_token):
                x.clear()
            yield from _blobs(rows).to_batches()

        for batch in batches:
            for text in batch.column(0):
                t = shingles(text.as_py(), words)
                if not len(t) or not seen.new(node := node_of(t)):
                    continue
                n = len(t)
                length = prefix_length(n)
                if len(often):
                    at = np.minimum(np.searchsorted(often, t), len(often) - 1)
                    is_heavy = often[at] == t
                    light, hot = t[~is_heavy][:length], t[is_heavy]
                    hot = hot[: max(0, length - len(light))]
                else:
                    light, hot = t[:length], t[:0]
                tokens.append(light)
                nodes.append(np.full(len(light), node, np.int64))
                h_node.append(np.full(1 + len(hot), node, np.int64))
                h_n.append(np.full(1 + len(hot), n, np.int64))
                h_token.append(np.concatenate([np.zeros(1, np.uint64), hot]))
                size += length
                if size > HELD:
                    yield from passed_on()
                    size = 0
        if h_node:
            yield from passed_on()

    return docs.select(text_col).mapInArrow(C.released(run), _BLOB)


def _unpacked(table: pa.Table, kind: int, *types) -> list[np.ndarray]:
    rows = [k for k, x in enumerate(table.column("kind").to_pylist()) if x == kind]
    out = []
    for name, t in zip("abc", types, strict=False):
        column = table.column(name)
        out.append(np.concatenate([np.frombuffer(column[k].as_buffer(), t) for k in rows]) if rows else np.empty(0, t))
    return out


def _shared_tokens(n_parts: int):
    """Keep the shingles of two prefixes at least, with their counts, and deal them out by node."""

    def run(table: pa.Table) -> pa.Table:
        token, node = _unpacked(table, 0, np.uint64, np.int64)
        out = []
        if len(token):
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node = token[new], node[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            times = np.diff(np.concatenate([starts, [len(token)]]))
            times = np.repeat(times, times)
            keep = times > 1
            token, node, times = token[keep], node[keep], times[keep].astype(np.int32)
            out = _dealt(node.view(np.uint64) % np.uint64(n_parts), n_parts, 0, token, node, times)
        return pa.concat_tables([_blobs(out), table.filter(pc.equal(table.column("kind"), 1)).cast(pa.schema(list(zip(_BLOB_NAMES, _BLOB_TYPES, strict=True))))])

    return run


def index_keys(token: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one document, and the side it takes in each: token and times are its shared prefix shingles in
    the order of (times, shingle). Side 2: both partners are of one band; 0 and 1: of the lower and the higher."""
    keys, sides, own = [], [], band_of(n)
    rare = int(np.searchsorted(times, FREQUENT, side="right"))
    for band in range(band_of(least_common(n)), band_of(100 * n // PERCENT) + 1):
        least = least_shared(n, band)
        if not least or len(token) < least:
            continue
        needed = len(token) - least + 1
        low, high = min(own, band), max(own, band)
        tag = np.uint64(low * 1000 + high)
        groups = min(groups_of(low, high), groups_of(high, low))
        found = [_mixed(token[: needed if not groups else min(needed, rare)] * _M[0] + tag)]
        if groups and needed > rare:
            found.append(_pairs(token[rare:], needed - rare, groups, tag))
        found = np.unique(np.concatenate(found))
        keys.append(found)
        sides.append(np.full(len(found), 2 if own == band else int(own > band)))
    return (np.concatenate(keys), np.concatenate(sides)) if keys else (token[:0], np.empty(0, np.int64))


def _pairs(often: np.ndarray, needed: int, groups: int, tag: np.uint64) -> np.ndarray:
    """Pairs within groups, of the first shingles that leave `needed` besides one of each group."""
    group = (_mixed(often) % np.uint64(groups)).astype(np.int64)
    later = np.ones(len(often), bool)
    later[np.unique(group, return_index=True)[1]] = False
    length = int(np.searchsorted(np.cumsum(later), needed)) + 1
    often, group = often[:length], group[:length]
    order = np.lexsort((often, group))
    often, group = often[order], group[order]
    reps = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
    first = np.repeat(np.arange(len(group)), reps)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(reps) - reps, reps)
    return _mixed(often[first] * _M[1] + often[second] * _M[2] + tag)


def _index(table: pa.Table) -> pa.Table:
    """(key, side, node, n) of the documents of one part."""
    token, node, times = _unpacked(table, 0, np.uint64, np.int64, np.int32)
    h_node, h_n, h_token = _unpacked(table, 1, np.int64, np.int64, np.uint64)
    size = dict(zip(h_node.tolist(), h_n.tolist(), strict=True))
    hot = h_token != 0
    token = np.concatenate([token, h_token[hot]])
    node = np.concatenate([node, h_node[hot]])
    times = np.concatenate([times, np.full(int(hot.sum()), _ALL, np.int32)])
    order = np.lexsort((token, times, node))
    token, node, times = token[order], node[order], times[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, times = token[new], node[new], times[new]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [len(node)]]) if len(node) else starts
    keys, sides, nodes, sizes = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        n = size[int(node[a])]
        got, side = index_keys(token[a:b], times[a:b], n)
        if len(got):
            keys.append(got)
            sides.append(side)
            nodes.append(np.full(len(got), node[a]))
            sizes.append(np.full(len(got), n))
    made = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, sides, nodes, sizes)]
    return pa.Table.from_arrays([pa.array(made[0].view(np.int64)), *(pa.array(x.astype(np.int64)) for x in made[1:])], names=["key", "side", "node", "n"])


# -- groups, verification and classes ---------------------------------------------------------------


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, tokens) of the documents wanted (__doc, __key; one per node). Rows equal in id and text each give the set; one whose hash is as a wanted one's may come along."""
    wanted = wanted.select(F.xxhash64("__doc", "__key").alias("__of")).distinct()
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), text_key(text_col)).alias("__of")).join(wanted, "__of", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), _Seen()
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0):
                t = shingles(text.as_py(), words)
                if len(t) and seen.new(node := node_of(t)):
                    nodes.append(node)
                    sets.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return C.stored(texts.select("text").mapInArrow(C.released(run), "node long, tokens binary"), "sets")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, as 64-bit integers: about eight bits for a shingle of the largest set, within bounds."""
    bits = 1 << min(max(8 * max(map(len, sets)), LEAST_BITS).bit_length(), MOST_BITS.bit_length() - 1)
    made = np.empty((len(sets), bits // 8), np.uint8)
    for row, s in zip(made, sets, strict=True):
        of = np.zeros(bits, bool)
        of[(s % np.uint64(bits)).astype(np.int64)] = True
        row[:] = np.packbits(of)
    return made.view(np.uint64)


def linked_labels(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links between the labels of one block: (larger, smallest of its class) for each label that joins another.

    Sets of different sides are compared, those of side 2 with all; sets whose classes are one already are
    not. Of a set's possible partners, the one with the most similar bitmap comes first: the bits in which
    two bitmaps differ are no more than the shingles in which the sets do.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, side = [sets[k] for k in order], side[order]
    n = np.array([len(s) for s in sets])
    names, cls = np.unique(label[order], return_inverse=True)
    start = cls.copy()
    bits = bitmaps(sets) if len(sets) > 2 else None
    for i in range(1, len(sets)):
        low = int(np.searchsorted(n[:i], least_common(int(n[i]))))
        may = (cls[low:i] != cls[i]) & ((side[low:i] != side[i]) | (side[i] == 2))
        if not may.any():
            continue
        others = low + np.flatnonzero(may)
        if bits is not None:
            differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = (100 + PERCENT) * differ <= (100 - PERCENT) * (n[others] + n[i])
            others = others[near][np.argsort(differ[near], kind="stable")]
        for j in others.tolist():
            if cls[j] != cls[i] and links(sets[j], sets[i]):
                a, b = sorted((cls[i], cls[j]))
                cls[cls == b] = a
    joined = np.unique(np.stack([start, cls]), axis=1)
    return [(int(names[s]), int(names[c])) for s, c in joined.T if s != c]


def links(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets link; p is the smaller."""
    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * common >= PERCENT * (len(p) + len(q) - common)


def _closed(table: pa.Table) -> pa.Table:
    """Links (a, b) between labels, of the blocks of one part."""
    block, node, label, side = (table.column(c).to_numpy() for c in ("block", "node", "label", "side"))
    tokens = table.column("tokens").combine_chunks()
    order = np.lexsort((node, side, block))
    same = np.zeros(len(order), bool)
    same[1:] = (block[order][1:] == block[order][:-1]) & (side[order][1:] == side[order][:-1]) & (node[order][1:] == node[order][:-1])
    order = order[~same]
    starts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])) if len(order) else np.empty(0, np.int64)
    found = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        at = order[a:b]
        if b - a > 1 and (label[at] != label[at[0]]).any():
            found += linked_labels([np.frombuffer(tokens[int(k)].as_buffer(), np.uint64) for k in at], label[at], side[at])
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between labels, of rows (block, node, n, label, side): the blocks are dealt out to parts of bounded size."""
    spark = blocks.sparkSession
    total, n_rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_TOKENS + 1)
    # the sets are long: where the blocks' rows are few, those go to them
    blocks = F.broadcast(blocks) if n_rows <= MAX_BROADCAST_ROWS else blocks
    rows = blocks.join(sets, "node").select(F.pmod("block", F.lit(n_parts)).cast("int").alias("part"), "block", "node", "label", "side", "tokens")
    return C.stored(rows.groupBy("part").applyInArrow(_closed, "a long, b long").distinct(), "links")


def _relabelled(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, label) after new links between labels."""
    step = components(new).toDF("label", "__label")
    if labels is None:
        return step.toDF("node", "label")
    known = labels.join(step, "label", "left").select("node", F.coalesce("__label", "label").alias("label"))
    fresh = step.join(labels.select(F.col("node").alias("label")), "label", "left_anti").toDF("node", "label")
    return C.stored(known.unionByName(fresh), "labels")


def _met(index: DataFrame) -> DataFrame:
    """(rep, node, n) of keys that bring two documents together, once each: keys with the same representative hold much the same documents.

    Most keys are of one document, so that counting them first and joining the counts would move them all twice."""
    of_key = Window.partitionBy("key")
    sides = [F.count_if(F.col("side") == k).over(of_key) for k in range(3)]
    met = (sides[2] > 1) | ((sides[0] > 0) & (sides[1] > 0))
    return index.select("node", "n", met.alias("met"), F.min(F.xxhash64("node")).over(of_key).alias("rep")).where("met").select("rep", "node", "n").distinct()


def _linked(docs: DataFrame, groups: DataFrame, reps: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, label) of the nodes that have links; groups has (rep, node, n), each once."""
    sizes = groups.groupBy("rep").agg(F.count("*").alias("__m"), F.sum("n").alias("__tokens"))
    n_blocks = F.greatest(F.ceil(F.col("__m") / BLOCK_DOCS), F.ceil(F.col("__tokens") / BLOCK_TOKENS)).cast("long")
    groups = C.stored(groups.join(sizes.select("rep", n_blocks.alias("n_blocks")), "rep"), "groups")
    sets = _sets(docs, reps.join(groups.select("node").distinct(), "node").select("__doc", "__key"), text_col, id_col)
    labels, rows = None, groups.withColumn("label", F.col("node"))
    for turn in range(SALTED):
        salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("n_blocks"))
        blocks = rows.select(F.xxhash64("rep", salt).alias("block"), "node", "n", "label", F.lit(2).alias("side"))
        labels = _relabelled(labels, _links(blocks, sets))
        # groups of one block have been compared in full; of the others those go on that have several classes
        large = groups.where("n_blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = large.groupBy("rep").agg((F.min("label") != F.max("label")).alias("__several")).where("__several").select("rep")
        rows = C.stored(large.join(several, "rep"), "open")
        if not rows.head(1):
            return labels
    return _relabelled(labels, _links(_block_pairs(rows), sets))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows (block, node, n, label, side) that bring together any two nodes of a group but those of its largest class.

    The nodes of the largest class and the others are dealt to blocks of half the size; each block of the
    others meets each of them, its own included, once."""
    held = rows.groupBy("rep", "label").agg(F.count("*").alias("__m"), F.sum("n").alias("__tokens"))
    halves = lambda m, tokens: F.greatest(F.ceil(2 * m / BLOCK_DOCS), F.ceil(2 * tokens / BLOCK_TOKENS)).cast("int")
    of = held.groupBy("rep").agg(F.max_by("label", "__m").alias("__main"), F.max("__m").alias("__most"), F.max_by("__tokens", "__m").alias("__held"), F.sum("__m").alias("__all"), F.sum("__tokens").alias("__total"))
    of = C.stored(of.select("rep", "__main", halves(F.col("__most"), F.col("__held")).alias("__q"), halves(F.col("__all") - F.col("__most"), F.col("__total") - F.col("__held")).alias("__o")), "largest")
    main, own = F.col("label") == F.col("__main"), F.xxhash64("node", F.lit(SALTED))
    at = F.when(main, F.pmod(own, F.col("__q"))).otherwise(F.pmod(own, F.col("__o"))).cast("int")
    dealt = rows.join(of, "rep").withColumn("__is_main", main).withColumn("__at", at)
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # (i, j): block i of the others with block j of them, or with block j - o of the largest class
    with_others = F.transform(each(F.col("__o")), lambda j: F.struct(F.least("__at", j).alias("i"), F.greatest("__at", j).alias("j"), F.when(F.col("__at") == j, 2).when(F.col("__at") < j, 0).otherwise(1).alias("side")))
    with_main = F.transform(each(F.col("__q")), lambda j: F.struct(F.col("__at").alias("i"), (F.col("__o") + j).alias("j"), F.lit(0).alias("side")))
    of_main = F.transform(each(F.col("__o")), lambda i: F.struct(i.alias("i"), (F.col("__o") + F.col("__at")).alias("j"), F.lit(1).alias("side")))
    meets = F.when(F.col("__is_main"), of_main).otherwise(F.concat(with_others, with_main))
    met = dealt.select("rep", "node", "n", "label", F.explode(meets).alias("m"))
    return C.stored(met.select(F.xxhash64("rep", "m.i", "m.j").alias("block"), "node", "n", "label", F.col("m.side").alias("side")), "blocks")


def similar_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of every document; component_id is the smallest id reachable by links."""
    return row_classes(docs, text_col, id_col).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def row_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, key, n, label, component_id) of every document. Classes that hold the same id, or none but null ids, differ in label; it is null without words."""
    spark = docs.sparkSession
    C.small_batches(spark)
    found = _nodes(docs, text_col, id_col)
    rows = found.where("shingle is null").select("doc", "key", "n", "node")
    total, n_docs = rows.agg(F.sum("n"), F.count("*")).first()
    reps = rows.where("node is not null").groupBy("node").agg(F.min("doc").alias("__doc"), F.coalesce(F.min_by("key", "doc"), F.min("key")).alias("__key"))
    heavy = spark.sparkContext.broadcast(_heavy(found, n_docs))
    # by the tokens alone: every part passes a row on to every other one that it has tokens for
    n_parts = int((total or 0) * 0.35 / GROUP_TOKENS) + 1
    blobs = _prefixes(docs, heavy, n_parts, text_col).groupBy("part").applyInArrow(_shared_tokens(n_parts), _BLOB)
    index = blobs.groupBy("part").applyInArrow(_index, "key long, side long, node long, n long")
    labels = _linked(docs, C.stored(_met(index), "met"), reps, text_col, id_col)
    comp = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = comp.groupBy("label").agg(F.min("__doc").alias("component_id"))
    comp = comp.join(least, "label").select("node", "label", "component_id")
    return rows.join(comp, "node", "left").select("doc", "key", "n", "label", F.coalesce("component_id", "doc").alias("component_id"))
