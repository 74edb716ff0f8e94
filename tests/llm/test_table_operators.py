"""Operators on whole tables: joins, shards, archives, the pipeline; against brute force."""

import importlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import common, kd_shards, ngram_join, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, groups, size, noise):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 20, 60, 150]))]
        for _ in range(rng.randrange(1, size)):
            words = [f"n{rng.randrange(10**6)}" if rng.random() < noise else w for w in base]
            if rng.random() < 0.4:
                words = passage[: rng.randrange(5, 60)] + words
            rows.append(" ".join(words).upper() if rng.random() < 0.1 else "  ".join(words))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate([*rows, None, "", " \n", "one", "one", "a b c d", "A  b c d"])]


@pytest.mark.parametrize(("groups", "size", "noise", "frequent", "block"), [(40, 6, 0.02, 64, 1024), (6, 60, 0.02, 3, 1024), (6, 60, 0.03, 3, 6)])
def test_ngram_join_is_exact(spark, monkeypatch, groups, size, noise, frequent, block):
    """With few copies; with large groups where shingles are indexed in pairs; with groups of many blocks."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rows = corpus(groups, groups, size, noise)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.similar_classes(docs).collect())
    assert got == brute_classes(rows)


def test_ngram_join_of_one_large_group_of_near_copies(spark, monkeypatch):
    """Chains of copies on either side of the line, and copies of one text that link with few of each other; no join makes pairs of them."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(220):
        words = list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 2, 3, 4])):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 60))) for i in range(40)]
    got = sorted(tuple(r) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_classes(rows)
    assert len({c for _, _, c in got}) > 10


def test_block_pairs_meet_once(spark, monkeypatch):
    """Every two nodes of a group meet in one block, but those of its largest class."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rows = [(g, node, 10, 1 if node < 40 else node) for g in (1, 2) for node in range(30 * g)]
    held = ngram_join._block_pairs(spark.createDataFrame(rows, "rep long, node long, n long, label long")).collect()
    met = set()
    for block in {r.block for r in held}:
        inside = [r for r in held if r.block == block]
        assert len(inside) < 40
        met |= {(block, a.node, b.node) for a in inside for b in inside if a.node < b.node and (a.side != b.side or a.side == 2)}
    want = [(a, b) for b in range(60) for a in range(b) if a >= 40 or b >= 40]
    assert sorted((a, b) for _, a, b in met) == sorted(want)


def test_index_keys_move_once(spark):
    """Keys that bring two documents together, and one move of the index alone by key."""
    rows = [(1, 2, 10, 5), (1, 2, 11, 5), (2, 2, 10, 5), (3, 0, 12, 6), (3, 1, 10, 5), (4, 0, 12, 6), (4, 0, 13, 6), (5, 2, 10, 5), (5, 2, 11, 5)]
    met = ngram_join._met(spark.createDataFrame(rows, "key long, side long, node long, n long"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Join" not in plan
    hashed = {k: spark.range(1).select(F.xxhash64(F.lit(k).cast("long"))).first()[0] for k in (10, 11, 12)}
    want = {(min(hashed[a], hashed[b]), node, n) for a, b in ((10, 11), (10, 12)) for node, n in ((10, 5), (11, 5), (12, 6)) if node in (a, b)}
    assert sorted(tuple(r) for r in met.collect()) == sorted(want)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_ngram_join_by_broadcast_and_by_shuffle(spark, monkeypatch, bound):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", bound)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", bound)
    rows = corpus(5, 20, 6, 0.02)
    got = sorted(tuple(r) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_classes(rows)


def test_words_of_long_texts(monkeypatch):
    text = " ".join(f"Wörter{k % 97}\t{k}" for k in range(3000)) + " "
    whole = ngram_join.shingles(text)
    monkeypatch.setattr(ngram_join, "PIECE", 100)
    assert (ngram_join.shingles(text) == whole).all() and len(whole) == 5996
    assert len(ngram_join.shingles("x" * 5000)) == 1 and len(ngram_join.shingles(" \n" * 500)) == 0


def test_ngram_join_of_empty_tables_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (2, "A b c d e f"), (None, "q r s")], "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.similar_classes(docs).collect()}
    assert got == {(1, 2, 1), (1, 0, 1), (2, 2, 1), (None, 1, None)}
    assert ngram_join.similar_classes(docs.limit(0)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Each class keeps one row, whatever ids it shares with others; rows with null ids link and bridge."""
    pipeline = importlib.import_module("corpus_pipeline")
    words = lambda p, a, b: " ".join(f"{p}{k}" for k in range(a, b))
    rows = [(3, words("a", 0, 60)), (7, words("a", 0, 60)), (7, words("b", 0, 60)), (8, words("b", 0, 60)), (9, words("c", 0, 60)), (9, words("d", 0, 60)), (1, words("e", 0, 60)), (1, words("e", 0, 60))]
    rows += [(None, words("f", 0, 60)), (None, words("g", 0, 60)), (None, words("g", 0, 60)), (None, words("h", 0, 100)), (None, words("h", 10, 110)), (4, words("i", 0, 100)), (None, words("i", 10, 110)), (5, words("i", 20, 120))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    left = sorted(((r.doc_id, r.text[0], len(r.text.split())) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=lambda r: r[1])
    assert [(i, p) for i, p, _ in left] == [(3, "a"), (7, "b"), (9, "c"), (9, "d"), (1, "e"), (None, "f"), (None, "g"), (None, "h"), (4, "i")]
    same = {(r.doc_id, r.component_id) for r in ngram_join.similar_classes(docs).collect()}
    assert {(4, 4), (5, 4), (None, 4)} <= same


def test_index_keys_meet():
    """Any two similar sets share a key, whatever the counts of their shingles."""
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.choice([4, 13, 20, 80, 300]))
        base = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        x = np.unique(base)
        cut = int(rng.integers(0, max(1, n // 8) + 1))
        y = np.unique(np.concatenate([x[cut:], rng.integers(1, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64)]))
        common_n = len(np.intersect1d(x, y))
        if 100 * common_n < 75 * (len(x) + len(y) - common_n):
            continue
        prefix = lambda s: s[: ngram_join.prefix_length(len(s))]
        p, q = prefix(x), prefix(y)
        times = {t: int(rng.choice([2, 3, 100, 5000])) for t in np.union1d(p, q).tolist()}
        both = set(p.tolist()) & set(q.tolist())
        keys = []
        for s in (p, q):
            s = [t for t in s.tolist() if t in both or rng.random() < 0.7]
            s.sort(key=lambda t: (times[t], t))
            size = len(x) if len(keys) == 0 else len(y)
            got, side = ngram_join.index_keys(np.array(s, np.uint64), np.array([times[t] for t in s]), size)
            keys.append(dict(zip(got.tolist(), side.tolist(), strict=True)))
        assert any(keys[0][k] + keys[1][k] in (1, 4) for k in set(keys[0]) & set(keys[1])), (trial, n)


def test_kd_shards(spark):
    rng = random.Random(3)
    rows = [(i, None if i == 5 else "é" * int(rng.paretovariate(1.2) * 20 % 4000), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("x"))
    for leaves in (3, 8):
        got = kd_shards.kd_shards(docs, leaves=leaves, text_dims=("lang", "source")).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert sorted(r.doc_id for r in got) == list(range(3000)) and set(by) == set(range(leaves))
        sizes = [sum(r["size"] for r in v) for v in by.values()]
        assert max(sizes) - min(sizes) <= 4 * 8001
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        texts = dict((r[0], r[1]) for r in rows)
        assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    total = sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert kd_shards.kd_shards(docs, target_bytes=total // 5 + 1).select("shard").distinct().count() == 5
    assert kd_shards.kd_shards(docs.limit(0), leaves=8, text_dims=("lang",)).count() == 0
    # rows equal in id and text are dealt out like others
    same = kd_shards.kd_shards(spark.createDataFrame([(7, "same", "en", "s", 1)] * 41, SCHEMA), leaves=4).collect()
    count = Counter(r.shard for r in same)
    assert sorted(count.values()) == [10, 10, 10, 11]
    assert all(sorted(r.slot for r in same if r.shard == k) == list(range(n)) for k, n in count.items())


def plain_tree(rows, leaves):
    """{row: shard} of rows (bytes, dimensions...): cut along the widest dimension at the value where the bytes to the left come nearest to their share."""
    span = [max(r[d] for r in rows) - min(r[d] for r in rows) or 1 for d in range(1, len(rows[0]))]
    out = {}

    def cut(held, k, first):
        if k == 1:
            out.update({r: first for r in held})
            return
        widths = [(max(r[d] for r in held) - min(r[d] for r in held)) / span[d - 1] for d in range(1, len(rows[0]))]
        d = 1 + widths.index(max(widths))
        held = sorted(held, key=lambda r: r[d])
        goal, n, at = sum(r[0] for r in held) * (k // 2) / k, 0, 0
        while n + held[at][0] < goal and at < len(held) - 1:
            n += held[at][0]
            at += 1
        at += abs(n + held[at][0] - goal) <= abs(n - goal)
        cut(held[:at], k // 2, first)
        cut(held[at:], k - k // 2, first + k // 2)

    cut(rows, leaves, 0)
    return out


@pytest.mark.parametrize("leaves", [2, 5, 8])
def test_kd_shards_against_a_plain_tree(spark, leaves):
    """Values without ties: ids in clusters, sizes all different, sources that differ only after a long common beginning."""
    rng = random.Random(leaves)
    sizes = rng.sample(range(3000), 500)
    names = rng.sample(range(10**6, 10**7), 500)
    rows = [(i * 7 + 10**6 * (i > 350), "x" * n, "en", f"https://example.org/{name}", 1) for i, (n, name) in enumerate(zip(sizes, names, strict=True))]
    got = {r.doc_id: r.shard for r in kd_shards.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), leaves=leaves, text_dims=("source",)).collect()}
    begin = os.path.commonprefix([r[3] for r in rows])
    rank = lambda name: int.from_bytes(name[len(begin) :].encode()[:7].ljust(7, b"\0"), "big")
    plain = {(len(t) + 1, i, len(t) + 1, rank(s)): i for i, t, _, s, _ in rows}
    want = {plain[r]: k for r, k in plain_tree(list(plain), leaves).items()}
    assert got == want


def test_warc_round_trip(spark, tmp_path):
    shared = "s" * 150
    rows = [(1, "http://a/é b", "<p>é</p>"), (2, None, None), (3, "u", shared), (4, "u", shared), (5, "u", shared), (6, "v", "x"), (7, "v", "x"), (None, "w", "q" * 200), (9, "z", "\r\n\r\nWARC/1.1" * 40)]
    rows += [(100 + i, "k", str(i) * 400) for i in range(60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n string").repartition(3)
    written = warc.write_warc(pages, f"file://{tmp_path}/w")
    assert written.agg(F.sum("records")).first()[0] == len(rows)
    for split in (100, 1000, 1 << 20):
        got = {r.page_id: r for r in warc.read_warc(warc.archives(spark, f"file://{tmp_path}/w"), split_bytes=split).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            r = got[None if i is None else str(i)]
            revisit = i in (4, 5)
            assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == ("3" if revisit else None)
            assert r.payload_bytes == len((html or "").encode()) and (revisit or r.payload.decode() == (html or ""))
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"file://{tmp_path}/e").select("path", "length")).count() == 0


def test_warc_urls_of_any_length(spark, tmp_path):
    """Heads of more than 64 KiB: the pages come back, with the responses that revisits refer to."""
    urls = ["http://a/" + "u" * 66_000, "http://b/" + "é" * 11_000, "http://c/" + "漢" * 7_300, "short"]
    pages = spark.createDataFrame([(i, u, "p" * 200) for i, u in enumerate(urls)], "page_id long, url string, html string")
    written = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_warc(written.select("path", "length"), split_bytes=1000).collect()}
    assert set(got) == {"0", "1", "2", "3"}
    assert got["0"].record_type == "response" and got["0"].payload == b"p" * 200 and {got[k].refers_to for k in "123"} == {"0"}
    assert all(unquote(got[str(i)].url) == u for i, u in enumerate(urls))


def test_warc_candidates_inside_members():
    """False magic in between, and a member inside a stored block, which a range that starts behind its head must not own."""
    inner = warc.member(warc.record(2, "u", b"inner", "d", None))
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = z.compress(warc.record(1, "u", b"xx" + warc.MAGIC + b"yy" + inner, "d", None)) + z.flush()
    data = outer + warc.member(warc.record(3, "u", b"three", "d", None))
    assert [o for o, _, _ in warc.records_in(io.BytesIO(data), 0, len(data))] == [0, len(outer)]
    late = data.index(inner)
    assert [o for o, _, _ in warc.records_in(io.BytesIO(data), late - 2, len(data))] == [late, len(outer)]


def test_warc_nested_members_are_left_out(spark, tmp_path):
    inner = warc.member(warc.record(2, "u", b"inner", "d", None))
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = z.compress(warc.record(1, "u", b"-" * 500 + inner, "d", None)) + z.flush() + warc.member(warc.record(3, "u", b"three", "d", None))
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = warc.read_warc(warc.archives(spark, f"file://{tmp_path}"), split_bytes=400).collect()
    assert sorted(r.page_id for r in got) == ["1", "3"]


def test_pipeline_against_plain_version(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(5)
    words = [f"word{k}" for k in range(500)]
    item = " ".join(rng.choices(words, k=14))
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=60))
        if i % 10 == 3:
            text = docs[-1][1]
        if i % 10 == 5:
            text = f"{text} {item}"
        if i % 10 == 6:
            text = f'{text} token = "abcdef123456"'
        if i % 10 == 7:
            text = "spam spam spam " * 10
        docs.append((i, text, "en", "s", len(text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2) if i % 10 != 7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    left = {i: t for i, t, *_ in docs if t and i % 10 != 7 and i % 10 != 3 and i % 10 != 5}
    assert set(got) == set(left)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in left.items():
        text = t.replace('token = "abcdef123456', "[SECRET]")
        assert got[i].ids == sp.encode(text, add_eos=True) and got[i].n_chars == len(text) and got[i].n_tokens == len(got[i].ids)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Repeated and null ids, null and very long texts, columns named like results, no labels, no benchmark; and no documents."""
    pipeline = importlib.import_module("corpus_pipeline")
    words = lambda p, n=30: " ".join(f"{p}{k}" for k in range(n))
    long = words("long", 300_000)
    rows = [(1, words("t")), (7, words("t")), (7, words("u")), (8, words("v")), (8, words("w")), (None, words("t")), (None, words("x")), (9, words("x")), (9, words("x")), (3, None), (4, ""), (None, None), (5, "few words"), (6, long), (11, long + " more"), (None, words("y")), (None, words("y"))]
    docs = [(i, t, None, "s", None, True, 5, "z") for i, t in rows]
    extra = SCHEMA + ", kept boolean, label long, ids string"
    spark.createDataFrame(docs, extra).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], extra).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    kept = pipeline.near_duplicates(spark, pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/a/documents.parquet"), f"{tmp_path}/a"), f"{tmp_path}/a")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: r[1])
    assert got == [(6, long), (1, words("t")), (7, words("u")), (8, words("v")), (8, words("w")), (9, words("x")), (None, words("y"))] and kept.columns == pipeline.COLUMNS
    done = pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in done) == sorted((i or 0, len(t)) for i, t in got) and all(r.n_tokens == len(r.ids) for r in done)
    assert pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_shared_root_is_the_sessions(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.shared_root(spark) == root.rstrip("/") if root else common.shared_root(spark).startswith("file:")
