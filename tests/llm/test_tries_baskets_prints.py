"""The prefix trie, closed itemsets and edit fingerprints, against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memlake.llm import conversation_trie as trie
from memlake.llm import edit_fingerprints as prints
from memlake.llm import entry
from memlake.llm import frequent_baskets as baskets


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    return {c: turns.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + v[h:] for c, v in turns.items()}


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs_here in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = sorted(c for c in convs_here if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(convs_here), len(node), min(members[node[:-1]]) if node else None, len(convs_here), sum(len(n) == len(node) + 1 for n in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


CONVS = "conv_id long, turn long, role string, text string"
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(60), 30):
        for t in range(rng.choice([1, 2, 4, 9, 12])):
            rows.append((c, rng.choice([t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", None, "long text"])))
    rows += [(70, t, "user", f"turn {t // 2}") for t in range(45)] + [(75, t, "user", f"turn {t // 2}") for t in range(44)]
    rows += [(None, 0, "user", "lost"), (70, 3, "user", "turn 1"), (81, None, None, None)]
    rows += [(c, 0, "user", "hi") for c in range(100, 140)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "ids"), [(64, 1024), (3, 4)])
def test_trie_nodes(spark, monkeypatch, block, ids):
    """Deep conversations in several levels of blocks; members in several parts."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "ID_RANGE", ids)
    rows = conversations(block)
    df = spark.createDataFrame(rows, CONVS).withColumn("depth", F.lit("clash")).repartition(5)
    got = trie.prefix_trie(*trie.regenerated(df)).select(NODES).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rebuilt(rows))


def test_trie_of_little(spark):
    empty = spark.createDataFrame([], CONVS)
    assert trie.prefix_trie(*trie.regenerated(empty)).count() == 0
    # crc32('1') % 9 = 1 of 0 turns: conversation 1 loses its only turn, and is a member of the root
    lone = spark.createDataFrame([(1, 0, "user", "x")], CONVS)
    want = plain_trie(rebuilt([(1, 0, "user", "x")]))
    assert sorted(map(tuple, trie.prefix_trie(*trie.regenerated(lone)).select(NODES).collect()), key=str) == want


def test_trie_of_one_long_conversation(spark):
    """A third of the rows in one conversation: no array has more than a block of its turns."""
    n = 20_000
    df = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = trie.prefix_trie(*trie.regenerated(df)).where("depth > 0").select("depth", "n_leaves", "saved_tokens", "n_children").collect()
    assert len(got) == n
    assert all(r.n_leaves == 1 and r.saved_tokens == 0 for r in got) and sum(r.n_children for r in got) == len(got) - 1


def plain_itemsets(rows, least, share):
    by = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            by[b].add(i)
    least = max(least, -(-len(by) // share))
    have = defaultdict(set)
    for b, items in by.items():
        for i in items:
            have[i].add(b)
    frequent, level = {}, {(i,): b for i, b in have.items() if len(b) >= least}
    while level:
        frequent |= level
        level = {(*x, i): b for x in level for i in have if i > x[-1] and len(b := level[x] & have[i]) >= least}
    support = {x: len(b) for x, b in frequent.items()}
    n, out = len(by), {}
    for x, s in support.items():
        if any(s == t and set(x) < set(y) for y, t in support.items()):
            continue
        rules = []
        for c in x if len(x) > 1 else ():
            a, own = support[tuple(i for i in x if i != c)], support[c,]
            if 100 * s >= 10 * a and s * n > a * own:
                rules.append((c, a, own))
        out[x] = (s, rules)
    return out


@pytest.mark.parametrize(("groups", "split", "salts"), [(1024, 500_000, 32), (3, 4, 2), (1, 1, 1)])
def test_closed_itemsets_and_rules(spark, monkeypatch, groups, split, salts):
    """One shard for all, shards that are split again and again, a shard for each item; a hot item and a hot basket."""
    monkeypatch.setattr(baskets, "GROUPS", groups)
    monkeypatch.setattr(baskets, "SPLIT_ROWS", split)
    monkeypatch.setattr(baskets, "SALTS", salts)
    rng = random.Random(groups)
    packs = [rng.sample(range(12), rng.randrange(2, 6)) for _ in range(5)]
    rows = [(b, i) for b in range(120) for i in {*(x for p in rng.sample(packs, 2) if rng.random() < 0.7 for x in p), rng.randrange(14)}]
    rows += [(b, 0) for b in range(90)] + [(7, i) for i in range(14)] + [(None, 1), (3, None), (7, 0), (500, 99)]
    df = spark.createDataFrame(rows, "basket long, item long").repartition(3)
    mined, n = baskets.itemsets(df, 8, 5000)
    sets = baskets.closed(mined)
    found = defaultdict(list)
    for r in baskets.rules(sets, mined, n).collect():
        found[tuple(sorted(r["items"]))].append((r["item"], r["without"], r["own"]))
    got = {tuple(sorted(r["items"])): (r["support"], sorted(found[tuple(sorted(r["items"]))])) for r in sets.collect()}
    assert got == plain_itemsets(rows, 8, 5000) and len(got) == sets.count()
    assert baskets.itemsets(df.limit(0))[0].count() == 0


def plain_print(text):
    """Step by step, a coin at a time."""
    goes, steps = prints.coins(), set(prints.sampled()[0].tolist())
    points, out, i, j = [ord(c) for c in text], [], 0, 0
    while i < len(points):
        if j in steps:
            v = sum((points[i + k] if i + k < len(points) else 0) * m for k, m in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)))
            out.append("%x" % ((v & 0xFFFFFFFF) >> 28))
        i += int(goes[j % prints.COINS][((points[i] * 0x9E3779B1) & 0xFFFFFFFF) >> 26])
        j += 1
    return "".join(out)


def said(rng, n):
    return "".join(rng.choice("abcdefghij éü中😀\n") for _ in range(n))


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_walks(monkeypatch, piece):
    monkeypatch.setattr(prints, "PIECE", piece)
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 8, 100, 3000):
        text = said(rng, n)
        assert prints.fingerprint(text) == plain_print(text)
    assert prints.fingerprint(None) == "" and prints.likeness(*[prints.digits_of("")] * 2) == 1.0


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    base = said(rng, 4000)
    near = lambda a, b: prints.likeness(prints.digits_of(prints.fingerprint(a)), prints.digits_of(prints.fingerprint(b)))
    assert near(base, base) == 1.0 and near(base, said(rng, 4000)) < 0.1 and near("", base) == 0.0
    means = []
    for edits in (1, 20, 200):
        scores = []
        for _ in range(12):
            text = list(base)
            for _ in range(edits):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
            scores.append(near(base, "".join(text)))
        means.append(sum(scores) / len(scores))
    assert means[0] > 0.9 and means == sorted(means, reverse=True) and means[2] < 0.3


@pytest.mark.parametrize("parts", [1, 7])
def test_beside_next(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3 if i else None, said(rng, rng.choice([0, 1, 5, 60, 400])), "x") for i in range(40)] + [(9, "one text", "y"), (9, "one text", "y"), (200, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    keyed = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    want = []
    for k, r in enumerate(keyed):
        after, half = keyed[(k + 1) % len(keyed)].text, len(r.text) // 2
        text = r.text[: len(r.text) - half] + after[:half]
        a, b, c = (prints.digits_of(plain_print(t)) for t in (r.text, text, after))
        want.append((r.doc_id, len(r.text), hashlib.sha256(text.encode()).hexdigest(), plain_print(r.text), plain_print(text), prints.likeness(a, b), prints.likeness(a, c)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = prints.beside_next(df).collect()
        one = prints.beside_next(df.where("doc_id = 200")).collect()
        assert prints.beside_next(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert [r.near_next for r in one] == [1.0]


def test_near_classes_find_what_brute_force_finds(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = said(rng, rng.choice([80, 500, 2000]))
        for _ in range(rng.choice([1, 1, 3, 30])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = "x"
            texts.append("".join(text))
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], "", None])]
    got = {r.doc_id: r for r in prints.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows) and got[len(texts)].class_id == got[0].class_id and got[len(texts) + 1].n_links == 0
    digits = {d: prints.digits_of(r.fingerprint) for d, r in got.items() if r.fingerprint}
    pairs = [(a, b) for a, b in itertools.combinations(digits, 2) if prints.likeness(digits[a], digits[b]) >= prints.LEAST]
    found = sum(got[a].class_id == got[b].class_id for a, b in pairs)
    assert len(pairs) > 200 and found >= 0.95 * len(pairs)
    label = {d: d for d in got}  # classes hold nothing that links don't lead to
    for _ in range(len(label)):
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            break
    assert all(label[r.class_id] == label[d] for d, r in got.items() if r.fingerprint)


def test_basket_query_names_rules(spark, tmp_path):
    rows = [(b, i) for b in range(20) for i in ((1, 2) if b < 9 else (3,))] + [(30, 1)]
    df = spark.createDataFrame([(s, 0, i, "kept") for s, i in rows], "sale_id long, line_no int, item_id long, flag string")
    df.write.parquet(f"{tmp_path}/sale_lines.parquet")
    got = {r["items"]: r for r in entry.op12_frequent_baskets(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "1,2", "3"} and got["1,2"].support == 9 and got["1,2"].n_rules == 2 and got["1,2"].best_item == 1
    assert got["1,2"].rules_sha256 == hashlib.sha256(b"1:9:10;2:10:9").hexdigest() and got["3"].n_rules == 0
