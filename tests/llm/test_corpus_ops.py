"""Sharding, Merkle manifest and phrase collocations against brute force and
on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlytics.llm import collocations, merkle, sharding
from meterlytics.llm.ranks import Scratch, places

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rand_docs(n, seed=1, langs=("en", "de", None, "")):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "d", "é", "the", "of"]
    return [(rng.choice([i, i, i, None, 7]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 9)))]),
             rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 3])) for i in range(n)]


# ---- places -----------------------------------------------------------------

def test_places_are_gapless_in_order(spark):
    rng = random.Random(2)
    # one group and one row hold most of the table
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([1, 1, 1, 2, None, rng.randrange(50)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = places(df, ["g"], [F.col("v").asc_nulls_first()], Scratch(spark, "t"), "p", "pos", "n").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["g"]].append((r["pos"], r["v"], r["n"]))
    for g, found in by.items():
        found.sort()
        want = sorted([v for h, v in rows if h == g], key=lambda v: (v is not None, v))
        assert [(p, v, n) for p, v, n in found] == [(i, v, len(want)) for i, v in enumerate(want)]
    none = spark.createDataFrame([], "g string, v long")
    assert places(none, ["g"], [F.col("v").asc()], Scratch(spark, "t"), "p").collect() == []


# ---- rendezvous sharding ------------------------------------------------------

def pick(key, shards):
    def score(s):
        u = (int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -shards[s] / np.log(u)
    return max(shards, key=lambda s: (score(s), -s))


def test_shards_equal_brute_force(spark):
    rows = rand_docs(300)
    shards, more = {0: 1.0, 3: 2.5, 4: 0.5, 9: 1.0}, {10: 1.5}
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards, more).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == \
        collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), pick(i, shards), pick(i, shards | more))
                            for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], (r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"])))
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        assert [k for _, k in found] == sorted(k for _, k in found)


def test_few_keys_move(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k").withColumn("SHARD", F.lit("clash"))
    five = {s: 1.0 for s in range(5)}
    rows = sharding.assign(keys, "k", five, grown={5: 1.0}).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {5} and abs(len(moved) / 20000 - 1 / 6) < 0.02
    # a shard that goes gives up its own keys alone
    fewer = {r["k"]: r["shard"] for r in sharding.assign(keys, "k", {s: 1.0 for s in range(4)}).collect()}
    assert all(fewer[r["k"]] == r["shard"] for r in rows if r["shard"] != 4)
    # shares follow the weights
    heavy = collections.Counter(r["shard"] for r in sharding.assign(keys, "k", {0: 1.0, 1: 3.0}).collect())
    assert abs(heavy[1] / 20000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(keys, "k", {0: 0.0})
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), five).collect() == []


# ---- Merkle manifest ------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return H(*(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def lower(t):
    return t and re.sub("[A-Z]", lambda m: m[0].lower(), t)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree, i):
    for level in tree[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        yield run[:i % 8], run[i % 8 + 1:]
        i //= 8


def brute_manifest(rows, hit):
    trees, out = {}, []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted([(r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows if r[2] == lang], key=lambda x: x[:3])
        trees[lang] = mine, levels([x[2] for x in mine])
    top = levels([t[-1][0] for _, t in trees.values()])
    for k, (mine, tree) in enumerate(trees.values()):
        for i, (_, _, own, r) in enumerate(mine):
            path = list(climb(tree, i)) + list(climb(top, k))
            cur = leaf(r, lower(r[1])) if hit(r[0]) else own
            for a, b in path:
                cur = H(*a, cur, *b)
            out.append((r[0], own, tree[-1][0], top[-1][0], H(*(x for a, b in path for x in a + b)), cur, cur == top[-1][0]))
    return out


def hit(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


@pytest.mark.parametrize("n, span", [(0, 4), (1, 4), (2, 1), (9, 1), (300, 1), (300, 2), (600, 4)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = rand_docs(n, seed=n, langs=("en",) if n < 10 else ("en", "en", "en", None, "", *[f"l{k}" for k in range(12)]))
    df = spark.createDataFrame(rows, DOCS).withColumn("POS", F.lit(1)).withColumn("digest", F.lit("x"))
    got = merkle.manifest(df, merkle.third(F.col("doc_id"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    # rows equal in all fields share a leaf; which of their places is whose does not matter
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_manifest(rows, hit))


def test_a_version_copies_its_ancestors_only(spark):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(100)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), F.col("doc_id") == 42, with_copies=True).collect()
    one = next(r for r in got if r["doc_id"] == 42)
    assert [r["doc_id"] for r in got if r["copied"]] == [42] and not one["verified"]
    assert one["copied"][0] == leaf(rows[42], "text 42") and one["copied"][-1] == one["folded_root"]
    assert len(one["copied"]) == 1 + 3                   # 100 leaves: three levels, one language
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got if r["doc_id"] != 42)
    base = merkle.Persistent("".join(leaf(r, r[1]) for r in rows).encode(), 3)
    assert base.top.decode() == one["root"]
    before = list(base.levels)
    merkle.copies(b"0" * 64, base.siblings(5))
    assert base.levels == before


# ---- phrase collocations -----------------------------------------------------------

def brute_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, g[i:j]) for (lang, g), b in cand.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
            if j - i < len(g) and 100 * b >= 80 * f[lang, g[i:j]]}
    out = collections.defaultdict(list)
    for (lang, g), a in cand.items():
        if (lang, g) in gone:
            continue
        score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, r, p.decode(), -a, x, y, n[lang], -s)
            for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def phrase_docs(seed, n=400):
    rng = random.Random(seed)
    words = [*"abcdefgh", "New", "york", "É", " ", "x\x00y"] + [f"w{i}" for i in range(60)]
    def text():
        out = []
        for _ in range(rng.randrange(0, 40)):
            out.append(rng.choice(["New york city hall", "a a a a", rng.choice(words), rng.choice(words[:9])]))
            out.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?! "]))
        return "".join(out)
    return [(rng.choice([i, None]), rng.choice([None, "", "...", text(), text(), text()]), rng.choice(["en", "en", None, "und", "de"]), "s", 0)
            for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"GROUP": 1500, "PER_BUCKET": 200, "FIRST_BUCKETS": 2, "SLICE": 3000}])
def test_collocations_equal_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)
    rows = phrase_docs(5)
    rows.append((1, "long text, " * 2000, "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("SLICE", F.lit(1)).withColumn("ids", F.lit(b"x"))
    for least, top in ((30, 2000), (5, 40)):
        got = {tuple(r) for r in collocations.collocations(df, least, top).collect()}
        assert got == brute_phrases(rows, least, top) and got


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 1 << 50                       # 2,000,000 times that passes 64 bits
    got = spark.range(1).select(F.lit(big).alias("f"), F.array(F.lit(big + 1)).alias("pre")).select(
        F.expr(f"(2000000 * {collocations._whole('f')}) div ({collocations._whole('pre[0]')} + {collocations._whole('pre[0]')})").alias("s"))
    assert got.first()["s"] == 2000000 * big // (2 * big + 2)


def test_cells_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(3)
    a = (rng.zipf(1.3, 60000) % 40000).astype(np.uint64)
    b = (rng.zipf(1.3, 60000) % 40000).astype(np.uint64)
    cells = (a << np.uint64(32)) | b
    want = np.unique(cells, return_counts=True)
    for dense in (1, 1000, 1 << 40):
        monkeypatch.setattr(collocations, "DENSE", dense)
        got = collocations.count_cells(cells)
        assert all((x == y).all() for x, y in zip(got, want))
        half = [collocations.count_cells(x) for x in np.array_split(cells, 3)]
        again = collocations.count_cells(*(np.concatenate(x) for x in zip(*half)))
        assert all((x == y).all() for x, y in zip(again, want))
    found, counts = want
    assert (collocations.unpack_cells(collocations.pack_cells(found, counts)[0]) == found).all()
    assert (collocations.from_planes(collocations.planes(counts)) == counts).all()
    assert (collocations.bucket_of(found, 64) % 8 == collocations.bucket_of(found, 8)).all()
