"""Merkle manifests, importance resampling and URL filters against brute force, with the awkward cases."""

import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import importance, merkle, queries, url_filter
from fieldgauge.llm.url_filter import Rule

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans(merkle.A_TO_Z, merkle.A_TO_Z.lower())


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_importance_resampling", "op13_url_filters"])
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, DATA)
    want = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, want.fetchall()))


# 11 Merkle manifests
def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def fields(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 8])))
        at //= 8
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, fields(*r), r))
    trees = {g: climb([x[2] for x in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for g, v in groups.items():
        for at, (_, _, leaf, r) in enumerate(sorted(v, key=lambda x: x[:3])):
            path = siblings(trees[g], at) + siblings(top, order.index(g))
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = fields(*r[:4], r[4].translate(LOWER)) if changed else leaf
            for a, b in path:
                node = h(a + node + b)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9, None: 1}, {"en": 1200, None: 65, "": 2, "é": 64, "z": 513}, {f"l{i:02}": 1 + i % 3 for i in range(70)}])
def test_manifest(spark, sizes):
    rng, rows = random.Random(5), []
    for g, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "Ä Text With CAPITALS", "lower", "x" * 3000, "A:-1"]) if n < 1000 or i % 7 else "Same Row"
            rows.append((None if i == 3 else i // 2 if i % 11 == 0 else i, rng.choice([None, "web", "a:b"]), g, rng.choice([None, 3, -4]), text))
    rows += rows[:5]  # repeated rows
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    df = df.withColumns({"Root": F.lit("x"), "PATH": F.lit(1), "at": F.lit(2), "g": F.lit(0), "leaf": F.lit("")})
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.manifest(df).collect()]
    assert sorted(got, key=repr) == brute_manifest(rows)


def test_manifest_of_any_columns(spark, tmp_path):
    """The operator itself: other columns stay, those with a result's name go, and paths are written and read."""
    df = spark.range(100).select("id", (F.col("id") % 2).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(1).alias("ROOT"))
    done = merkle.prove(df, "leaf", "part", ["id"])
    assert done.columns == ["id", "part", "leaf", "subroot", "root", "path"]
    done.write.parquet(str(tmp_path / "x"))
    again = spark.read.parquet(str(tmp_path / "x"))
    assert again.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 100
    assert again.where(merkle.folded(F.sha2(F.lit("no"), 256), F.col("path")) == F.col("root")).count() == 0
    assert again.select("root").distinct().count() == 1 and again.select("subroot").distinct().count() == 2
    assert merkle.prove(df.limit(0), "leaf", "part", ["id"]).count() == 0


# 12 importance resampling
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, longest):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_ranks(docs, target, buckets, longest, percent, least, seed):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f in runs(x, longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = runs(text, longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), len(w)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    n = len(able) * percent // 100
    return sorted([(*r[:4], k + 1 if k < n else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least], key=repr)


@pytest.mark.parametrize(("longest", "joined"), [(1, 1 << 20), (3, 50), (2, 1)])
def test_resampling(spark, longest, joined, monkeypatch):
    monkeypatch.setattr(importance, "JOINED", joined)
    monkeypatch.setattr(importance.slices, "__defaults__", (joined,))
    rng = random.Random(2)
    letters = ["ab", "Ab", "é", "ÉA", "x1", "漢字", "\x00", "q-r", "z\x00y"]
    texts = [" ".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30]))) for _ in range(150)] + [None, "", "\x00", "w " * 9000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "ab " * 30)]
    target = ["ab x1 ab", None, "漢字 é", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"Weight": F.lit("x"), "rank": F.lit(0), "own": F.lit(1), "_text": F.lit(2)}).repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.ranked(df, aim, percent=30, min_words=4, seed="s", buckets=17, longest=longest)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)
    assert got == brute_ranks(docs, target, 17, longest, 30, 4, "s")
    drawn = importance.resampled(df, aim, percent=30, min_words=4, seed="s", buckets=17, longest=longest)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {x[0] for x in got if x[4]}


def test_weights_keep_columns(spark):
    df = spark.createDataFrame([(1, "A b", "keep")], "doc_id long, text string, N_WORDS string")
    out = importance.weighed(df, importance.gains(*(importance.bucket_counts(df) for _ in range(2))))
    assert out.columns == ["doc_id", "n_words", "n_features", "weight"] and out.first()[1:] == (2, 2, 0)


def test_resampling_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.importance(none, none).count() == 0 and importance.importance(none, one).count() == 0
    assert [tuple(r) for r in importance.importance(one, none).select("doc_id", "n_features", "weight", "rank").collect()] == [(1, 2, math.floor(1000 * math.log(10002 / 20000)), None)]


def test_target_words_are_drawn(spark):
    """Documents of the target's words come out far above their share."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.repeat(F.lit("integral matrix vector "), 10)).otherwise(F.repeat(F.lit("buy cheap shoes "), 10)).alias("text"))
    aim = spark.createDataFrame([("matrix integral vector",)] * 50, "text string")
    drawn = [r.doc_id for r in importance.ranked(docs, aim).where("rank is not null").collect()]
    assert len(drawn) == 200 and sum(i % 10 == 0 for i in drawn) > 150


# 13 URL filters
def brute_url(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: (len(str(r)), len(r.host)), default=None)
    labels = host.split(".")
    keys = {".".join(labels[i:]) + "/" for i in range(len(labels)) if ".".join(labels[i:])} | ({host + path} if len(path) > 1 and host else set())
    held = any(k in listed for k in keys)
    return host, path, str(rule) if rule else None, held, rule.verdict if rule else "block" if held else "allow"


URLS = [None, "", "no url", "://", "http://", "HTTP://Www.Example.ORG/es/A?x=/en/1#y", "http://example.org", "http://example.org?q=/es/", "http://badexample.org/es/1", "https://a.b.example.com/de/", "x://y://z/1", "http://cheap-pills.net/a", "http://m.Cheap-Pills.net", "http://..a..//", "http://é.example.net/É", "http://h/" + "p/" * 5000, "http://" + "l." * 3000 + "cheap-pills.net/", "http://cheap-pills.net.example.net/1", "http://t.net/page", "http://t.net/page?x", "http://u.net/page/", "http://dup.net/1", "http://dup.net/1"]


@pytest.mark.parametrize("most_bits", [1 << 20, 8])
def test_urls(spark, most_bits):
    listed = {"cheap-pills.net/", "t.net/page", "absent.net/"}
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"Host": F.lit(1), "VERDICT": F.lit("x"), "key": F.lit(0), "_keys": F.lit(3)})
    keys = spark.createDataFrame([(k,) for k in [*listed, *listed, None]], "key string")
    got = url_filter.judged(df, url_filter.RULES, keys, most_bits=most_bits)
    assert got.columns == ["page_id", "url", "key", "_keys", "host", "path", "rule", "listed", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.listed, r.verdict) for r in got.collect()}
    assert got == {i: brute_url(u, url_filter.RULES, listed) for i, u in enumerate(URLS)}


def test_longest_rule_wins(spark):
    rules = [Rule("block", "net"), Rule("allow", "a.net", "/x"), Rule("block", "b.a.net", "/x"), Rule("allow", "a.net", "/x/yy"), Rule("allow", "net")]
    urls = [f"http://{h}{p}" for h in ("net", "a.net", "b.a.net", "c.b.a.net", "ba.net") for p in ("", "/", "/x", "/x/y", "/x/yy", "/X")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df, rules, spark.createDataFrame([], "key string")).collect()}
    want = {i: brute_url(u, rules, set()) for i, u in enumerate(urls)}
    assert got == {i: (w[2], w[4]) for i, w in want.items()}
    assert url_filter.kept(df, rules, spark.createDataFrame([], "key string")).columns == df.columns


@pytest.mark.parametrize(("n", "share"), [(3000, 0.01), (3000, 0.3), (40, 1.0), (50, 0.0)])
def test_cascade_is_exact(spark, n, share):
    rng = random.Random(n)
    keys = [f"k{i}" for i in range(n)]
    listed = {k for k in keys if rng.random() < share} | {f"absent{i}" for i in range(20 if share else 0)}
    universe = spark.createDataFrame([(k,) for k in keys * 2], "key string")
    made = url_filter.cascade(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    got = {r.key: r.h for r in universe.select("key", made.has(F.col("key")).alias("h")).distinct().collect()}
    assert got == {k: k in listed for k in keys}
    if share == 0.01:
        assert len(made.levels) > 1 and made.bits < 20 * len(listed) + 500


def test_urls_of_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filtered_urls(df).count() == 0
    assert url_filter.judged(df, [], spark.createDataFrame([], "key string")).count() == 0


def test_url_filter_is_native(spark):
    plan = url_filter.filtered_urls(spark.read.parquet(f"{DATA}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Join|Exchange", plan)
