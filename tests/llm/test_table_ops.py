"""Sharding, mixing, URL rules and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cleave.llm import mixing, sharding, url_filter
from tests.llm.test_text_ops import docs, near_rows, plain_components, plain_hits, quality_rows, sentence


# 7. Sharding.
def plain_best_fit(sizes, capacity, bins):
    room = [capacity] * (bins or 0)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (room[b], b))
        elif bins is None:
            b = len(room)
            room.append(max(capacity, sizes[i]))
        else:
            b = max(range(len(room)), key=lambda b: (room[b], b))
        room[b] -= sizes[i]
        out[i] = b
    return out


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 120))]
        for bins in (None, 5):
            assert sharding.best_fit_decreasing(sizes, 100, bins) == plain_best_fit(sizes, 100, bins)
    assert sharding.best_fit_decreasing([60, 50, 40, 30, 20], 100) == [0, 1, 0, 1, 1]
    assert len(set(sharding.best_fit_decreasing([500, 1, 1], 100))) == 2


def check_shards(rows, got, n=24):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want


def test_shards_are_near_equal(spark):
    rng = random.Random(3)
    rows = [(k, sentence(rng, rng.randint(0, 120))) for k in range(2500)] + [(9000, None), (9001, ""), (9002, None)]
    rows += [(5000 + k, "copies of one text " * 4) for k in range(40)] + [(20_000 + k, "a third of all " * 20) for k in range(900)]
    got = sharding.shard(docs(spark, rows, clash=True)).collect()
    check_shards(rows, got)
    size = defaultdict(int)
    homes = defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        homes[r["group_id"]].add(r["shard"])
    assert max(size.values()) <= 1.02 * min(size.values())
    hot = next(r["group_id"] for r in got if r["doc_id"] == 20_000)
    assert all(len(v) == 1 for k, v in homes.items() if k != hot) and len(homes[hot]) > 1


def test_shards_of_few_rows(spark):
    for rows in ([(1, "a")], [(None, "a"), (None, "a"), (2, "b " * 20_000)], [(1, "x"), (1, "x"), (1, "y")]):
        check_shards(rows, sharding.shard(docs(spark, rows)).collect())
    assert sharding.shard(docs(spark, [(1, "a")]).where("false")).count() == 0
    for i in (7, None):  # a hot group of one id
        got = sharding.shard(docs(spark, [(i, "one row many times " * 10)] * 2000)).collect()
        check_shards([(i, "one row many times " * 10)] * 2000, got)
        size = defaultdict(int)
        for r in got:
            size[r["shard"]] += r["size"]
        assert len(size) == 24 and max(size.values()) <= 1.1 * min(size.values())
    again = [sorted(map(str, sharding.shard(docs(spark, [(k, "t" * k) for k in range(50)])).collect())) for _ in range(2)]
    assert again[0] == again[1]


# 9. Mixing.
def plain_targets(sizes, weights):
    """Water is poured in until all is gone; a source that reaches its brim takes no more."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_ and rest > 1e-9:
        per = min([rest / sum(weights[i] for i in open_), *((3 * sizes[i] - out[i]) / weights[i] for i in open_)])
        for i in open_:
            out[i] += per * weights[i]
        rest -= per * sum(weights[i] for i in open_)
        open_ = {i for i in open_ if out[i] < 3 * sizes[i] - 1e-9}
    return out


def test_targets():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 40, 300, 5000]) for _ in range(rng.randint(1, 9))]
        weights = [k % 3 + 1 for k in range(len(sizes))]
        got = [float(x) for x in mixing.targets(sizes, weights)]
        assert got == pytest.approx(plain_targets(sizes, weights), abs=1e-6) and sum(got) == pytest.approx(sum(sizes))


def test_knapsack_against_all_subsets():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 4)
        lengths, counts, budget = np.array(rng.sample(range(1, 12), n)), np.array([rng.randint(0, 3) for _ in range(n)]), rng.randint(0, 40)
        take = mixing.knapsack(lengths, counts, budget)
        reach = {0}
        for length, c in zip(lengths, counts, strict=True):
            reach = {s + k * length for s in reach for k in range(c + 1)}
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in reach if s <= budget)


def test_fit_is_near_and_fair():
    rng = np.random.default_rng(7)
    lengths, counts = np.arange(1, 800), rng.integers(0, 4, 799)
    total = int((lengths * counts).sum())
    for share in (0.1, 0.5, 0.9):
        take = mixing.fit(lengths, counts, int(total * share), 3)
        assert (0 <= take).all() and (take <= counts).all() and 0 <= int(total * share) - (take * lengths).sum() <= 2
        long = (lengths * take)[400:].sum() / (lengths * counts)[400:].sum()
        assert abs(long - share) < 0.1


def test_mix(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, rng.randint(0, 60)), None, rng.choice(["a", "a", "a", "b", "Z", None])) for k in range(900)]
    rows += [(2000 + k, "one length for all of these", None, "a") for k in range(700)] + [(3000, None, None, "b"), (3001, "x y", None, "tiny")]
    got = mixing.mix_sources(docs(spark, rows, clash=True)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    own = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    goal = dict(zip(names, plain_targets([own[s] for s in names], [k % 3 + 1 for k in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], own[s]) and r["target"] == pytest.approx(goal[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= max(60, 0.01 * goal[s]) or own[s] < 100 for s in names)
    assert sorted(got) == sorted(mixing.mix_sources(docs(spark, rows).repartition(7)).collect())
    assert mixing.mix_sources(docs(spark, rows).where("doc_id < 0")).count() == 0
    twins = mixing.mix_sources(docs(spark, [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, None, None, None)]))
    assert twins.count() == 3 and twins.agg(F.sum("taken")).first()[0] == 4


def test_short_and_long_documents_are_taken_alike():
    rng = np.random.default_rng(1)
    lengths = np.arange(16, 1200)
    counts = np.where(lengths < 64, 1, rng.integers(1, 12, len(lengths)))
    total, runs = int((lengths * counts).sum()), 60
    rates, off = np.zeros(len(lengths)), []
    for seed in range(runs):
        take = mixing.fit(lengths, counts, int(total * 0.45), seed)
        rates += take / counts / runs
        off.append(int(total * 0.45) - int((take * lengths).sum()))
    assert max(off) == 0 and abs(rates[lengths < 64].mean() - 0.45) < 0.06 and abs(rates[lengths >= 64].mean() - 0.45) < 0.02


def test_many_sources_are_weighed_alike(spark, monkeypatch):
    rng = random.Random(4)
    sizes = [(f"s{k}é"[: rng.randint(1, 5)] + str(k), rng.choice([0, 1, 7, 90, 2000, 10**7])) for k in range(60)] + [(None, 55)]
    df = spark.createDataFrame(sizes, "source string, n bigint")
    few = sorted(map(tuple, mixing.plan_sources(df).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    many = sorted(map(tuple, mixing.plan_sources(df).collect()))
    assert [r[:3] + r[4:] for r in few] == [r[:3] + r[4:] for r in many] and [r[3] for r in few] == pytest.approx([r[3] for r in many])


def test_mix_counts_rows_without_or_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 3)
    rows = [(None, "a b c", None, "s")] * 7 + [(None, "d e f", None, "s"), (5, "g h i", None, "s"), (5, "j k l", None, "s"), (6, "m n o", None, "s")] + [(9, "p q r", None, "t")] * 5 + [(1, None, None, "t"), (2, "u " * 40, None, "z")]
    d = docs(spark, rows, clash=True)
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(rows)
    out = corpus_pipeline.mixing_stage(spark, d, "")
    assert out.columns == d.columns
    for source in "stz":
        here = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).where(F.col("c3") == source).collect()
        goal = next(r["target"] for r in got if r["source_size"] == {"s": 33, "t": 15, "z": 40}[source])
        size = 40 if source == "z" else 3
        assert abs(len(here) * size - goal) <= size
    texts = [(r[0], r[1]) for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()]
    assert all(texts.count(t) <= 3 * [(i, x) for i, x, _, _ in rows].count(t) for t in texts)


# 10. URLs.
def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/", "https://a.b.example.com/en/1",
    "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/esx", "http://x.net/fr/?q", "http://x.org/en/", "http://example.com?x=/en/", "http://example.com#/en/", "a://b://c/d", "http://ÉX.com/é",
    "http://example.com:80/en/", "http://.com/", "http://com./", "http://a..com/x", "http://x.net//es/", "http://x.net/es/\nline", "http://u@example.com/en/",
]


@pytest.mark.parametrize("rules", [url_filter.RULES, [], [("com", "", "block"), ("com", "/e", "allow"), ("example.com", "/en/", "allow"), ("b.example.com", "", "block"), ("net", "/es/", "allow"), ("net", "/es/", "block")]])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(None, URLS[7]), (7, URLS[7])], "page_id bigint, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("URL"))
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(URLS[r["page_id"]], rules), URLS[r["page_id"]]
    assert url_filter.filter_urls(pages.where("false"), url_filter.rule_table(spark, rules)).count() == 0


def test_urls_stay_in_the_jvm(spark):
    plan = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string"), url_filter.rule_table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# The pipeline.
def write_tables(spark, folder):
    rows, labels = quality_rows(200)
    near = [(1000 + i, t) for i, t in near_rows()]
    rng = random.Random(3)
    items = [(k, sentence(rng, 30)) for k in range(3)]
    planted = [(3000 + k, sentence(rng, 20) + " " + items[k % 3][1] + " " + sentence(rng, 20)) for k in range(6)]
    all_rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows + near + planted] + [(5000, None, None, None, None)]
    spark.createDataFrame(all_rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_pipeline_stage_by_stage(spark, tmp_path):
    items = write_tables(spark, str(tmp_path))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts = now.columns, {r["doc_id"]: r["text"] for r in now.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    left = [(i, texts[i]) for i in texts]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "quality_classifier":
            bad = {i for i in ids if i < 200 and i % 3 == 0}
            assert not bad and {i for i in range(200) if i % 3} <= set(ids)
        elif name == "minhash_near_dedup":
            assert sorted(ids) == sorted(i for i, _, _, kept in plain_components(left) if kept)
        elif name == "benchmark_decontamination":
            assert sorted(ids) == sorted(r[0] for r in plain_hits(left, items) if not r[5])
        elif name == "mixing":
            took = {r["doc_id"]: r["repeats"] for r in mixing_of(now).collect()}
            assert sorted(ids) == sorted(i for i, n in took.items() for _ in range(n))
        else:
            check_shards([(r["doc_id"], r["text"]) for r in now.collect()], out.collect())
            break
        assert out.columns == columns
        now, left = out, [(i, texts[i]) for i in ids]


def mixing_of(df):
    return mixing.mix_sources(df)


def test_pipeline_runs(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 50 and {"doc_id", "shard", "slot"} <= set(got.columns)


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    d = docs(spark, [(1, "a text of some words here"), (1, "a text of some words here"), (2, "A text of some words here"), (None, "x y"), (None, None)])
    assert sorted((r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, d, str(tmp_path)).collect()), key=str) == [1, None, None]


def test_pipeline_drops_near_copies_without_an_id(spark):
    rng = random.Random(19)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(4, a), (None, a + " end"), (None, a), (None, b), (None, b + " end"), (None, b), (None, ""), (None, ""), (None, None)]
    out = corpus_pipeline.dedup_stage(spark, docs(spark, rows, clash=True), "")
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    assert len(got) == 5 and (4, a) in got and sum(t in (b, b + " end") for _, t in got) == 1 and [t for _, t in got].count("") == 2


def test_pipeline_keeps_different_texts_of_one_id(spark, tmp_path):
    rng = random.Random(9)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(5, a), (5, b), (5, b.upper()), (3, c), (5, c + " end"), (7, a), (8, ""), (8, "")]
    for order in (rows, rows[::-1]):
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs(spark, order), str(tmp_path)).collect()]
        assert len(got) == 4 and {(i, (t or "").lower()) for i, t in got} == {(3, c.lower()), (5, a.lower()), (5, b.lower()), (8, "")}


def test_knapsack_of_long_documents():
    lengths, counts = np.array([20_000, 30_000, 50_000]), np.ones(3, np.int64)
    for seed in range(30):
        assert int((lengths * mixing.fit(lengths, counts, 70_000, seed)).sum()) == 70_000
    lengths = np.array(sorted(random.Random(2).sample(range(20_000, 60_000), 40)))
    gaps = [budget - int((lengths * mixing.fit(lengths, np.ones(40, np.int64), budget, 1)).sum()) for budget in range(300_000, 1_200_000, 90_000)]
    assert 0 <= min(gaps) and max(gaps) < 500
