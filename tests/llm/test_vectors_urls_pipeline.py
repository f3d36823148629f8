"""Nearest neighbours, URL filters and the pipeline."""

import functools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from motifmill.llm import ann, queries, url_filter


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, bucket string, tbl int")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_rotations_keep_angles():
    x = np.random.default_rng(0).normal(size=(20, 48))
    y = ann.rotations(x, 3, 0)[:, ::2]
    assert y.shape == (20, 64) and np.allclose(y @ y.T, x @ x.T)
    codes = ann.buckets(x / np.linalg.norm(x, axis=1, keepdims=True), 1, 2, 9)
    assert codes.shape == (20, 9) and all(len(set(c)) == 9 for c in codes.tolist())


def test_small_tables_give_all_candidates(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (50, [-1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [math.nan, 1.0, 0.0]), (100, [math.inf, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (150, []), (7, [1.0, 0.0])]
    got = found(ann.nearest(vectors(spark, rows)))
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == {0: [1, 50], 50: [1, 0]}
    assert got[0][0][2] == pytest.approx(0.9 / math.hypot(0.9, 0.1), abs=1e-7) and got[0][1][2] == -1.0
    assert ann.nearest(vectors(spark, rows).limit(0)).count() == 0


def test_ties_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=16).round(2).tolist()
    rows = [(i, hot) for i in range(600)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(400)] + [(2, hot)]
    got = found(ann.nearest(vectors(spark, rows)))
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for _, v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-12 for _, _, s in got[50]) and [r for r, _, _ in got[50]] == [1, 2, 3, 4, 5]


def test_blocks_and_depths(spark, monkeypatch):
    """Small blocks on both sides, deeper tables, and queries and rows that share vectors: exact where every bucket is looked into."""
    rng = np.random.default_rng(3)
    base = [rng.normal(size=8).tolist() for _ in range(60)]
    rows = [(i, base[int(rng.integers(60))]) for i in range(900)]
    want = ann.exact_nearest(np.array([i for i, _ in rows]), np.array([v for _, v in rows]).astype(np.float32).astype(float))
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "ASKED", 2)
    for depth, probes in ((1, 16), (2, 256)):
        got = found(ann.nearest(vectors(spark, rows), depth=depth, probes=probes, tables=2))
        assert {q: [(v, s) for _, v, s in x] for q, x in got.items()} == want
    assert ann.depth_for(10**5, 64) == 1 and ann.depth_for(10**8, 64) == 2 and ann.depth_for(10**12, 64) == 3


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_recall(spark, scale):
    table = pq.read_table(f"/root/testdata/{scale}/embeddings.parquet")
    x = table["embedding"].combine_chunks().values.to_numpy().reshape(table.num_rows, -1).astype(float)
    want = ann.exact_nearest(table["vec_id"].to_numpy(), x)
    got = found(ann.nearest(spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")))
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, w in want.items():
        exact = dict(w)
        assert all(s == exact[v] for _, v, s in got[q] if v in exact)


def page_rows():
    rng = random.Random(6)
    hosts = [f"{a}.example.{t}" for a in ("a", "b", "www.c") for t in ("org", "com", "net")] + ["com", "xorg", "org", "EXAMPLE.ORG", "h.fr:80"]
    rows = []
    for k in range(400):
        url = rng.choice(["http://", "HTTPS://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(["", "/", "/es/1", "/en/1", "/en/19?x", "/fr/a#b", "/de/", "/de?/x", "?q=/de/", "#z"])
        links = "".join(f'<a {rng.choice(["href", "HREF", "src"])}={rng.choice([chr(34), chr(39), ""])}{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}{rng.choice(["/p", "", "?x"])}{chr(34)}>' for _ in range(rng.randint(0, 4)))
        rows.append((k, url, f"<p>{links}<a href='/own'></a>"))
    return rows + [(None, None, None), (1000, "no host", None), (1001, "://", ""), (7, rows[7][1], rows[7][2])]


def test_urls_match_sql(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = [tuple(r) for r in url_filter.judge_urls(pages).collect()]
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    frame["page_id"] = frame["page_id"].astype("Int64")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT page_id::BIGINT AS page_id, url, html FROM frame")
    want = c.execute(url_filter.URL_SQL).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(got) == len(rows) and {"allow", "block"} == {r[4] for r in got if r[3] is None}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_distrust_goes_to_those_that_link_to_blocked_hosts(spark):
    rules = (("allow", "good.org/"), ("block", "bad.net/"))
    rows = [(0, "http://good.org/", "<a href=//nice.org/>"), (1, "http://bad.net/x", ""), (2, "http://spam.com/", "<a href='http://BAD.net/'>"), (3, "http://nice.org/a", ""), (4, "http://plain.com/", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=rules).collect()}
    assert got == {0: ("good.org/", "allow"), 1: ("bad.net/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow")}


def shut_by_links(spark, tmp_path, monkeypatch, links, rules):
    """By the registered query: hosts that no rule judges: those blocked, and those that should be, from ranks solved as linear systems. One page a host."""
    hosts = sorted({h for e in links for h in e})
    given = {r.rstrip("/"): v for v, r in rules}
    rows = [(k, f"http://{h}/", "".join(f"<a href=//{b}/>" for a, b in sorted(links) if a == h)) for k, h in enumerate(hosts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(url_filter, "judge_urls", functools.partial(url_filter.judge_urls, rules=rules))
    judged = queries.op10_url_filter(spark, str(tmp_path)).collect()
    assert len(judged) == len(hosts)
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        m[hosts.index(b), hosts.index(a)] = 1
    rank = []
    for step, kind in ((m / np.maximum(m.sum(0), 1), "allow"), (m.T / np.maximum(m.sum(1), 1), "block")):
        seed = np.array([given.get(h) == kind for h in hosts], float)
        rank.append(np.linalg.solve(np.eye(len(hosts)) - 0.85 * step, 0.15 * seed / max(seed.sum(), 1)))
    want = {h for h, t, d in zip(hosts, *rank, strict=True) if h not in given and d > t * (1 + 1e-9)}
    return {r.host for r in judged if r.rule is None and r.verdict == "block"}, want


def chain(*hosts):
    return set(zip(hosts, hosts[1:], strict=False))


def test_distrust_reaches_any_distance_and_share(spark, tmp_path, monkeypatch):
    """13 links to a blocked host, and 7 links through hosts that 100 hosts link to."""
    far, wide = [f"f{k}.com" for k in range(13)], [f"w{k}.com" for k in range(8)]
    crowd = {(f"c{k}-{j}.com", w) for k, w in enumerate(wide[1:]) for j in range(99)}
    got, want = shut_by_links(spark, tmp_path, monkeypatch, chain(*far, "bad.net") | chain(*wide, "bad.net") | crowd, (("allow", "good.org/"), ("block", "bad.net/")))
    assert got == {*far, *wide, *(c for c, _ in crowd)}
    assert want <= got


def test_settled_ranks_decide(spark, tmp_path, monkeypatch):
    """Eight links before a blocked host the settled distrust is 0.041, the remainder of eight rounds 0.27, and the trust 0.064."""
    near = [f"n{k}.com" for k in range(8)]
    got, want = shut_by_links(spark, tmp_path, monkeypatch, chain(*near, "bad.net") | {("good.org", near[0]), ("good.org", "other.org")}, (("allow", "good.org/"), ("block", "bad.net/")))
    assert near[0] not in got and got == want


def test_ranks_on_cycles(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    hosts = [f"h{k}.com" for k in range(60)]
    links = {(a, b) for a in hosts for b in rng.sample(hosts, rng.randint(0, 3)) if a != b} | chain("t.com", "h7.com", "t.com")
    rules = tuple((("allow", "block")[k % 2], f"h{k}.com/") for k in range(6))
    got, want = shut_by_links(spark, tmp_path, monkeypatch, links, rules)
    assert got == want and 5 < len(want) < 50


def test_equal_ranks_are_allowed(spark, tmp_path, monkeypatch):
    """A host as far from the trusted host as from the blocked one, on a cycle of links that never ends."""
    monkeypatch.setattr(url_filter, "EQUAL", 1e-3)  # fewer rounds
    links = {("good.org", "even.com"), ("even.com", "bad.net"), ("good.org", "bad.net"), ("bad.net", "good.org")}
    got, want = shut_by_links(spark, tmp_path, monkeypatch, links, (("allow", "good.org/"), ("block", "bad.net/")))
    assert got == want == set()
