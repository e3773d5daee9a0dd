"""URL rules, packing, and the pipeline."""

import importlib.util
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelflow.llm import packing as pk, url_filter as uf

from .conftest import ODD, odd_cases

DATA = "/root/testdata/sf0.001"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def judged(host, path):
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    hosts = ["example.com", "A.Example.COM", "com", "xcom", "net", "b.example.net", "org", "w.org", "É.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x", "/de/8", "/de/9#t", "/es/", "/es", "?en/", "#", "/en/6/en/7"]
    rows = [(i, f"http://{h}{p}", None) for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None, "<a href=//x.y>"), (901, "no scheme", None), (902, "://", ""), (903, "a://b://c/en/", None)]
    got = {x.page_id: x for x in uf.judge_urls(pages(spark, rows)).collect()}
    for i, url, _ in rows:
        host, path = host_path(url)
        rule = judged(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.text if rule else None)
        if rule:
            assert got[i].verdict == rule.verdict
        assert got[i].verdict in ("allow", "block")
    assert got[900].verdict == "allow"
    assert uf.judge_urls(pages(spark, [])).collect() == []


def test_links_carry_trust_and_distrust(spark):
    link = lambda *to: " ".join(f'<a class=x href="https://{t}/p">t</a>' for t in to)
    rows = [(1, "http://good.example.net/de/1", link("friend.info")), (2, "http://bad.example.com/en/1", link("bad.example.com")), (3, "http://farm.biz/x", link("bad.example.com")), (4, "http://friend.info/x", None), (5, "http://alone.dev/", "")]
    got = {x.page_id: x.verdict for x in uf.judge_urls(pages(spark, rows)).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_pages_odd(spark):
    """Repeated rows, null ids, urls and html, a very long url, columns with names used inside."""
    rows = [(None, "http://a.example.com/en/1", None), (1, None, None), (2, "", ""), (3, "http://b.org/x", "<a href=//b.org:80/>"), (3, "http://b.org/x", "<a href=//b.org:80/>"), (4, "http://" + "x" * 50_000 + ".net/de/" + "y" * 50_000, "<a" * 1000), (5, "http:///", "<a href='//'>"), (6, "ftp://u:p@c.com:21/en/z", None)]
    plain = sorted(map(str, uf.judge_urls(pages(spark, rows)).collect()))
    more = pages(spark, rows)
    for name in ("host", "path", "rule", "verdict", "id", "r", "trust", "to", "src", "t", "node", "salt"):
        more = more.withColumn(name, F.lit("7"))
    assert sorted(map(str, uf.judge_urls(more).collect())) == plain and len(plain) == len(rows)
    got = {x.page_id: x for x in uf.judge_urls(pages(spark, rows)).collect()}
    assert got[None].rule == "com/en/" and got[4].rule == "net/de/" and got[6].host == "u:p@c.com:21" and got[5].host == got[1].host == ""


def test_ports_and_users_meet_in_the_graph(spark):
    link = lambda t: f'<a href="http://{t}/p">t</a>'
    rows = [(1, "http://good.net/de/1", link("plain.info") + link("farm.biz:8080") + link("u@home.dev")), (2, "http://farm.biz:8080/x", None), (3, "http://plain.info/x", None), (4, "http://home.dev/", None), (5, "http://farm.biz/x", None)]
    got = {x.page_id: x for x in uf.judge_urls(pages(spark, rows)).collect()}
    assert got[2].host == "farm.biz:8080" and got[2].trust == got[3].trust == got[4].trust == got[5].trust > 0


def test_domains_end_where_they_are_registered(spark):
    hosts = ["a.b.example.com", "x.co.uk", "y.z.co.uk", "10.0.0.1", "com", "www.de", "w.ab.de"]
    df = spark.createDataFrame([(h, None) for h in hosts], "host string, html string")
    got = {(x.src, x.dst) for x in uf.host_edges(df).collect()}
    up = {("a.b.example.com", "b.example.com"), ("b.example.com", "example.com"), ("y.z.co.uk", "z.co.uk"), ("w.ab.de", "ab.de")}
    assert got == up | {(b, a) for a, b in up}


def test_long_chains_are_followed(spark, monkeypatch):
    """Trust goes down a chain of 30 hosts, and distrust up one; alike where scores aren't broadcast and all hosts are crowded."""
    link = lambda t: f'<a href="http://{t}/p">t</a>'
    rows = [(0, "http://t0.net/de/1", link("t1.info"))] + [(i, f"http://t{i}.info/", link(f"t{i + 1}.info")) for i in range(1, 31)]
    rows += [(100 + i, f"http://d{i}.info/", link(f"d{i + 1}.info" if i < 30 else "bad.org")) for i in range(31)] + [(200, "http://bad.org/es/", None)]
    got = {x.page_id: x for x in uf.judge_urls(pages(spark, rows)).collect()}
    assert all(got[i].trust > 0 == got[i].distrust for i in range(31)) and got[30].trust < got[1].trust
    assert all(got[100 + i].verdict == "block" for i in range(31))
    monkeypatch.setattr(uf, "SMALL", 0)
    broadcast = {x.page_id: x for x in uf.judge_urls(pages(spark, rows)).collect()}
    assert all(math.isclose(got[i].trust, broadcast[i].trust, rel_tol=1e-9) and math.isclose(got[i].distrust, broadcast[i].distrust, rel_tol=1e-9) for i in got)
    monkeypatch.setattr(uf, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(uf, "CROWDED", 1)
    monkeypatch.setattr(uf, "SALTS", 3)
    again = {x.page_id: x for x in uf.judge_urls(pages(spark, rows), tolerance=4e-3).collect()}
    assert all(math.isclose(got[i].trust, again[i].trust, rel_tol=1e-9, abs_tol=1e-2) and math.isclose(got[i].distrust, again[i].distrust, rel_tol=1e-9, abs_tol=1e-2) and got[i].verdict == again[i].verdict for i in got)


def test_propagation_against_numpy(spark):
    r = random.Random(7)
    names = [f"h{i}" for i in range(12)]
    edges = {(a, b): float(r.randrange(1, 5)) for a in names for b in r.sample(names, 3) if a != b}
    seeds = [(n, r.randrange(4), r.randrange(3)) for n in names]
    got = {x.host: (x.trust, x.distrust) for x in uf.propagate(spark.createDataFrame(seeds, "host string, allowed long, blocked long"), spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")).collect()}
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((12, 12))
    for (a, b), w in edges.items():
        m[at[a], at[b]] = w
    forth, back = m / m.sum(1, keepdims=True), (m / np.maximum(m.sum(0), 1e-300)).T
    for k, way in ((1, forth), (2, back)):
        s = np.array([x[k] for x in seeds], float)
        s /= max(1, s.sum())
        v = s.copy()
        for _ in range(200):
            v = 0.15 * s + 0.85 * way.T @ v
        assert all(math.isclose(got[n][k - 1], v[at[n]], abs_tol=1e-4) for n in names if n in got)


def test_encoder_is_exact():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    r = random.Random(8)
    bits = ["Word", "don't", "it's.", "a.b", "x²,", "½.", "e\u0301.", "ª.", "99,", "...", "'s", "İI", "ΣΑΣ", "ß!", "%%%", "of%%%", "\u00a0", "\u3000", "\x1c", "\x85", "漢字。", "😀!", "<|endoftext|>", "q" * 300, "a" * 70 + ".", "\n", "\t", "'", "he'll,", "-", "_x_", "K.", "ﬁ."]
    texts = ["".join(r.choice(bits) + r.choice(("", " ", " ", "\n")) for _ in range(r.randrange(0, 12))) for _ in range(1500)]
    got = pk.WordEncoder(path)(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_fullest_against_all_subsets():
    r = random.Random(9)
    for _ in range(300):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(0, 5))}
        room = r.randrange(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = pk.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in got)


def test_bins_hold_everything_once():
    r = random.Random(10)
    counts = {r.randrange(1, 2049): r.randrange(1, 40) for _ in range(300)}
    plan = pk.minimum_bin_slack(counts)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 2048 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in plan) <= least_bins(counts, 2048) * 1.02 + 1


def least_bins(counts, capacity):
    """A lower bound: lengths above half need a bin each, and what is left beside them must hold the middling ones."""
    best = 0
    for a in range(capacity // 2 + 1):
        huge = sum(n for x, n in counts.items() if x > capacity - a)
        large = {x: n for x, n in counts.items() if capacity / 2 < x <= capacity - a}
        rest = sum(x * n for x, n in counts.items() if a <= x <= capacity / 2) - sum((capacity - x) * n for x, n in large.items())
        best = max(best, huge + sum(large.values()) + max(0, -(-rest // capacity)))
    return best


def packed(rows, out):
    """Checks pieces against the tokenizer, and that sequences have neither gaps nor overlaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, want)) == sorted(str((x.doc_id, x.piece, x.start, x.length, x.ids_crc32)) for x in out)
    sequences = {}
    for x in out:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing(docs):
    r = random.Random(11)
    rows = [(i, "word " * r.choice((1, 5, 5, 5, 300, 700, 5000))) for i in range(120)]
    packed(rows, pk.pack(docs(rows).repartition(6)).collect())
    packed(ODD, odd_cases(docs, lambda d: pk.pack(d).drop("sequence_id", "offset")) and pk.pack(docs(ODD)).collect())


@pytest.mark.skipif(not os.path.isdir(DATA) or importlib.util.find_spec("corpus_pipeline") is None, reason="no data")
def test_pipeline(spark):
    """Each stage against what it must do, and run() against the stages one by one."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in cp.STAGES:
        before = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            after = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
            assert set(after) <= set(before)
            assert all(x.n_chars == len(x.text) for x in docs.collect()) or name == "toxicity"
            rows[name] = (before, after)
        else:
            packed([(i, t) for i, t in before.items()], out.collect())
            pieces = {(x.doc_id, x.piece, x.ids_crc32) for x in out.collect()}
    before, after = rows["line_dedup"]
    assert set(after) == set(before) and all(len(after[i]) <= len(before[i]) for i in after)
    before, after = rows["near_dedup"]
    assert 0 < len(after) < len(before) and all(after[i] == before[i] for i in after)
    before, after = rows["pii"]
    assert set(after) == set(before) and any("[EMAIL]" in t for t in after.values())
    assert {(x.doc_id, x.piece, x.ids_crc32) for x in cp.run(spark, DATA).collect()} == pieces


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", empty), ("labels", spark.createDataFrame([], "doc_id long, quality long, toxic long"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], empty.schema)
    odd.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() >= 5


def test_new_words_of_letters_are_one_text(monkeypatch):
    """The tokenizer gets few texts for many new words, and every word still has its own ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, tokenizer, sent = pk.WordEncoder(path), Tokenizer.from_file(path), []
    whole = pk.WordEncoder._encode
    monkeypatch.setattr(pk.WordEncoder, "_encode", lambda self, texts: sent.extend(texts) or whole(self, texts))
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghßéñöªþŉ", k=r.randint(1, 12))) for _ in range(9000)] + ["x1", "it's", "don't", "中文", "क़ख", "..."]
    r.shuffle(words)
    texts = [" ".join(words[i : i + 90]) for i in range(0, len(words), 90)]
    got = encode(texts)
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(sent) < 20
