"""Exact, near and line deduplication against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voxelflow.llm import exact_dedup as ex, line_dedup as li, minhash as mh, queries
from voxelflow.llm.components import components

from .conftest import ODD, odd_cases


def words(r, n, size=4000):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.integers(1, 9))
@settings(deadline=None, max_examples=60)
def test_rice_round_trip(values, owners):
    v = np.array(sorted(values), np.uint64)
    for i in range(owners):
        low, high = ex.owner_base(i, owners), ex.owner_base(i + 1, owners)
        part = v[(v >= np.uint64(low)) & (v <= np.uint64(high - 1))]
        assert np.array_equal(ex.rice_decode(ex.rice_encode(part, low), low), part)


def test_exact(docs):
    r = random.Random(1)
    base = [words(r, 30) for _ in range(40)]
    rows = [(i, r.choice(base) if r.random() < 0.5 else words(r, 20)) for i in range(300)]
    rows = [(i, t.replace(" ", r.choice((" ", "  ", "\n"))) if r.random() < 0.3 else t) for i, t in rows]
    got = {x.doc_id: x for x in ex.exact_duplicates(docs(rows).repartition(7)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    for norm, members in groups.items():
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(members)[1], len(members), i == min(members)[1])
            assert got[i].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_odd(docs):
    rows = odd_cases(docs, ex.exact_duplicates, len(ODD))
    empty = [x for x in rows if x.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {x.keep_id for x in empty} == {3}  # of the blank ones the longest stays
    assert [x.group_size for x in rows if x.doc_id == 4] == [2, 2]


def links(rows, percent):
    sets = [mh_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def mh_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


@pytest.mark.parametrize("percent", [85, 80])
def test_near(docs, percent):
    r = random.Random(2)
    rows = []
    for _ in range(25):
        base = words(r, r.randrange(3, 200)).split()
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(99)}"
            rows.append((len(rows) + 5, " ".join(copy)))
    rows += [(1, "one two"), (2, "ONE two"), (3, "one two three")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in mh.near_duplicates(docs(rows), percent=percent).collect()}
    assert got == links(rows, percent)


def thue_morse(k):
    return "".join("ab"[i.bit_count() % 2] for i in range(1 << k))


def test_words_that_a_polynomial_hash_confuses(docs):
    """Words whose sums of powers are equal modulo 2**64 are different words."""
    flip = str.maketrans("ab", "ba")
    rows = [(10 * k + i, w) for k in (10, 11, 12) for i, w in enumerate((thue_morse(k), thue_morse(k).translate(flip)))]
    got = mh.near_duplicates(docs(rows)).collect()
    assert all(x.component_id == x.doc_id and x.n_shingles == 1 for x in got)


@pytest.mark.parametrize("percent", [85, 80])
def test_crowded_templates(docs, monkeypatch, percent):
    """A long common part, own parts of all sizes, and edited copies among them: as brute force, whatever a block holds."""
    r = random.Random(12)
    common = words(r, 90, 10**6)
    rows = []
    for _ in range(40):
        own = words(r, r.randrange(8, 40), 10**6).split()
        for _ in range(r.choice((1, 1, 2, 4))):
            copy = list(own)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), common + " " + " ".join(copy)))
    want = links(rows, percent)
    assert 10 < len({c for _, c in want.values()}) < len(rows)
    for block in (4,):
        monkeypatch.setattr(mh, "BLOCK", block)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in mh.near_duplicates(docs(rows), percent=percent).collect()}
        assert got == want


def test_near_odd(docs):
    rows = odd_cases(docs, mh.near_duplicates, len(ODD))
    assert all(x.component_id == x.doc_id and x.kept for x in rows)
    assert sorted(x.n_shingles for x in rows) == [0, 0, 0, 0, 1, 1, 1, 1, 3][: len(rows)] or len(rows) == len(ODD)


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {x.node: x.root for x in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.integers(1, 3))
@settings(deadline=None, max_examples=300)
def test_banded_distance(a, b, limit):
    assert li.within(a, b, limit) == (distance(a, b) <= limit)


def lines_kept(rows, edits=2):
    """In plain Python, by comparing every line with every earlier one."""
    seen, out = [], {}
    for i, text in sorted(rows):
        drop = set()
        for no, line in li.lines_of(text):
            if any(line == s or distance(line, s) <= edits for s in seen):
                drop.add(no)
            seen.append(line)
        out[i] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
    return out


def test_lines(docs):
    r = random.Random(3)
    pool = [words(r, 7, 60) for _ in range(14)]

    def line():
        x = r.choice(pool)
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            k = r.randrange(len(x))
            x = r.choice((x[:k] + "z" + x[k + 1 :], x[:k] + x[k + 1 :], x[:k] + "é" + x[k:]))
        return r.choice((x, x, " " + x, "short", words(r, 9, 5000)))

    rows = [(i, "\n".join(line() for _ in range(r.randrange(1, 6)))) for i in range(40)]
    got = {x.doc_id: x.text for x in li.without_repeated_lines(docs(rows)).collect()}
    assert got == lines_kept(rows)


def test_crowded_lines(docs, monkeypatch):
    """A common beginning, near copies of a line, and lines that share a segment only: as brute force where all keys are crowded."""
    monkeypatch.setattr(li, "BLOCK", 6)
    monkeypatch.setattr(li, "OFTEN", 2)
    r = random.Random(13)
    start, base = words(r, 4), words(r, 9)

    def line():
        x = r.choice((f"{start} {words(r, 2)} {words(r, 2)}", base, base, f"{words(r, 2)} {start} {start} {r.randrange(30)}"))
        for _ in range(r.choice((0, 1, 2, 3))):
            k = r.randrange(len(x))
            x = r.choice((x[:k] + "z" + x[k + 1 :], x[:k] + x[k + 1 :], x[:k] + "y" + x[k:]))
        return x

    rows = [(i, "\n".join(line() for _ in range(r.randrange(1, 6)))) for i in range(60)]
    want = lines_kept(rows)
    assert 20 < sum(t != want[i] for i, t in rows) < 60
    assert {x.doc_id: x.text for x in li.without_repeated_lines(docs(rows).repartition(3)).collect()} == want


def test_lines_with_many_equal_characters(docs):
    """Near copies whose counts of a character lie on either side of 256 and 512."""
    r = random.Random(4)
    for n in (256, 512):
        tail = words(r, 20)
        a, b = "x" * n + tail, "x" * (n - 1) + "-" + tail
        got = {x.doc_id: x.text for x in li.without_repeated_lines(docs([(1, a), (2, b)])).collect()}
        assert got == {1: a, 2: ""}


def test_short_lines_that_are_equal(docs, spark, tmp_path):
    """In op9, too; near copies of short lines and blank lines stay."""
    rows = [(1, "All rights reserved.\n\nYes"), (2, " All rights reserved.\n\nYes\nAll rights reserved!"), (3, "yes\nYes")]
    got = {x.doc_id: x.text for x in li.without_repeated_lines(docs(rows), shorter=True).collect()}
    assert got == {1: rows[0][1], 2: "\nAll rights reserved!", 3: "yes"}
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.n_removed for x in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 1}


def test_lines_odd(docs):
    rows = odd_cases(docs, lambda d: li.without_repeated_lines(d).select("doc_id", "text", "n_removed"), len(ODD))
    assert Counter(x.text for x in rows if x.text is None or len(x.text) < 30) == Counter(t for _, t in ODD if t is None or len(t) < 30)
    again = li.without_repeated_lines(docs([(1, "a\n" + "y" * 40), (2, "y" * 39 + "\nb"), (None, "y" * 41)]))
    assert {x.doc_id: x.text for x in again.collect()} == {1: "a\n" + "y" * 40, 2: "b", None: ""}


def test_components_take_few_rounds_of_planning(spark):
    """A chain of 3,000 nodes in random order."""
    r = random.Random(9)
    names = r.sample(range(10**6), 3000)
    links = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    got = components(links).collect()
    assert len(got) == 3000 and {x.root for x in got} == {min(names)}
