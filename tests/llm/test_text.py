"""Licences, toxicity, segmentations, personal data and fingerprints."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelflow.llm import lattice_sampling as ls, license_scan as lic, pii, simhash as sh, tagger, toxicity as tox
from voxelflow.llm.words import PLAIN, word_features, word_hashes

from .conftest import ODD, odd_cases


# ---- words ----------------------------------------------------------------------------------------------------------


def test_words_are_cut_alike():
    texts = ["a B  c\td", "", None, "A b\x0bc D", "x" * 3_000_000 + " y", "ab ab", "b a"]
    found = [x.tolist() for x in word_hashes(pa.array(texts))]
    assert [len(x) for x in found] == [4, 0, 0, 4, 2, 2, 2]
    assert found[0] == found[3] and found[5][0] == found[5][1] and found[6] == [found[0][1], found[0][0]]
    parts = next(word_features(pa.array(["don't stop"]), PLAIN, (2,)))
    assert parts.shape == (2, 3) and parts[1].tolist().count(0) == 1


# ---- licences -------------------------------------------------------------------------------------------------------


def test_patience():
    a, b = "x the quick brown fox the end".split(), "the quick red fox the end".split()
    assert lic.align(a, b) == [(1, 0), (2, 1), (4, 3), (5, 4), (6, 5)]
    assert lic.align([], b) == [] and lic.align(a, a) == [(i, i) for i in range(len(a))]
    assert lic.align(["p", "q"], ["q", "p"]) in ([(0, 1)], [(1, 0)])


def test_licenses(docs):
    mit, r = lic.TEMPLATES["MIT"], random.Random(1)
    noise = lambda n: " ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(n))
    worn = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    rows = [(1, noise(50) + "\n" + mit + "\n" + noise(50)), (2, worn), (3, noise(200)), (4, "x\nReleased under the MIT License.\ny\n" * 2), (5, "The software is provided to any person, free of charge.")]
    got = {x.doc_id: x for x in lic.scan_licenses(docs(rows)).collect()}
    assert got[1].license == "MIT" and got[1].coverage == 1.0
    start, end = map(int, re.search(r"MIT:(\d+):(\d+)", got[1].matches).groups())
    assert rows[0][1][start:end] == mit[:-1]
    assert got[2].license == "MIT" and 0.85 < got[2].coverage < 1
    assert got[3].license is None and got[5].license is None
    assert got[4].matches.count("MIT-line") == 2
    often = " ".join(f"{noise(r.randrange(3))} {mit}" for _ in range(5))
    assert lic.scan_licenses(docs([(1, often)])).first().n_matches == 5
    with pytest.raises(ValueError):
        lic.scan_licenses(docs(rows), {"none": "..."})


def test_licenses_with_words_between(docs):
    """A foreign word after each word, numbered lines, two columns: found, by an alignment of the whole text."""
    r = random.Random(3)
    other = lambda: "".join(r.choice("vwxyz") for _ in range(6))
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0"):
        plain = lic.TEMPLATES[name].split()
        between = " ".join(f"{w} {other()}" for w in plain)
        columns = "\n".join(" ".join(plain[i : i + 3]) + "   " + " ".join(other() for _ in range(5)) for i in range(0, len(plain), 3))
        rows = [(1, between), (2, columns), (3, f"{between}\n{' '.join(plain)}\n{between}"), (4, " ".join(other() for _ in range(99)) + " " + between)]
        got = {x.doc_id: x for x in lic.scan_licenses(docs(rows)).collect()}
        assert all(x.license == name and x.coverage == 1.0 for x in got.values())
        assert got[3].matches.count(f"{name}:") == 3
    scattered = " ".join(other() if i % 40 else ("all", "rights", "reserved")[i // 40 % 3] for i in range(400))
    assert lic.scan_licenses(docs([(1, scattered)])).first().n_matches == 0


def test_scanner_against_whole_text_alignment():
    """A template is found where patience aligns enough of it with the whole text, whatever was done to it."""
    r = random.Random(5)
    scanner = lic.Scanner(lic.TEMPLATES, lic.THRESHOLD)
    long = [n for n, t in lic.TEMPLATES.items() if len(lic.words(t)[0]) >= lic.LONG]
    hits = 0
    for _ in range(250):
        words = lic.words(lic.TEMPLATES[r.choice(long)])[0]
        keep, more = r.uniform(0.6, 1), r.choice((0, 0, 0.2, 1, 2))
        text = [w for x in words if r.random() < keep for w in (x, *(f"q{r.randrange(10**6)}" for _ in range(int(r.random() * 2 * more + 0.5))))]
        text = [f"p{r.randrange(10**6)}" for _ in range(r.randrange(40))] + text
        joined = " ".join(text)
        found = {scanner.names[t] for _, t, _, _ in scanner.scan(joined, next(iter(word_hashes(pa.array([joined]), PLAIN))))}
        for name in long:
            words = lic.words(lic.TEMPLATES[name])[0]
            if len(lic.align(text, words)) >= lic.THRESHOLD * len(words):
                assert name in found
                hits += 1
    assert 100 < hits < 250


def test_licenses_odd(docs):
    assert all(x.license is None and x.n_matches == 0 and x.matches == "" for x in odd_cases(docs, lic.scan_licenses, len(ODD)))


# ---- toxicity -------------------------------------------------------------------------------------------------------


def corpus(n, seed):
    r = random.Random(seed)
    bad = ["grimble", "vlorp", "snarxen", "quixard"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        text = [f"word{r.randrange(300)}" for _ in range(r.randrange(20, 200))]
        if toxic:
            for _ in range(r.randrange(2, 12)):
                text[r.randrange(len(text))] = r.choice(bad) + r.choice(("", "ed", "ing", ","))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(docs, spark):
    rows, labels = corpus(900, 1)
    model = tox.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (np.diff(model.cuts) > 0).all()
    rows, labels = corpus(400, 2)
    got = {x.doc_id: x for x in tox.score(docs(rows), model).collect()}
    right = sum(got[i].toxic == bool(y) for i, y in labels)
    assert right >= 0.96 * len(labels)
    many, few = ([got[i].severity for i, t in rows if lo <= len(re.findall("grimble|vlorp|snarxen|quixard", t)) <= hi] for lo, hi in ((8, 99), (2, 3)))
    assert np.mean(many) > np.mean(few) > 0.5
    kept = {x.doc_id for x in tox.without_toxic(docs(rows), model).collect()}
    assert kept == {i for i, x in got.items() if not x.toxic}


def test_ordinal_gradient():
    r = np.random.default_rng(1)
    x, w = r.normal(size=(3000, 3)), np.array([2.0, -1.0, 0.0])
    z = x @ w + r.logistic(size=3000)
    y = np.searchsorted([0.5, 2.0, 3.0], z)
    fitted, cuts = tox.fit_ordinal(x, y)
    assert np.allclose(fitted, w, atol=0.2) and np.allclose(cuts, [0.5, 2.0, 3.0], atol=0.25)


def test_likelihood_gradient():
    """Against differences of the likelihood, whose value is computed in plain Python, on sparse rows."""
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 6)) * (r.random((40, 6)) < 0.4)
    y = r.integers(0, tox.GRADES, 40)
    rows = tox.Sparse([(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in x], 6)
    at = r.normal(size=9)

    def value(v):
        cuts = [v[6], v[6] + math.exp(v[7]), v[6] + math.exp(v[7]) + math.exp(v[8])]
        above = lambda z, k: 1.0 if k < 0 else 0.0 if k > 2 else 1 / (1 + math.exp(cuts[k] - z))
        return sum(math.log(above(z, g - 1) - above(z, g)) for z, g in zip((x @ v[:6]).tolist(), y.tolist())) / 40 - 0.05 * sum(c * c for c in v[:6])

    got, grad = tox.likelihood(rows, y, at[:6], at[6:7], at[7:], 0.1)
    assert math.isclose(got, value(at), rel_tol=1e-9)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert math.isclose((value(at + step) - value(at - step)) / 2e-6, grad[k], rel_tol=1e-5, abs_tol=1e-8)


def test_toxicity_by_brute_force(docs, spark):
    """Scores against features counted word by word, with far more features than toxic words alone; no part of the vocabulary is cut."""
    r = random.Random(6)
    bad, good = ([f"{p}{i}x{i * 7 % 13}" for i in range(700)] for p in ("vile", "kind"))
    rows = [(i, " ".join(r.choice(bad if i % 4 == 0 else good) for _ in range(150))) for i in range(500)]
    model = tox.train(docs(rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert len(model.words) > 1000
    known = {int(w): i for i, w in enumerate(model.words)}
    for x in tox.score(docs(rows[:60]), model).collect():
        text = dict(rows)[x.doc_id].split()
        found = Counter()
        for w in text:
            for part in (next(tox._features(pa.array([w]))).ravel().tolist()):
                found[known.get(part, -1)] += 1
        z = sum(model.weights[i] * math.log2(1 + n) + model.weights[i + len(known)] * min(100 * n / 150, 5) for i, n in found.items() if i >= 0)
        above = [1 / (1 + math.exp(float(c) - z)) for c in model.cuts]
        assert math.isclose(x.severity, sum(above), abs_tol=2e-6) and x.toxic == (above[0] >= 0.5) == (x.doc_id % 4 == 0)


def test_grades_do_not_grow_with_length(docs, spark):
    rows, labels = corpus(900, 4)
    model = tox.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    mild = "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 word17 word18 word19 grimble "
    got = {x.doc_id: x for x in tox.score(docs([(1, mild * 2), (2, mild * 20), (3, "grimble vlorp snarxen quixard word1 " * 8)]), model).collect()}
    assert got[1].toxic and got[2].toxic and got[2].grade < 3 == got[3].grade


def test_toxicity_odd(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(docs(ODD), none)
    assert all(not x.toxic and x.grade == 0 for x in odd_cases(docs, lambda d: tox.score(d, model), len(ODD)))
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (99, 0), (4, 5)], "doc_id long, toxic int")
    tox.train(docs(ODD), odd)
    rows, labels = corpus(300, 3)
    model = tox.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd_cases(docs, lambda d: tox.score(d, model), len(ODD))


# ---- segmentations --------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every(text, v):
    """All segmentations of a text, with their probabilities."""
    table = {}
    for i, n in enumerate(v.ids):
        table[v.model.id_to_piece(int(n))] = float(v.weights[i])

    def walk(s):
        if not s:
            yield (), 0.0
        for n in range(1, min(len(s), v.longest) + 1):
            if s[:n] in table:
                for rest, p in walk(s[n:]):
                    yield (s[:n], *rest), table[s[:n]] + p

    found = {pieces: p for word in [ls.split_words(text)] for pieces, p in _product([list(walk("▁" + w)) for w in word])}
    total = np.logaddexp.reduce(list(found.values()))
    return {k: math.exp(p - total) for k, p in found.items()}


def _product(parts):
    for choice in itertools.product(*parts):
        yield tuple(x for c, _ in choice for x in c), sum(p for _, p in choice)


def test_samples_follow_the_lattice():
    v = ls.vocabulary(PATH, 0.3)
    want = every("no is", v)
    keys = np.arange(6000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    known = ls.Lattices(v)
    batch = ls.Batch([ls.split_words("no is")] * len(keys), known)
    first, pairs = Counter(), Counter()
    for found, below in ls.sample_batch(batch, keys, 2):
        names = [tuple(v.model.id_to_piece(int(i)) for i in batch.ids(s.pieces)) for s in found]
        assert len(set(names)) == 2 and found[0].value >= found[1].value >= below
        assert all(math.isclose(math.exp(s.logp), want[n], rel_tol=1e-5) for s, n in zip(found, names, strict=True))
        first[names[0]] += 1
        pairs[names[1]] += 1
    for name, p in want.items():
        assert abs(first[name] / len(keys) - p) < 4 * math.sqrt(p * (1 - p) / len(keys)) + 1e-3
        second = sum(q * p / (1 - q) for other, q in want.items() if other != name)
        assert abs(pairs[name] / len(keys) - second) < 4 * math.sqrt(second * (1 - second) / len(keys)) + 1e-3


def test_all_segmentations_come_before_the_end():
    v = ls.vocabulary(PATH, 0.3)
    want = every("no", v)
    batch = ls.Batch([ls.split_words("no")], ls.Lattices(v))
    (found, below), = ls.sample_batch(batch, np.array([7], np.uint64), len(want) + 5)
    assert len(found) == len(want) and below == -np.inf
    assert {tuple(v.model.id_to_piece(int(i)) for i in batch.ids(s.pieces)) for s in found} == set(want)


def test_segmentations_decode(docs):
    rows = [(i, t) for i, t in enumerate(["Hello  world\n a\tb  ", "  lead", "é 漢字 😀", "▁ literal ▁▁", "word " * 40, "q" * 90])]
    out = ls.decode(ls.sample_segmentations(docs(rows), k=3)).collect()
    model = ls.vocabulary(PATH, 1.0).model
    assert all(x.text == model.decode(list(x.ids)) for x in out if "▁" not in x.text)
    assert all(x.text == dict(rows)[x.doc_id] for x in out)
    assert all(0 <= x.inclusion <= 1 and x.log_prob <= 0 for x in out)
    ids = Counter((x.doc_id, tuple(x.ids)) for x in out)
    assert max(ids.values()) == 1
    assert Counter(x.doc_id for x in out) == {i: 2 if i == 2 else 3 for i, _ in rows}  # only one word of the third can be cut in two ways
    one = ls.segmentation_digests(docs(rows).repartition(3), k=3).collect()
    two = ls.segmentation_digests(docs(rows).coalesce(1), k=3).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and all(x.decodes for x in one)


def test_segmentations_odd(docs):
    rows = odd_cases(docs, ls.segmentation_digests)
    assert all(x.decodes for x in rows)
    assert {x.doc_id for x in rows} == {i for i, _ in ODD}
    assert [x.n_pieces for x in rows if x.doc_id in (1, 2, 7)] == [0, 0, 0]


# ---- personal data --------------------------------------------------------------------------------------------------

RULES = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain(text):
    out = []
    for k, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and tagger.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_as_regular_expressions():
    r = random.Random(4)
    bits = ["a@b.c", "x.y@z-z.co.uk", "@", "@@", "a@b", "a@b.", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++49 30 1234567", " ", "-", ".", "7", "aé", "\n", "+", "%", "_"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_tagger_on_held_out_texts():
    model, texts = tagger.trained(), tagger.sentences(800, 99)
    found = pii.tagged_spans([t for t, _ in texts], model)
    want = [{(a, k, b) for a, b, k in s} for _, s in texts]
    hit = sum(len(set(f) & w) for f, w in zip(found, want, strict=True))
    assert hit >= 0.92 * sum(map(len, found)) and hit >= 0.92 * sum(map(len, want))


def test_tagger_gradient():
    m = tagger.Tagger(1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    texts = tagger.sentences(4, 5)
    x, y = np.full((40, 4), 4, np.int64), np.full((40, 4), -1, np.int64)
    for j, (t, s) in enumerate(texts):
        n = min(40, len(t))
        x[:n, j], y[:n, j] = tagger.classes(t)[:n], tagger.gold(len(t), s)[:n]
    _, grads = m.gradients(x, y)
    for k in m.w:
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        old, sides = m.w[k][at], []
        for e in (1e-3, -1e-3):
            m.w[k][at] = old + e
            sides.append(m.gradients(x, y)[0])
        m.w[k][at] = old
        assert math.isclose((sides[0] - sides[1]) / 2e-3, grads[k][at], rel_tol=0.02)


def test_crf_against_all_paths():
    """The best tags and the likelihood, against every sequence of tags of short texts."""
    r = np.random.default_rng(3)
    m = tagger.Tagger(2)
    m.w["t"] = r.normal(0, 1.5, m.w["t"].shape).astype(np.float32)
    m.w["b"] = r.normal(0, 1.5, m.w["b"].shape).astype(np.float32)
    for n in (1, 2, 4):
        x = r.integers(0, tagger.CLASSES, (n, 5))
        e, _ = m.emissions(x)
        paths = np.array(list(itertools.product(range(tagger.TAGS), repeat=n)))
        y = r.integers(0, tagger.TAGS, (n, 5))
        lost = []
        best = m.decode(x)
        for j in range(5):
            score = lambda p, j=j: sum(e[i, j, p[:, i]] for i in range(n)) + sum(m.w["t"][p[:, i - 1], p[:, i]] for i in range(1, n))
            every = score(paths)
            assert paths[every.argmax()].tolist() == best[:, j].tolist()
            lost.append(np.logaddexp.reduce(every.astype(float)) - score(y[:, j][None])[0])
        assert math.isclose(m.gradients(x, y)[0], np.mean(lost), rel_tol=1e-4)


def test_windows_left_out_hold_nothing():
    """Windows with neither a digit nor an at sign that no span reaches change nothing: all windows give the same accepted spans."""
    model, r = tagger.trained(), random.Random(21)
    texts = []
    for k in range(40):
        parts = [t for t, _ in tagger.sentences(6, 500 + k)] + [" ".join("plain" + "e" * r.randrange(9) for _ in range(r.randrange(200))) for _ in range(4)]
        r.shuffle(parts)
        texts.append(" ".join(parts))
    some = pii.all_spans(texts, model)
    every = []
    for t in texts:
        which = list(range((len(t) - 1) // pii.STRIDE + 1))
        tags = model.decode(np.ascontiguousarray(pii.windows(t, which).T).astype(np.int64)).T[:, pii.MARGIN : pii.MARGIN + pii.STRIDE]
        spans = [(*pii._trim(t, a, b), k) for a, k, b in pii._spans_of(np.concatenate(tags)[: len(t)], 0)]
        base = pii.base_spans(t)
        every.append(sorted(base + [(a, k, b) for a, b, k in spans if a < b and not any(p < b and a < q for p, _, q in base) and pii._accept(k, t[a:b])]))
    assert [s for _, s in some] == every


def test_spellings_that_the_patterns_miss():
    """What the tagger is there for: addresses, numbers and cards written as no pattern has them, in sentences it wasn't trained on."""
    r = random.Random(31)
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(3, 9)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + d(14)
        body += next(c for c in "0123456789" if tagger.luhn(body + c))
        return ".".join(body[i : i + 4] for i in range(0, 16, 4))

    make = {0: lambda: f"{name()}.{name()} @ {name()}.com", 1: lambda: "[.]".join(str(r.randrange(256)) for _ in range(4)), 2: card, 3: lambda: f"({d(3)}) {d(3)}-{d(4)}"}
    start = ("Please write to ", "Reach me at ", "The old entry was ", "see also: ", "Contact = ", "Meine Nummer ist ", "from ")
    end = (" before noon.", ", thanks", " or come by", "\nBest regards", " (office)", "; then wait")
    texts, want, clean = [], [], []
    for _ in range(400):
        kind = r.randrange(4)
        a, piece, b = r.choice(start) + name() + " ", make[kind](), r.choice(end)
        texts.append(a + piece + b)
        want.append((len(a), kind, len(a) + len(piece)))
        clean.append(r.choice(start) + r.choice((f"the year {r.randrange(1900, 2030)}", f"room {d(3)}", f"{d(2)},{d(3)} items", f"v{d(1)}.{d(2)}", f"@{name()}", f"{d(1)}.{d(1)} %", name())) + r.choice(end))
    model = tagger.trained()
    assert sum(bool(pii.base_spans(t)) for t in texts) < 0.1 * len(texts)
    found = [s for _, s in pii.all_spans(texts, model)]
    recall = sum(w in f for w, f in zip(want, found, strict=True)) / len(texts)
    precision = sum(w in f for w, f in zip(want, found, strict=True)) / max(1, sum(map(len, found)))
    wrong = sum(bool(s) for _, s in pii.all_spans(clean, model)) / len(clean)
    print(f"recall {recall:.3f}, precision {precision:.3f}, clean texts with a span {wrong:.3f}")
    assert recall >= 0.8 and precision >= 0.8 and wrong <= 0.05


def test_windows_are_joined():
    """A span far longer than a window's middle, and texts decoded together or alone."""
    model = tagger.trained()
    texts = ["Write to " + "long.name." * 9 + "x7@mail.example.com today. " + "plain words " * 30 + "+1 555 123 4567", "call (555) 123-4567 now", ""]
    assert pii.tagged_spans(texts, model) == [pii.tagged_spans([t], model)[0] for t in texts]
    base, spans = pii.all_spans(texts, model)[0]
    assert set(base) <= set(spans) and len(base) == 2
    assert pii.redacted(texts[0], base).startswith("Write to [EMAIL] today.")


def test_long_addresses_at_all_places():
    """Addresses that the patterns miss are decoded whole wherever the windows cut them."""
    model = tagger.trained()
    name, host = "alexandrina_montgomeryson", "post.example.org"
    texts = ["plain words " * 20 + "x" * k + " " + f"{name} @ {host}" + " plain words" * 20 for k in range(140)]
    for text, (base, spans) in zip(texts, pii.all_spans(texts, model), strict=True):
        assert base == [] and spans == [(text.index(name), 0, text.index(host) + len(host))]


def test_windows_that_a_span_reaches():
    """A tagger that takes all but white space for one span."""

    class All:
        def decode(self, x):
            return np.where(x == 4, 0, 2).astype(np.int8)

    text = "a " + "x" * 900 + "7" + "x" * 900 + " b"
    assert (2, 0, len(text) - 2) in pii.tagged_spans([text], All())[0]


def test_personal_data(docs):
    text = "é mail bob.9@mail.example.com or 10.0.0.1"
    got = pii.personal_data(docs([(1, text)])).first()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 0, 0)
    want = f"email:{text.index('bob')}:{text.index(' or')},ip:{text.index('10.')}:{len(text)}"
    assert got.spans == want and got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    rows = odd_cases(docs, pii.personal_data, len(ODD))
    assert all(x.spans == "" for x in rows)
    kept = {x.doc_id: x.text for x in pii.redact(docs(ODD)).collect()}
    assert kept[1] is None and kept[2] == "" and kept[5] == "x" * 200_000


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def test_fingerprints(docs):
    r = random.Random(5)
    rows = [(i * 3, " ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(0, 120)))) for i in range(60)] + [(1, None), (2, "")]
    got = {x.doc_id: x for x in sh.op10(docs(rows).repartition(5)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        j, after = order[(k + 1) % len(order)]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        likeness = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        assert got[i].near_edited == likeness(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == likeness(got[i].fingerprint, got[j].fingerprint)
    assert got[1].fingerprint == got[2].fingerprint
    assert np.mean([x.near_edited for x in got.values() if x.n_chars > 100]) > 0.6


@pytest.mark.parametrize("case", ["many", "hot", "null", "uneven"])
def test_ranges_of_all_kinds(docs, monkeypatch, case):
    """More ranges than cuts, an id and null ids that many rows have, ids far apart: each row's successor is the next in order."""
    monkeypatch.setattr(sh, "ROWS_PER_RANGE", 6)
    monkeypatch.setattr(sh, "MOST_CUTS", 5 if case in ("many", "uneven") else 4096)
    r = random.Random(11)
    ids = {"many": list(range(150)), "hot": [r.choice((7, 7, *range(20))) for _ in range(150)], "null": [r.choice((None, r.randrange(400))) for _ in range(150)], "uneven": [i**4 - 50 for i in range(150)]}[case]
    rows = [(i, f"t{k} " + "a b c d e f " * (k % 5)) for k, i in enumerate(ids)]
    frame = docs(rows)
    ties = {x.text: x.h for x in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, ties[x[1]]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    got = [(str(x.doc_id), x.n_chars, x.edited_sha256) for x in sh.fingerprints(frame.repartition(4)).collect()]
    assert sorted(got) == sorted(want)


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        sh.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprint_votes(spark):
    """Against the votes counted one by one."""
    texts = ["a b c a b c d", "one", "", "The THE the the", "x " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {x.k: (x.lo, x.hi) for x in sh.fingerprint(df, "text", ["k"]).collect()}
    rows = []
    for k, t in enumerate(texts):
        w = re.split(r"[\x20\x09-\x0D]+", t.lower())
        w = w[:-1] if len(w) > 1 and w[-1] == "" and False else w
        rows += [(k, *(w[i : i + 3] + [None, None])[:3]) for i in range(len(w))]
    hashes = spark.createDataFrame(rows, "k int, a string, b string, c string").select("k", F.xxhash64("a", "b", "c").alias("lo"), F.xxhash64("c", F.lit(1), "b", "a").alias("hi")).collect()
    for k in got:
        for side in (0, 1):
            own = [(h.lo, h.hi)[side] & (2**64 - 1) for h in hashes if h.k == k]
            want = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in own) > len(own))
            assert got[k][side] & (2**64 - 1) == want


def test_block_tables_find_all(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(60)]
    prints = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randrange(0, 6))) for b in base]
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(p & (2**64 - 1)), signed(p >> 64)) for p in prints] + [(None, None)], "lo long, hi long")
    got = {(x.lo, x.hi, x.lo2, x.hi2): x.apart for x in sh.near_fingerprints(df, df, 3).collect()}
    want = {(signed(p & (2**64 - 1)), signed(p >> 64), signed(q & (2**64 - 1)), signed(q >> 64)): bin(p ^ q).count("1") for p in prints for q in prints if bin(p ^ q).count("1") <= 3}
    assert got == want


def test_near_copies_are_found(docs):
    """Texts with some words replaced, against brute force over the fingerprints; ids of copies come back, equal ones too."""
    r = random.Random(8)
    rows = []
    for k in range(12):
        base = [f"w{r.randrange(900)}" for _ in range(200)]
        rows.append((100 * k, " ".join(base)))
        rows.append((100 * k + 1, " ".join(base)))
        for j in range(2, 5):
            copy = list(base)
            copy[r.randrange(len(copy))] = f"e{j}"
            rows.append((100 * k + j, " ".join(copy)))
    got = {x.doc_id: x for x in sh.op10(docs(rows)).collect()}
    prints = {i: int(x.fingerprint, 16) for i, x in got.items()}
    for i, x in got.items():
        near = [j for j in sorted(prints) if (prints[i] ^ prints[j]).bit_count() <= sh.RADIUS]
        assert x.near_prints == (len({prints[j] for j in near}) if i % 100 == 0 else None)
        assert x.near_ids == ([j for j in near if j != i] if i % 100 == 0 else None)
    assert all(set(range(i + 1, i + 5)) <= set(got[i].near_ids) for i in range(0, 1200, 100))


def test_every_radius_is_exact(spark):
    r = random.Random(10)
    base = [r.getrandbits(128) for _ in range(20)]
    prints = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randrange(0, 30))) for b in base for _ in range(10)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(p & (2**64 - 1)), signed(p >> 64)) for p in prints], "lo long, hi long")
    for radius in (0, 4, 17, 23):
        got = [(x.lo, x.hi, x.lo2, x.hi2, x.apart) for x in sh.near_fingerprints(df.limit(20), df, radius).collect()]
        want = {(signed(p & (2**64 - 1)), signed(p >> 64), signed(q & (2**64 - 1)), signed(q >> 64), (p ^ q).bit_count()) for p in base for q in prints if (p ^ q).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_fingerprints_odd(docs):
    rows = odd_cases(docs, sh.op10, len(ODD))
    assert len({x.fingerprint for x in rows if x.doc_id in (1, 2, 7)}) == 1
    single = sh.op10(docs([(5, "only one row here")])).first()
    assert single.near_next == 1.0 and single.n_chars == 17
