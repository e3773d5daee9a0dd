"""A character tagger in numpy: bidirectional LSTM, emissions, and a CRF over BIO tags; trained here from labelled spans."""

from __future__ import annotations

import functools
import random
import string

import numpy as np

#: Kinds of spans; a tag is 0 (outside), 1 + 2 * kind (first character) or 2 + 2 * kind (inside).
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 16
#: Labelled sentences that the model is fitted to, and how often.
SENTENCES, STEPS, BATCH = 6000, 260, 96

_SIGNS = " \n.-@+()_%/:,;=\"'#[]{}<>&*!?$|~^\\`\t"
OTHER, LOWER, UPPER, DIGIT = 0, 1, 2, 3
CLASSES = 4 + len(_SIGNS) + 1
_TABLE = np.full(129, CLASSES - 1, np.uint8)  # the last: letters and signs beyond ASCII
_TABLE[:128] = OTHER
for _c in string.ascii_lowercase:
    _TABLE[ord(_c)] = LOWER
for _c in string.ascii_uppercase:
    _TABLE[ord(_c)] = UPPER
for _c in string.digits:
    _TABLE[ord(_c)] = DIGIT
for _i, _c in enumerate(_SIGNS):
    _TABLE[ord(_c)] = 4 + _i


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


# ---- labelled spans -------------------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    w = "".join(r.choice(string.ascii_lowercase if r.random() < 0.9 else "éèüñáöß") for _ in range(r.randint(1, 11)))
    return w.capitalize() if r.random() < 0.12 else w.upper() if r.random() < 0.05 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the check that card numbers pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _card(r: random.Random) -> str:
    n = r.choice((15, 16, 16, 16, 19))
    body = r.choice("3456") + _digits(r, n - 2)
    body += next(c for c in string.digits if luhn(body + c))
    sep = r.choice(("", "", " ", "-", "."))
    return sep.join(body[i : i + 4] for i in range(0, n, 4))


def _email(r: random.Random) -> str:
    name = r.choice((".", "_", "", "-")).join(_word(r).lower().encode("ascii", "ignore").decode() or "x" for _ in range(r.randint(1, 2)))
    if r.random() < 0.5:
        name += r.choice((".", "", "_")) + _digits(r, r.randint(1, 3))
    host = [r.choice(("mail", "post", "example", "host", "corp", "inbox")) + (_digits(r, 1) if r.random() < 0.4 else "") for _ in range(r.randint(1, 2))] + [r.choice(("com", "net", "org", "de", "fr", "es", "io"))]
    at, dot = r.choice((("@", "."),) * 5 + ((" @ ", "."), ("@", " . ")))
    return name + at + dot.join(host)


def _phone(r: random.Random) -> str:
    forms = ("+{2} {3} {3} {4}", "+{1}-{3}-{3}-{4}", "+{2}{10}", "+{2} ({2}) {4}-{4}", "({3}) {3}-{4}", "({3}) {4} {4}", "+{1} ({3}) {3}.{4}", "00{2} {3} {7}")
    return "".join(_digits(r, int(p)) if i % 2 else p for i, p in enumerate(r.choice(forms).replace("{", "\0").replace("}", "\0").split("\0")))


def _ip(r: random.Random) -> str:
    dot = r.choice((".",) * 8 + (" . ", "[.]"))
    return dot.join(str(r.randint(0, 255)) for _ in range(4))


def _nothing(r: random.Random) -> str:
    """Digits and signs that are no personal data."""
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    return r.choice((
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: f"${r.randint(1, 9999)}.{r.randint(0, 99):02}", lambda: _digits(r, r.randint(1, 7)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: "password=" + hexa(18), lambda: f'token = "{hexa(40)}"',
        lambda: "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16)), lambda: hexa(32), lambda: "@" + _word(r).lower(), lambda: f"({r.randint(1, 99)})", lambda: f"{r.randint(1, 99)}%", lambda: f"CC BY {r.randint(1, 4)}.0",
        lambda: f"{_word(r)}{r.randint(0, 99)}", lambda: f"https://www.{_word(r).lower()}.com/{r.randint(1, 999)}?id={_digits(r, 4)}", lambda: "#" + _digits(r, r.randint(1, 9)), lambda: " + ".join(_digits(r, 2) for _ in range(3)), lambda: f"Version {r.randint(1, 4)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(0, 9)},{_digits(r, 3)},{_digits(r, 3)}", lambda: f"{_digits(r, 4)}-{_digits(r, 4)}", lambda: f"§ {r.randint(1, 300)} ({r.randint(1, 9)})",
    ))()


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their spans (start, end, kind)."""
    r = random.Random(seed)
    make = (_email, _ip, _card, _phone)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 14)):
            x = r.random()
            if x < 0.16:
                kind = r.randrange(len(KINDS))
                piece = make[kind](r)
                spans.append((len(text), len(text) + len(piece), kind))
            else:
                piece = _nothing(r) if x < 0.36 else _word(r)
            text += piece + r.choice((" ", " ", " ", " ", ", ", ". ", ".\n", "\n", "; ", ": "))
        out.append((text, spans))
    return out


def gold(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


# ---- the model ------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states (T, B, H) of class ids (T, B), and what the backward pass needs."""
    t, b = x.shape
    h = u.shape[0]
    states, cells, gates = (np.zeros((t + 1, b, n), np.float32) for n in (h, h, 4 * h))
    for i in range(t):
        g = table[x[i]] + states[i] @ u
        g[:, : 3 * h] = _sigmoid(g[:, : 3 * h])
        g[:, 3 * h :] = np.tanh(g[:, 3 * h :])
        cells[i + 1] = g[:, h : 2 * h] * cells[i] + g[:, :h] * g[:, 3 * h :]
        states[i + 1] = g[:, 2 * h : 3 * h] * np.tanh(cells[i + 1])
        gates[i] = g
    return states[1:], (x, states, cells, gates, u)


def _lstm_back(grad: np.ndarray, kept: tuple, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u."""
    x, states, cells, gates, u = kept
    t, b, h = grad.shape
    dtable, du = np.zeros((rows, 4 * h), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    for i in reversed(range(t)):
        g = gates[i]
        gi, gf, go, gg = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
        tc = np.tanh(cells[i + 1])
        dh = dh + grad[i]
        dc = dc + dh * go * (1 - tc * tc)
        dg = np.concatenate([dc * gg * gi * (1 - gi), dc * cells[i] * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - gg * gg)], axis=1)
        np.add.at(dtable, x[i], dg)
        du += states[i].T @ dg
        dh, dc = dg @ u.T, dc * gf
    return dtable, du


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Weights, emissions and decoding. x: class ids (time, batch)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.25).astype(np.float32)
        self.w = {"tf": draw(CLASSES, 4 * HIDDEN), "uf": draw(HIDDEN, 4 * HIDDEN), "tb": draw(CLASSES, 4 * HIDDEN), "ub": draw(HIDDEN, 4 * HIDDEN), "o": draw(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.w["b"][0] = 2

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = _lstm(x, self.w["tf"], self.w["uf"])
        b, kb = _lstm(x[::-1], self.w["tb"], self.w["ub"])
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.w["o"] + self.w["b"], (both, kf, kb)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The negative log-likelihood of tags y, per text, and its gradients; tag -1 is past the end and costs nothing."""
        e, (both, kf, kb) = self.emissions(x)
        t, b, _ = e.shape
        trans = self.w["t"]
        real = y >= 0
        known = np.where(real, y, 0)
        e = np.where(real[:, :, None], e, np.where(np.arange(TAGS) == 0, 0, -1e4)).astype(np.float32)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = e[i] + _logsum(alpha[i - 1][:, :, None] + trans, 1)
        for i in reversed(range(t - 1)):
            beta[i] = _logsum(trans + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        rows = np.arange(b)
        score = sum(e[i, rows, known[i]] for i in range(t)) + sum(trans[known[i - 1], known[i]] for i in range(1, t))
        marginal = np.exp(alpha + beta - z[None, :, None])
        dtrans = np.zeros_like(trans)
        for i in range(1, t):
            dtrans += np.exp(alpha[i - 1][:, :, None] + trans + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(dtrans, (known[i - 1], known[i]), -1)
        de = marginal
        np.put_along_axis(de, known[:, :, None], np.take_along_axis(de, known[:, :, None], 2) - 1, 2)
        de = (de * real[:, :, None]).astype(np.float32) / b
        flat = de.reshape(-1, TAGS)
        dboth = (flat @ self.w["o"].T).reshape(t, b, -1)
        dtf, duf = _lstm_back(np.ascontiguousarray(dboth[:, :, :HIDDEN]), kf, CLASSES)
        dtb, dub = _lstm_back(np.ascontiguousarray(dboth[::-1, :, HIDDEN:]), kb, CLASSES)
        return float((z - score).mean()), {"tf": dtf, "uf": duf, "tb": dtb, "ub": dub, "o": both.reshape(t * b, -1).T @ flat, "b": flat.sum(axis=0), "t": dtrans / b}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (time, batch)."""
        e, _ = self.emissions(x)
        t, b, _ = e.shape
        best, back = e[0], np.zeros((t, b, TAGS), np.int8)
        for i in range(1, t):
            all_ = best[:, :, None] + self.w["t"]
            back[i] = all_.argmax(axis=1)
            best = e[i] + all_.max(axis=1)
        out = np.zeros((t, b), np.int8)
        out[-1] = best.argmax(axis=1)
        rows = np.arange(b)
        for i in reversed(range(1, t)):
            out[i - 1] = back[i, rows, out[i]]
        return out


@functools.cache
def trained(seed: int = 7) -> Tagger:
    """A tagger fitted to SENTENCES labelled texts by Adam, alike on every machine for a seed; once per process."""
    model = Tagger(seed)
    data = sentences(SENTENCES, seed)
    data.sort(key=lambda d: len(d[0]))
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, STEPS + 1):
        at = int(r.integers(0, len(data) - BATCH))
        batch = [d for d in data[at : at + BATCH]]
        longest = min(160, max(len(d[0]) for d in batch))
        x, y = np.full((longest, BATCH), 4, np.int64), np.full((longest, BATCH), -1, np.int64)
        for j, (text, spans) in enumerate(batch):
            c, g = classes(text), gold(len(text), spans)
            cut = int(r.integers(0, max(1, len(c) - longest + 1)))
            n = min(longest, len(c))
            x[:n, j], y[:n, j] = c[cut : cut + n], g[cut : cut + n]
        _, grads = model.gradients(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1, step / 20) * (1 - step / (STEPS + 1)) ** 0.7
        for k, g in grads.items():
            g = g * min(1, 5 / max(norm, 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.98 * s[k] + 0.02 * g * g
            model.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)
    return model
