"""Personal data: fixed patterns, and what a character tagger (bidirectional LSTM with a CRF) finds beside them.

The tagger is trained on the driver from labelled spans and is a few kilobytes, which go to the executors with the task. A text is cut into
windows of WINDOW characters that overlap by 2 * MARGIN, which is more than the longest span that it is trained on; each is decoded by
itself, and each character takes its tag from the window in which it lies furthest from an edge, so spans that cross windows are joined
over the whole text. A span of these kinds holds a digit or an at sign: decoded are the windows that hold either, and then
those that a decoded span reaches, until no span reaches another.

A decoded span is kept where it meets no span of the patterns and passes the checks of its kind (digits, Luhn, parts).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidy
from .tagger import DIGIT, KINDS, Tagger, classes, luhn, trained

WINDOW, MARGIN = 256, 64
STRIDE = WINDOW - 2 * MARGIN
#: Windows decoded at once.
AT_ONCE = 768

_AT_CLASS = int(classes("@")[0])
_SPACE_CLASS = int(classes(" ")[0])
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails once fails from each later digit of it too, so a match is tried at its start only
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HINT = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, kind, end: sorts as the results are listed


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a regular expression finds them, but from each at sign outward, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _passes(kind: int, found: str) -> bool:
    """The check that a match of a kind must pass."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15 if kind == 3 else True


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, in order."""
    if not _HINT.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if kind != 3 or "+" in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _passes(kind, m[0])]
    return sorted(out)


def _accept(kind: int, found: str) -> bool:
    """Whether a decoded span is taken: the checks of the pattern, on what is left of another spelling."""
    if kind == 0:
        return "@" in found and "." in found.rpartition("@")[2] and found.rpartition("@")[0].strip() != ""
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return _passes(kind, found)


def marked(text: str) -> list[int]:
    """The numbers of the windows that hold a digit or an at sign."""
    c = classes(text)
    marks = np.flatnonzero((c == DIGIT) | (c == _AT_CLASS))
    near = np.concatenate([(marks + d) // STRIDE for d in (-MARGIN, 0, MARGIN)])
    return np.unique(near[(near >= 0) & (near * STRIDE < len(c))]).tolist()


def windows(text: str, which: list[int]) -> np.ndarray:
    """Class ids (count, WINDOW) of the windows of these numbers."""
    c = classes(text)
    padded = np.full(len(c) + 2 * WINDOW, _SPACE_CLASS, np.uint8)
    padded[MARGIN : MARGIN + len(c)] = c
    return padded[(np.array(which) * STRIDE)[:, None] + np.arange(WINDOW)]


def _spans_of(tags: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs in one stretch of tags."""
    out: list[list[int]] = []
    for i in np.flatnonzero(tags):
        kind, first = (int(tags[i]) - 1) // 2, int(tags[i]) % 2 == 1
        if out and out[-1][2] == i + offset and out[-1][1] == kind and not first:
            out[-1][2] += 1
        else:
            out.append([int(i) + offset, kind, int(i) + offset + 1])
    return [tuple(s) for s in out]


def tagged_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """The spans that the model decodes in each text: windows of all texts are decoded together, each text is joined globally."""
    found: list[dict[int, np.ndarray]] = [{} for _ in texts]
    todo = {i: marked(t) for i, t in enumerate(texts) if _HINT.search(t)}
    while todo:
        x = np.concatenate([windows(texts[i], which) for i, which in todo.items()])
        tags = np.concatenate([model.decode(np.ascontiguousarray(x[i : i + AT_ONCE].T).astype(np.int64)).T for i in range(0, len(x), AT_ONCE)])
        middle = iter(tags[:, MARGIN : MARGIN + STRIDE])
        reached = {}
        for i, which in todo.items():
            own, last = found[i], (len(texts[i]) - 1) // STRIDE
            own.update((k, next(middle)) for k in which)
            near = {k + 1 for k in which if k < last and own[k][-1]} | {k - 1 for k in which if k > 0 and own[k][0]}
            if more := sorted(near - own.keys()):
                reached[i] = more
        todo = reached
    out: list[list[Span]] = []
    for text, own in zip(texts, found, strict=True):
        spans: list[Span] = []
        which = np.array(sorted(own), np.int64)
        for run in np.split(which, np.flatnonzero(np.diff(which) > 1) + 1):
            if len(run):
                offset = int(run[0]) * STRIDE
                spans += _spans_of(np.concatenate([own[k] for k in run.tolist()])[: len(text) - offset], offset)
        out.append(spans)
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in " \n\t.,;:":
        b -= 1
    while a < b and text[a] in " \n\t.,;:":
        a += 1
    return a, b


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and all of them with the model's."""
    out = []
    for text, found in zip(texts, tagged_spans(texts, model), strict=True):
        base = base_spans(text)
        more = []
        for a, kind, b in found:
            a, b = _trim(text, a, b)
            if a < b and not any(p < b and a < q for p, _, q in base) and _accept(kind, text[a:b]):
                more.append((a, kind, b))
        out.append((base, sorted(base + more)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _find(model: Tagger, full: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = all_spans(texts, model)
                if full:
                    clean = [None if raw is None else redacted(t, s) if s else t for raw, t, (_, s) in zip(part.column("text").to_pylist(), texts, found, strict=True)]
                    yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))
                    continue
                base = [listed(b) for b, _ in found]
                numbers = [pa.array([sum(k == kind for _, k, _ in b) for b, _ in found], pa.int64()) for kind in range(len(KINDS))]
                yield pa.record_batch([part.column("id"), *numbers, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([listed(s) for _, s in found], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return find


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans.

    Spans are written kind:start:end in code points, end exclusive, by start and then kind; base_sha256 is of those of the
    patterns, `spans` also has the tagger's. Null text counts as empty and has none. Repeated rows and null ids are kept; other
    columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("id", source.schema["id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return source.mapInArrow(tidy(_find(trained(), False)), T.StructType(fields)).withColumnRenamed("id", id_col)


def redact(docs: DataFrame) -> DataFrame:
    """`docs`, all its columns, with personal data in `text` replaced by its kind, as [EMAIL]; a null text stays null."""
    return docs.mapInArrow(tidy(_find(trained(), True)), docs.schema)
