"""Personal information inside free text: found, and replaced by typed placeholders.

The tagger (``pii_tagger``, trained by ``train_pii``) reads a text in windows of
WINDOW characters that overlap. Each character takes its scores from the window
in which it stands farthest from an end, and one decoding over the whole text
settles the labels, so a passage across a border of windows is whole. Found
passages are then trimmed to whole words, and an exact check drops what cannot
be of its type (an e-mail address without a host, a phone number of too few
digits, and so on).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.pii_tagger import LABELS, TYPES, Tagger, numbers

#: Characters of a window, and how many two windows share.
WINDOW, OVERLAP = 640, 96
#: Windows that are read at once.
AT_ONCE = 256
#: Characters of all texts a task tags, and rows that are tagged at once.
TASK, ROWS = 1_500_000, 1024
#: Titles, pronouns and the like, as a pattern for whole columns.
TITLES_SQL = r"(?i)\b(?:mr|mrs|ms|dr|prof|herr|hr|frau|fr|mme|sr|sra|jr|phd|he|him|she|her|they|them)\b\.?"
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Titles that belong to no name.
TITLE = re.compile(r"^(?:(?:mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra)\b\.?\s+)+", re.I)
#: Words between two names.
AND = re.compile(r"\s(?:and|und|et|och)\s", re.I)
#: Small words inside names.
PARTICLES = {"de", "da", "di", "del", "van", "von", "der", "den", "la", "le", "du"}
#: Words of streets, at the end of a word or alone; an address has one.
STREET = re.compile(
    r"(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|straat|laan)\b|str\.|\b(?:street|lane|avenue|ave|road|rd|st|ln|drive|dr|court|way|boulevard|blvd|bd|terrace|place|crescent|close|hill|square|parkway|row|rue|chemin|quai|"
    r"calle|plaza|paseo|avenida|via|viale|piazza|corso|rua|largo|am|an der|auf der)\b", re.I,
)
#: Captions of identity numbers, right before a number.
CAPTION = re.compile(r"(?:\b(?:tax|TIN|SSN|NINO|NI|NIF|DNI|IBAN|passport|Reisepass|passeport|pasaporte|Steuer\w*|soc\. sec\.|security|insurance|identity|account|codice fiscale|fiscal)\b[\s\w.:-]{0,12})$", re.I)
EXTENSION = re.compile(r"[\s,;]*(?:\bext|\bextension|\bx|\bpost|\bpostes?|\bDurchwahl)\.?\s*\d*$", re.I)
#: What may follow the part of an address that was found: more labels of its host, with dots or the word dot.
HOST_END = re.compile(r"(?:[.．][a-z0-9][a-z0-9-]*[a-z0-9]|(?:\s*[(\[]dot[)\]]\s*|\s+dot\s+)(?:example|invalid|test|com|org|net)\b)+", re.I)
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
Span = tuple[int, int, str]


@functools.cache
def tagger() -> Tagger:
    return Tagger.load(str(WEIGHTS))


def label(texts: list[str], model: Tagger) -> list[np.ndarray]:
    """Label numbers of every character of every text."""
    codes = [numbers(t) for t in texts]
    windows = []  # (text, first character)
    for i, c in enumerate(codes):
        last = max(0, len(c) - WINDOW)
        starts = [*range(0, last, WINDOW - OVERLAP), last]
        windows += [(i, s) for s in starts]
    windows.sort(key=lambda w: min(WINDOW, len(codes[w[0]]) - w[1]))
    score = [np.zeros((len(c), len(LABELS)), np.float32) for c in codes]
    for at in range(0, len(windows), AT_ONCE):
        part = windows[at : at + AT_ONCE]
        ids = np.zeros((max(min(WINDOW, len(codes[i]) - s) for i, s in part), len(part)), np.int64)
        for b, (i, s) in enumerate(part):
            piece = codes[i][s : s + WINDOW]
            ids[: len(piece), b] = piece
        if not len(ids):
            continue
        got = model.emissions(ids)
        for b, (i, s) in enumerate(part):
            n = len(codes[i])
            low = s + OVERLAP // 2 if s else 0
            high = min(s + WINDOW, n)
            last = max(0, n - WINDOW)
            if s == last and s:  # the last window may overlap the one before by more
                before = [x for x in (*range(0, last, WINDOW - OVERLAP),) if x < s]
                low = (s + min(before[-1] + WINDOW, n)) // 2 if before else s
            score[i][low:high] = got[low - s : high - s, b]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(codes[i]))
    for at in range(0, len(order), AT_ONCE):
        part = [i for i in order[at : at + AT_ONCE] if len(codes[i])]
        if not part:
            continue
        longest = len(codes[part[-1]])
        if longest > 20 * WINDOW:  # very long texts one at a time
            for i in part:
                out[i] = model.decode(score[i][:, None])[:, 0]
            continue
        whole = np.zeros((longest, len(part), len(LABELS)), np.float32)
        whole[:, :, 0] = 1
        for b, i in enumerate(part):
            whole[: len(codes[i]), b] = score[i]
        got = model.decode(whole)
        for b, i in enumerate(part):
            out[i] = got[: len(codes[i]), b]
    return out


def spans(text: str, labels: np.ndarray) -> list[Span]:
    """Passages (first, after last, type) of one text: labelled runs, made whole words and checked."""
    kind = (labels + 1) // 2  # 0: none, else the type's number
    begin = labels % 2 == 1
    found: list[Span] = []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]])) | np.concatenate([begin, [False]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        what = TYPES[kind[a] - 1] if kind[a] else ""
        cuts = [x for m in AND.finditer(text, a, b) for x in m.span()] if what == "name" else []
        ends = [int(a), *cuts, int(b)]
        for first, last in zip(ends[::2], ends[1::2], strict=True) if what else ():
            span = checked(text, first, last, what)
            if span and (not found or span[0] >= found[-1][1]):
                found.append(span)
    return found


def checked(text: str, a: int, b: int, kind: str) -> Span | None:
    """A passage trimmed and extended to whole words, or None if it can't be of its type."""
    inside = str.isalnum
    while a > 0 and inside(text[a - 1]) and inside(text[a]):
        a -= 1
    while b < len(text) and inside(text[b - 1]) and inside(text[b]):
        b += 1
    if kind == "phone":
        m = EXTENSION.search(text[a:b])
        if m and m.start():
            b = a + m.start()
        if a and text[a - 1] == "+":
            a -= 1
        while a < b and not (text[a].isdigit() or text[a] in "+("):
            a += 1
        if CAPTION.search(text[max(0, a - 40) : a]):
            kind = "id_number"
    keep = {"phone": "+(", "email": "", "name": "", "address": "", "id_number": ""}[kind]
    while a < b and not (inside(text[a]) or text[a] in keep):
        a += 1
    while b > a and not inside(text[b - 1]):
        b -= 1
    body = text[a:b]
    letters, digits = sum(c.isalpha() for c in body), sum(c.isdigit() for c in body)
    if kind == "name":
        m = TITLE.match(body)
        if m:
            a += m.end()
            body = text[a:b]
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W\d_]+", body)]
        # lower-case words at the ends of a name with capitals are neighbours that the span took in, but for particles
        first, last = 0, len(words)
        small = [w.islower() and w not in PARTICLES for *_, w in words]
        if not all(w.islower() for *_, w in words):
            while last > first and small[first]:
                first += 1
            while last > first and small[last - 1]:
                last -= 1
        if last > first:
            a, b = a + words[first][0], a + words[last - 1][1]
        good = digits == 0 and last - first >= 2 and any(len(w) > 1 for *_, w in words[first:last])
    elif kind == "email":
        rest = HOST_END.match(text[b:])
        if rest:
            b += rest.end()
        b -= len(text[a:b]) - len(re.sub(r"(?i)(?:[\s(\[]+dot[)\]]?)+$", "", text[a:b]))
        body = text[a:b]
        m = re.match(r"(?i)mailto:", body)
        if m:
            a += m.end()
            body = text[a:b]
        good = bool(re.search(r"(?i)[@＠]|\(at\)|\[at\]|\bat\b", body)) and bool(re.search(r"(?i)[.．]|dot", re.split(r"(?i)[@＠]|\(at\)|\[at\]|\sat\s", body)[-1]))
    elif kind == "phone":
        good = 7 <= digits <= 15 and letters == 0
    elif kind == "id_number":
        good = 6 <= digits <= 34 and letters <= 6
    else:
        good = 1 <= digits <= 6 and letters >= 4 and bool(STREET.search(body + text[b : b + 1]))
    return (a, b, kind) if good else None


def replace(text: str, found: list[Span]) -> str:
    """The text with each passage replaced by its type's placeholder, otherwise unchanged."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def tag(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``clean`` (the text with placeholders) and ``found`` (type and passage of each item, in order).

    One row per row of ``rows``; null and blank texts hold nothing and come
    back as they are. Whole texts are read, however long. No shuffle.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", clean string, found array<struct<pii_type:string,passage:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger()
        kind = pa.list_(pa.struct([("pii_type", pa.string()), ("passage", pa.string())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
                hits = [spans(t, x) if t else [] for t, x in zip(texts, label(texts, model), strict=True)]
                clean = [replace(t, h) if h else t for t, h in zip(texts, hits, strict=True)]
                mask = batch.column(len(keys)).is_null().to_numpy(zero_copy_only=False)
                found = [[{"pii_type": k, "passage": t[a:b]} for a, b, k in h] for t, h in zip(texts, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(clean, pa.string(), mask=mask), pa.array(found, kind)], [*keys, "clean", "found"])

    return rows.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
