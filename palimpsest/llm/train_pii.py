"""Train the tagger of personal data and write its weights: python -m palimpsest.llm.train_pii NOTES.parquet OUT.npz [STEPS [WORKERS [START.npz]]].

NOTES.parquet gives ordinary sentences only; all labelled spans are invented. Each step sums the
gradients of a batch per worker process.
"""

from __future__ import annotations

import multiprocessing
import re
import sys
import time
from pathlib import Path

from palimpsest.llm.pii_examples import Maker, ordinary
from palimpsest.llm.pii_tagger import LABELS, TYPES, Tagger, batch_of, train

#: States a direction.
HIDDEN = 20


def notes(path: str, most: int = 12000) -> list[str]:
    """Sentences of notes that can hold no personal data."""
    import pyarrow.parquet as pq

    found: set[str] = set()
    for text in pq.read_table(path, columns=["text"])["text"].to_pylist():
        for s in re.split(r"(?<=[.!?])\s+|[\r\n]+", text or ""):
            if 20 < len(s) < 140:
                found.add(s)
    good = ordinary(sorted(found))
    return good[:: max(1, len(good) // most)]


def passages(parts: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """First, after last and type of the labelled parts."""
    out, at = [], 0
    for text, kind in parts:
        if kind:
            out.append((at, at + len(text), kind))
        at += len(text)
    return out


def quality(tagger: Tagger, maker: Maker, n: int = 3000) -> dict[str, tuple[float, float]]:
    """Precision and recall of whole passages by type, on ``n`` examples, with the checks that follow the tagger."""
    from palimpsest.llm import pii

    examples = [maker.example() for _ in range(n)]
    texts = ["".join(t for t, _ in parts) for parts in examples]
    right, found, true = ({k: 0 for k in TYPES} for _ in range(3))
    same = lambda text, a, b, k: ("".join(c for c in text[a:b].lower() if c.isalnum()), k)
    for text, parts, labels in zip(texts, examples, pii.label(texts, tagger), strict=True):
        got, want = ([same(text, *p) for p in x] for x in (pii.spans(text, labels), passages(parts)))
        for k in TYPES:
            g, w = [x for x in got if x[1] == k], [x for x in want if x[1] == k]
            found[k] += len(g)
            true[k] += len(w)
            right[k] += len(set(g) & set(w))
    return {k: (round(right[k] / max(1, found[k]), 4), round(right[k] / max(1, true[k]), 4)) for k in TYPES}


_maker: Maker | None = None


def _start(source: list[str]) -> None:
    global _maker
    _maker = Maker(multiprocessing.current_process().pid, source)


def _gradient(task):
    weights, batch, seed = task
    tagger = Tagger.__new__(Tagger)
    tagger.w = weights
    _maker.r.seed(seed)
    return tagger.gradient(*batch_of([_maker.example() for _ in range(batch)]))


def main(source: str, out: str, steps: int, workers: int, start: str | None = None) -> None:
    sentences = notes(source)
    began = time.time()
    tagger = Tagger.load(start) if start else Tagger(HIDDEN)

    def report(step: int, loss: float) -> None:
        print(step, round(loss, 4), round(time.time() - began), flush=True)
        if step % 200 == 0:
            tagger.save(out)

    with multiprocessing.get_context("fork").Pool(workers, _start, (sentences,)) as pool:

        def gradients(step: int):
            return pool.map(_gradient, [(tagger.w, 45, (10**6 if start else 0) + step * 1000 + i) for i in range(workers)])

        train(tagger, gradients, steps, rate=0.005 if start else 0.012, report=report)
    tagger.save(out)
    print(len(LABELS), "labels; precision, recall of passages")
    for what, held in (("training frames", False), ("held-out frames and names", True)):
        print(what, quality(Tagger.load(out), Maker(99, sentences, held)))


if __name__ == "__main__":
    main(sys.argv[1], str(Path(sys.argv[2])), *(int(x) for x in (sys.argv[3:5] + ["2000", "8"][max(0, min(2, len(sys.argv) - 3)) :])), *sys.argv[5:6])
