"""Languages of documents and of the lines of documents that mix languages.

A linear-chain conditional random field labels every word of a line: features
are the word itself (lexicon), its affixes, its character n-grams and its
script; transitions between neighbouring words are learned with them. It is
trained by stochastic gradient steps on code-switched sequences, made of
sentences of labelled documents. Forward-backward gives each word a probability
per language; a line's language has the largest sum over its characters, and so
has the document's over its lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents per language that the model is trained on, and sentences taken from each.
TRAIN_DOCS, TRAIN_SENTENCES = 150, 30
#: Probability that a label needs to stay in the sample.
LEAST_LIKELY = 0.8
#: Hashed features.
BUCKETS = 1 << 16
#: A line's words are labelled in chains of up to this many words.
CHAIN = 64
#: Words a line needs to show a language that the document's main one is not, and its probability.
LEAST_WORDS, LEAST_SHARE = 3, 0.8
#: Share of a text's words that must be known from the labelled documents, else it has no language.
LEAST_KNOWN = 0.25
#: Share of digits and marks from which a line counts as code and shows no language.
LEAST_MARKS = 0.32
#: Usual three-letter codes of languages.
THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "rus": "ru", "jpn": "ja"}

WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
#: The same in text of ASCII alone.
PLAIN = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
LEAD = re.compile(r"^[\s>*#-]*(?:\[\d\d:\d\d\]\s*)?(?:\w+:\s)?")
MARK = re.compile(r"[\d\[\]{}<>=;|*_\"\\()@$%&+/']")
SENTENCE = regex.compile(r"(?<=[.!?。！？])\s*|[\r\n]+")


def label_code(label: Column, codes: dict[str, str]) -> Column:
    """The code that a label means: code, region variant, three-letter code or English name in any case; null if none."""
    plain = F.lower(F.trim(label))
    names = codes | THREE
    pairs = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(pairs[plain], pairs[F.split(plain, "[-_]")[0]])


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets(dict):
    """Buckets of the parts of words of one kind, hashed once: affixes and n-grams of few letters recur in most words."""

    def __init__(self, kind: str):
        self.kind = kind

    def __missing__(self, part: str) -> int:
        found = self[part] = bucket(self.kind + part)
        return found


HEAD, TAIL, GRAM, SCRIPT = (Buckets(kind) for kind in "pens")


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    w = f"^{word.lower()}$"
    grams = [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    out = [bucket("w" + w), SCRIPT[script(word)]]
    out += [HEAD[x] for x in dict.fromkeys((w[:2], w[:3], w[:4]))]
    out += [TAIL[x] for x in dict.fromkeys((w[-2:], w[-3:], w[-4:]))]
    out += [GRAM[x] for x in dict.fromkeys(grams)]
    return out


def script(word: str) -> str:
    c = ord(word[0])
    return "j" if c >= 0x2E80 else "c" if 0x400 <= c < 0x530 else "l" if c < 0x250 else "o"


def is_code(line: str) -> bool:
    """A line of code, JSON or a dump: digits and code's marks make up much of it."""
    body = LEAD.sub("", line)
    size = len(body) - body.count(" ")
    return size > 0 and len(MARK.findall(body)) >= LEAST_MARKS * size


class Words:
    """Distinct words with their feature lists; grows as texts are read."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.lists: list[list[int]] = []

    def ids(self, text: str) -> list[int]:
        number = self.number
        words = (PLAIN if text.isascii() else WORD).findall(text)
        out = list(map(number.get, words))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            w = words[at]
            if w not in number:
                number[w] = len(self.lists)
                self.lists.append(features(w))
            out[at] = number[w]
        return out

    def scores(self, weight: np.ndarray, start: int = 0) -> np.ndarray:
        """Emission scores of the words from number ``start`` on."""
        lists = self.lists[start:]
        if not lists:
            return np.zeros((0, weight.shape[1]), np.float32)
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum())
        return np.add.reduceat(weight[flat], np.cumsum(sizes) - sizes)


def posteriors(score: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded chains: state probabilities (B, T, K) and expected moves (K, K)."""
    count, steps, states = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True))
    m = np.exp(move - move.max())
    ahead = np.empty_like(e)
    ahead[:, 0] = e[:, 0] * np.exp(start - start.max())
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    scale = np.ones((count, steps), score.dtype)
    for t in range(1, steps):
        a = (ahead[:, t - 1] @ m) * e[:, t]
        scale[:, t] = a.sum(1)
        ahead[:, t] = a / scale[:, t, None]
    back = np.ones_like(e)
    moves = np.zeros((states, states))
    for t in range(steps - 2, -1, -1):
        live = (t + 1 < length)[:, None]
        b = e[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
        back[:, t] = np.where(live, b @ m.T, 1)
        moves += m * ((ahead[:, t] * live).T @ b)
    p = ahead * back
    return p / p.sum(2, keepdims=True), moves


class Model:
    """Weights of the trained chain."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        k = len(langs)
        self.weight = np.zeros((BUCKETS, k), np.float32)
        self.start, self.move = np.zeros(k, np.float32), np.zeros((k, k), np.float32)
        self.known: set[int] = set()

    def train(self, sentences: list[tuple[int, str]], steps: int = 160, batch: int = 256, seed: int = 7, often: dict[int, int] | None = None) -> None:
        """Adaptive gradient steps on chains of one to three sentences, half of them code-switched; languages are drawn alike, or as ``often`` as given."""
        rng = np.random.default_rng(seed)
        words = Words()
        rows = [(lang, ids[:CHAIN]) for lang, text in sentences if not is_code(text) and (ids := words.ids(text))]
        if not rows:
            return
        by_lang = [[ids for lang, ids in rows if lang == k] for k in range(len(self.langs))]
        there = [k for k, x in enumerate(by_lang) if x]
        drawn = np.cumsum([often.get(k, 1) if often else 1 for k in there])
        seen = np.bincount([i for _, ids in rows for i in set(ids)], minlength=len(words.lists))
        self.known = {zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w, i in words.number.items() if seen[i] >= 3}
        sizes = np.array([len(x) for x in words.lists])
        flat = np.fromiter((f for x in words.lists for f in x), np.int64, sizes.sum())
        head, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        by_feature = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[by_feature], return_index=True)
        by_feature = owner[by_feature]
        square_w, square_m, square_s = np.full_like(self.weight, 1e-3), np.full_like(self.move, 1e-3), np.full_like(self.start, 1e-3)
        for _ in range(steps):
            chains = []
            for _ in range(batch):
                ids, gold = [], []
                for _ in range(rng.choice([1, 1, 2, 3])):
                    k = there[np.searchsorted(drawn, rng.integers(drawn[-1]), side="right")]
                    part = by_lang[k][rng.integers(len(by_lang[k]))]
                    ids += part
                    gold += [k] * len(part)
                chains.append((ids[:CHAIN], gold[:CHAIN]))
            length = np.array([len(c[0]) for c in chains])
            index, gold = np.zeros((batch, length.max()), np.int64), np.zeros((batch, length.max()), np.int64)
            for i, (ids, g) in enumerate(chains):
                index[i, : len(ids)], gold[i, : len(ids)] = ids, g
            mask = np.arange(length.max())[None, :] < length[:, None]
            emission = np.add.reduceat(self.weight[flat], head)
            p, moves = posteriors(emission[index], length, self.start, self.move)
            grad = -p.astype(np.float32)
            np.put_along_axis(grad, gold[..., None], np.take_along_axis(grad, gold[..., None], 2) + 1, 2)
            of_word = np.zeros_like(emission)
            word, slope = index[mask], grad[mask]
            order = np.argsort(word, kind="stable")
            there_words, at = np.unique(word[order], return_index=True)
            of_word[there_words] = np.add.reduceat(slope[order], at)
            of_weight = np.add.reduceat(of_word[by_feature], first)
            real = np.zeros_like(self.move)
            np.add.at(real, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            step = of_weight / batch - 1e-5 * self.weight[used]
            square_w[used] += step * step
            self.weight[used] += 0.3 * step / np.sqrt(square_w[used])
            for value, square, step in (
                (self.move, square_m, ((real - moves) / batch).astype(np.float32)),
                (self.start, square_s, grad[:, 0].mean(0)),
            ):
                square += step * step
                value += 0.3 * step / np.sqrt(square)

    def classify(self, texts: list[str], memo: dict) -> list[tuple[list[int], np.ndarray, np.ndarray, float]]:
        """Per text: numbers of characters of its non-blank lines, their language probabilities, words per line, share of known words."""
        if "words" not in memo or len(memo["words"].lists) > 400_000:
            memo["words"], memo["score"], memo["is"] = Words(), np.zeros((0, len(self.langs)), np.float32), np.zeros(0, bool)
        words = memo["words"]
        before = len(words.lists)
        chars, owner, chains, lines = [], [], [], []  # of all lines; chains belong to lines
        for text in texts:
            first = len(chars)
            for line in LINE.split(text):
                if line.strip():
                    ids = [] if is_code(line) else words.ids(line)
                    for i in range(0, len(ids), CHAIN):
                        chains.append(ids[i : i + CHAIN])
                        owner.append(len(chars))
                    chars.append(len(line))
            lines.append((first, len(chars)))
        if len(words.lists) > before:
            memo["score"] = np.concatenate([memo["score"], words.scores(self.weight, before)])
            fresh = list(words.number)[before:]
            memo["is"] = np.concatenate([memo["is"], [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) in self.known for w in fresh]])
        score, total = memo["score"], np.zeros((len(chars), len(self.langs)))
        n_words, n_known = np.zeros(len(chars)), np.zeros(len(chars))
        length = np.array([len(c) for c in chains], np.int64)
        line_of = np.array(owner, np.int64)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            n = length[part]
            index = np.zeros((len(part), n.max()), np.int64)
            mask = np.arange(n.max())[None, :] < n[:, None]
            index[mask] = np.fromiter(chain.from_iterable(chains[i] for i in part), np.int64, n.sum())
            p, _ = posteriors(score[index], n, self.start, self.move)
            np.add.at(total, line_of[part], (p * mask[..., None]).sum(1))
            np.add.at(n_words, line_of[part], n)
            np.add.at(n_known, line_of[part], (memo["is"][index] & mask).sum(1))
        out = []
        for first, last in lines:
            share = total[first:last] / np.maximum(n_words[first:last, None], 1)
            every = n_words[first:last].sum()
            out.append((chars[first:last], share, n_words[first:last], n_known[first:last].sum() / every if every else 0.0))
        return out


def trained(documents: DataFrame, codes: dict[str, str], text: str = "text", lang: str = "lang") -> Model:
    """A model trained on a bounded sample of labelled documents.

    Per language up to TRAIN_DOCS documents (smallest hash of the text) with up
    to TRAIN_SENTENCES sentences each reach the driver. Labels may be wrong, and
    a long document brings many sentences with its wrong label, so no document
    vouches for itself: the sample is cut into two halves by document, a model
    of each half judges the sentences of the other, once more after what was
    found unlikely has left the halves, and the final model learns from the
    sentences whose label has a probability of LEAST_LIKELY or more. These
    models see languages as often as all documents are labelled with them, so a
    rare label that often hides a frequent language is found unlikely. A
    language of which nothing would be left keeps all its sentences.
    """
    langs = sorted(set(codes.values()))
    labelled = documents.select(label_code(F.col(lang), codes).alias("code"), F.col(text).alias("body")).filter("code IS NOT NULL AND length(trim(body)) > 20")
    order = Window.partitionBy("code").orderBy(F.xxhash64("body"), "body")
    some = labelled.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= TRAIN_DOCS)
    cut = F.udf(lambda body: [s for s in SENTENCE.split(body) if s and s.strip()][:TRAIN_SENTENCES], "array<string>")
    rows = some.select("code", F.pmod(F.xxhash64("body", F.lit(1)), F.lit(2)).alias("half"), cut("body").alias("parts")).collect()
    often = {langs.index(r["code"]): r["count"] for r in documents.select(label_code(F.col(lang), codes).alias("code")).groupBy("code").count().collect() if r["code"]}  # one row a language
    halves = [sorted((langs.index(r["code"]), s) for r in rows if r["half"] == h for s in r["parts"]) for h in (0, 1)]

    def likely(mine: list[tuple[int, str]], other: list[tuple[int, str]]) -> list[tuple[int, str]]:
        judge, memo, good = Model(langs), {}, []
        judge.train(mine, steps=40, often=often)
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            for (k, s), (_, share, _, _) in zip(part, judge.classify([s for _, s in part], memo), strict=True):
                if len(share) and share.mean(0)[k] >= LEAST_LIKELY:
                    good.append((k, s))
        there = {k for k, _ in good}
        return good + [x for x in other if x[0] not in there]

    one, two = halves
    first = likely(two, one), likely(one, two)
    model = Model(langs)
    model.train(sorted(likely(first[1], one) + likely(first[0], two)), steps=160)
    return model


def decide(langs: list[str], chars: list[int], share: np.ndarray, n_words: np.ndarray, known: float) -> tuple[str | None, float, list[str]]:
    """Main language, its share of the text's characters, and the language of each non-blank line.

    A line with few words or no clear language gets the main language, unless
    it clearly has one that another line of the text shows.
    """
    if not len(chars) or not n_words.any() or known < LEAST_KNOWN:
        return None, 0.0, []
    weight = np.array(chars)[:, None]
    best, top = share.argmax(1), share.max(1)
    sure = (top >= LEAST_SHARE) & (n_words >= LEAST_WORDS)
    total = (share * weight)[sure].sum(0) if sure.any() else (share * weight).sum(0)
    main = int(total.argmax())
    shown = set(best[sure].tolist()) | {main}
    line = [int(b) if s or (b in shown and t >= 0.9) else main for b, s, t in zip(best, sure, top, strict=True)]
    size = np.bincount(line, weights=np.array(chars, float), minlength=len(langs))
    main = int(size.argmax())
    at = np.array(line) == main
    return langs[main], float((share[at, main] * np.array(chars)[at]).sum() / np.array(chars)[at].sum()), [langs[k] for k in line]


def detect(documents: DataFrame, keys: list[str], model: Model, text: str = "text") -> DataFrame:
    """``keys``, ``language``, ``confidence``, ``lines`` (language and confidence of each non-blank line, in order).

    One row per row. Null and blank texts, and texts without any language
    (numbers, code, dumps), have a null language and no lines. No shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    types = dict(documents.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", language string, confidence double, lines array<struct<lang:string,confidence:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = model.classify([t or "" for t in batch.column(len(keys)).to_pylist()], memo)
                langs, sure, lines = [], [], []
                for chars, share, n_words, known in found:
                    lang, p, each = decide(model.langs, chars, share, n_words, known)
                    langs.append(lang)
                    sure.append(p)
                    lines.append([{"lang": x, "confidence": float(row[model.langs.index(x)])} for x, row in zip(each, share, strict=False)])
                arrays = [pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(lines, kind)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *arrays], [*keys, "language", "confidence", "lines"])

    return documents.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
