"""Character-level bidirectional LSTM with CRF transitions, in numpy.

A character is its folded letter or class plus marks for case, accents and words
that are known given names. Two
LSTMs read a window from both sides; their states give scores per label (B and I
of each type, and O), and learned transitions link the labels of neighbours.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from palimpsest.llm.given_names import places

TYPES = ["email", "phone", "id_number", "address", "name"]
LABELS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789 \n.,;:!?'\"()[]<>{}@/\\|+-_=*#&%$~^`"
#: Numbers of the signs, then classes of the rest; upper case letters and accented ones have numbers of their own.
UPPER, ACCENT, OTHER = len(SIGNS) + 1, len(SIGNS) + 27, len(SIGNS) + 29
VOCAB = OTHER + 8
#: Characters of known given names have numbers of their own, VOCAB higher.
MARKED = VOCAB


def number(c: str) -> int:
    """Input number of a character."""
    i = SIGNS.find(c)
    if i >= 0:
        return i + 1
    if "A" <= c <= "Z":
        return UPPER + ord(c) - 65
    base = unicodedata.normalize("NFKD", c)[0]
    if "a" <= base <= "z" or "A" <= base <= "Z":
        return ACCENT + (base < "a")
    kind = unicodedata.category(c)
    if c == "＠":
        return SIGNS.find("@") + 1
    if kind == "Nd":
        return SIGNS.find("0") + 1
    if kind[0] == "Z":
        return SIGNS.find(" ") + 1
    if kind == "Pd":
        return SIGNS.find("-") + 1
    return OTHER + {"Ll": 0, "Lu": 1, "Lo": 2, "Lm": 2, "Cc": 3, "Cf": 3}.get(kind, 4)



class _Numbers(dict):
    def __missing__(self, code: int) -> str:
        self[code] = value = chr(number(chr(code)))
        return value


_numbers = _Numbers()


def numbers(text: str, mark: bool = True) -> np.ndarray:
    """Input numbers of a text; ``mark``: those of known given names are marked."""
    out = np.frombuffer(text.translate(_numbers).encode("utf-16-le"), np.uint16).astype(np.int64)
    for a, b in places(text) if mark else ():
        out[a:b] += MARKED
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.exp(-x)
    x += 1
    return np.reciprocal(x, out=x)


class Tagger:
    """Weights: input table per direction (already projected), recurrent matrices, output and transitions."""

    def __init__(self, hidden: int = 20, seed: int = 1):
        r = np.random.default_rng(seed)
        h, k = hidden, len(LABELS)
        self.w = {f"{n}{d}": v for d in "fb" for n, v in (("x", r.normal(0, 0.25, (2 * VOCAB, 4 * h))), ("u", r.normal(0, 1 / np.sqrt(h), (h, 4 * h))))}
        self.w |= {"o": r.normal(0, 0.2, (2 * h, k)), "c": np.zeros(k), "t": np.zeros((k, k))}
        for d in "fb":
            self.w["x" + d][:, h : 2 * h] += 1  # remember at first
        self.w = {n: v.astype(np.float32) for n, v in self.w.items()}

    @property
    def hidden(self) -> int:
        return len(self.w["uf"])

    def run(self, ids: np.ndarray, side: str, keep: bool = False):
        """States of one direction over (T, B) inputs; ``keep`` also returns what backpropagation needs."""
        steps, count = ids.shape
        h, u, x = self.hidden, self.w["u" + side], self.w["x" + side]
        state, cell = np.zeros((count, h), np.float32), np.zeros((count, h), np.float32)
        out = np.empty((steps, count, h), np.float32)
        kept = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = x[ids[t]] + state @ u
            gates = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, last = cell, state
            cell = f * before + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            # padding (number 0) leaves the state at rest
            rest = ids[t] == 0
            if rest.any():
                state[rest] = 0
                cell[rest] = 0
            out[t] = state
            if keep:
                kept.append((t, i, f, o, new, before, last, squashed, rest))
        return (out, kept) if keep else out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (T, B, K) of (T, B) inputs; both directions step together."""
        steps, count = ids.shape
        h = self.hidden
        u = np.stack([self.w["uf"], self.w["ub"]])
        # the same numbers, arranged so that one exponential serves all gates: tanh(x) = 2 sigmoid(2 x) - 1
        twice = np.ones(4 * h, np.float32)
        twice[3 * h :] = 2
        u, xf, xb = u * twice, self.w["xf"] * twice, self.w["xb"] * twice
        state, cell = np.zeros((2, count, h), np.float32), np.zeros((2, count, h), np.float32)
        out = np.empty((2, steps, count, h), np.float32)
        z = np.empty((2, count, 4 * h), np.float32)
        some = (ids == 0).any(1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                back = steps - 1 - t
                np.matmul(state, u, out=z)
                z[0] += xf[ids[t]]
                z[1] += xb[ids[back]]
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                new = z[..., 3 * h :] * 2
                new -= 1
                new *= z[..., :h]
                cell *= z[..., h : 2 * h]
                cell += new
                np.tanh(cell, out=state)
                state *= z[..., 2 * h : 3 * h]
                for d, at in ((0, t), (1, back)):
                    if some[at]:  # padding leaves the state at rest
                        rest = ids[at] == 0
                        state[d, rest], cell[d, rest] = 0, 0
                out[0, t], out[1, back] = state[0], state[1]
        o = self.w["o"]
        score = out[0] @ o[:h]
        score += out[1] @ o[h:]
        score += self.w["c"]
        return score

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Best labels (T, B) of scores (T, B, K)."""
        move = self.w["t"]
        steps, count, k = score.shape
        by_label = np.ascontiguousarray(score.transpose(0, 2, 1))  # (T, K, B): the batch lies along memory
        best = np.empty_like(by_label)
        best[0] = by_label[0]
        wide = np.empty((k, k, count), np.float32)
        for t in range(1, steps):
            np.add(best[t - 1][:, None, :], move[:, :, None], out=wide)
            np.max(wide, axis=0, out=best[t])
            best[t] += by_label[t]
        out = np.empty((steps, count), np.int64)
        out[-1] = best[-1].argmax(0)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = (best[t - 1] + move[:, out[t]]).argmax(0)
        return out

    def gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood and its gradient for (T, B) inputs and labels; padding counts as O."""
        w, h, k = self.w, self.hidden, len(LABELS)
        steps, count = ids.shape
        fwd, kept_f = self.run(ids, "f", True)
        bwd, kept_b = self.run(ids, "b", True)
        both = np.concatenate([fwd, bwd], 2)
        score = both @ w["o"] + w["c"]
        e = np.exp(score - score.max(2, keepdims=True))
        m = np.exp(w["t"])
        ahead, scale = np.empty_like(e), np.empty((steps, count), np.float32)
        a = e[0]
        for t in range(steps):
            if t:
                a = (ahead[t - 1] @ m) * e[t]
            scale[t] = a.sum(1)
            ahead[t] = a / scale[t, :, None]
        back = np.ones_like(e)
        grad = {n: np.zeros_like(v) for n, v in w.items()}
        for t in range(steps - 2, -1, -1):
            b = e[t + 1] * back[t + 1] / scale[t + 1, :, None]
            back[t] = b @ m.T
            grad["t"] += m * (ahead[t].T @ b)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        loss = float(np.log(scale).sum() + score.max(2).sum() - np.take_along_axis(score, gold[..., None], 2).sum() - w["t"][gold[:-1], gold[1:]].sum())
        np.add.at(grad["t"], (gold[:-1], gold[1:]), -1)
        d = p
        np.put_along_axis(d, gold[..., None], np.take_along_axis(d, gold[..., None], 2) - 1, 2)
        grad["o"] = both.reshape(-1, 2 * h).T @ d.reshape(-1, k)
        grad["c"] = d.sum((0, 1))
        d_both = d @ w["o"].T
        for side, kept, d_out in (("f", kept_f, d_both[..., :h]), ("b", kept_b, d_both[..., h:])):
            u = w["u" + side]
            d_state, d_cell = np.zeros((count, h), np.float32), np.zeros((count, h), np.float32)
            for t, i, f, o, new, before, last, squashed, rest in reversed(kept):
                ds = d_out[t] + d_state
                dc = d_cell + ds * o * (1 - squashed * squashed)
                ds[rest], dc[rest] = 0, 0
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - new * new)], 1)
                grad["u" + side] += last.T @ dz
                np.add.at(grad["x" + side], ids[t], dz)
                d_state, d_cell = dz @ u.T, dc * f
        return loss / (steps * count), {n: g / count for n, g in grad.items()}

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{n: v.astype(np.float16) for n, v in self.w.items()})

    @staticmethod
    def load(path: str) -> Tagger:
        tagger = Tagger.__new__(Tagger)
        with np.load(path) as data:
            tagger.w = {n: data[n].astype(np.float32) for n in data.files}
        return tagger


def batch_of(examples: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) inputs and labels of examples made of (text, type) parts; every fifth has no marked names, so that unknown ones are learned."""
    texts = ["".join(t for t, _ in parts) for parts in examples]
    longest = max(map(len, texts))
    ids, gold = np.zeros((longest, len(texts)), np.int64), np.zeros((longest, len(texts)), np.int64)
    for b, parts in enumerate(examples):
        ids[: len(texts[b]), b] = numbers(texts[b], b % 5 > 0)
        at = 0
        for text, kind in parts:
            if kind:
                first = LABELS.index("B-" + kind)
                gold[at : at + len(text), b] = first + 1
                gold[at, b] = first
            at += len(text)
    return ids, gold


def train(tagger: Tagger, gradients, steps: int, rate: float = 0.012, report=None) -> Tagger:
    """Adam steps on the mean of the (loss, gradient) pairs of ``gradients(step)``; the rate falls to a twentieth."""
    first, second = ({n: np.zeros_like(v) for n, v in tagger.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        parts = gradients(step)
        loss = sum(p[0] for p in parts) / len(parts)
        grad = {n: sum(p[1][n] for p in parts) / len(parts) for n in tagger.w}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * max(0.05, 1 - step / steps)
        for n, g in grad.items():
            g = g * min(1, 5 / max(norm, 1e-9))
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            tagger.w[n] = (tagger.w[n] - now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if report and step % 50 == 0:
            report(step, loss)
    return tagger
