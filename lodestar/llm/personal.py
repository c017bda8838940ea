"""Personal data: patterns, and spans added by a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the contract: what the base finds, before the checks in `base_spans`. E-mails are found from their at signs, and
#: ip addresses only where a run of digits begins: the same matches, in time that grows with the text and not with its square.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What patterns need: an ASCII digit or @.
TRIGGER = re.compile(r"[0-9@]")
#: What any span needs: a decimal digit of any script, an at sign, or "at" and "dot" as words, at most SPELLED characters apart.
DIGIT, AT = re.compile(r"\d"), re.compile(r"[@\uff20\ufe6b]")
SPELLED, SIDE = 64, 64
DOT_WORD = re.compile(r"(?<![^\W_])dot(?![^\W_])", re.IGNORECASE)
AT_WORD = re.compile(r"(?<![^\W_])at(?![^\W_])", re.IGNORECASE)
#: Windows of WINDOW characters, each new one STEP further, are laid from MARGIN characters before a digit to MARGIN after it,
#: and SIDE (the longest name of an e-mail) around at signs and words.
WINDOW, STEP, MARGIN = 64, 32, 24
#: Digits of an added span at least.
DIGITS = {"ip": 4, "card": 13, "phone": 7}
#: Embedded size, hidden size of each direction, and labels: outside, and first and further characters of each kind.
EMBEDDED, HIDDEN, LABELS = 12, 20, 1 + 2 * len(KINDS)
#: Added spans need this mean probability of their labels.
CONFIDENT = 0.5

#: Classes of characters that the network tells apart: ASCII ones, other letters, other digits, other white space, others.
#: Decimal digits of other scripts, wide and small forms and dashes count as their ASCII ones.
CLASSES = 132


@lru_cache(1 << 16)
def class_of(code: int) -> int:
    c = chr(code)
    if c.isdecimal():
        return 48 + unicodedata.decimal(c)
    plain = "-" if unicodedata.category(c) == "Pd" or code == 0x2212 else unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain < "\x80" and (not plain.isalnum() or unicodedata.east_asian_width(c) == "F"):
        return ord(plain)
    return 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.minimum(codes, 128)
    for i in np.flatnonzero(codes >= 128):
        out[i] = class_of(int(codes[i]))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` without overlap: no name has an at sign in it, so each sign has its own."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL.match(text, begin - 1):
            begin -= 1
        host = DOMAIN.match(text, at + 1) if begin < at else None
        free = at + 1
        if host:
            yield begin, host.end()
            free = host.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches without overlap within a kind; failing ones are dropped."""
    out = []
    if not TRIGGER.search(text):
        return out
    out += [(0, a, b) for a, b in emails(text)]
    for k, kind in enumerate(KINDS):
        if kind == "email" or kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            if kind == "ip":
                good = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))
            else:
                digits = "".join(c for c in m[0] if "0" <= c <= "9")
                good = 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15
            if good:
                out.append((k, m.start(), m.end()))
    return out


def labels_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax_over(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


@dataclass
class Tagger:
    """Parameters: embedding, for each direction the input, recurrent and bias weights of an LSTM, output, and transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        make = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"e": make(CLASSES, EMBEDDED) * np.sqrt(CLASSES) * 0.3, "o": make(2 * HIDDEN, LABELS), "ob": np.zeros(LABELS), "t": np.zeros((LABELS, LABELS))}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            p |= {f"{d}x": make(EMBEDDED, 4 * HIDDEN), f"{d}h": make(HIDDEN, 4 * HIDDEN), f"{d}b": bias}
        return Tagger(p)

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, HIDDEN) of one direction over x (time, row, EMBEDDED), and what the way back needs."""
        p, (h, c) = self.p, np.zeros((2, x.shape[1], HIDDEN), x.dtype)
        inputs, out, kept = x @ p[f"{d}x"] + p[f"{d}b"], np.empty((*x.shape[:2], HIDDEN), x.dtype), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ p[f"{d}h"]
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before_h, before_c, c = h, c, f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            kept.append((t, i, f, o, g, s, before_h, before_c))
        return out, kept

    def back(self, x, d, kept, slope) -> tuple[np.ndarray, dict]:
        p, n = self.p, x.shape[1]
        (dh, dc), dz_all = np.zeros((2, n, HIDDEN), x.dtype), np.empty((*x.shape[:2], 4 * HIDDEN), x.dtype)
        g_h = np.zeros_like(p[f"{d}h"])
        for t, i, f, o, g, s, before_h, before_c in reversed(kept):
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.hstack([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)])
            g_h += before_h.T @ dz
            dz_all[t], dh, dc = dz, dz @ p[f"{d}h"].T, dc * f
        return dz_all @ p[f"{d}x"].T, {f"{d}x": np.einsum("tne,tnz->ez", x, dz_all), f"{d}h": g_h, f"{d}b": dz_all.sum(axis=(0, 1))}

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """Scores (row, time, label) of windows (row, time)."""
        x = self.p["e"][classes.T]
        h = np.concatenate([self.run(x, "f")[0], self.run(x, "b")[0]], axis=2)
        return (h @ self.p["o"] + self.p["ob"]).transpose(1, 0, 2)

    def lattice(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums (time, row, label) over e (time, row, label), and each row's total, as logarithms."""
        t, ahead, behind = self.p["t"], np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for k in range(1, len(e)):
            ahead[k] = softmax_over(ahead[k - 1][:, :, None] + t, 1) + e[k]
        for k in range(len(e) - 2, -1, -1):
            behind[k] = softmax_over(t + (e[k + 1] + behind[k + 1])[:, None, :], 2)
        return ahead, behind, softmax_over(ahead[-1], 1)

    def gradient(self, classes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of labels y (row, time), through the CRF and both LSTMs."""
        p, x = self.p, self.p["e"][classes.T]
        (hf, kf), (hb, kb) = self.run(x, "f"), self.run(x, "b")
        h, n, y = np.concatenate([hf, hb], axis=2), len(classes), y.T
        e = h @ p["o"] + p["ob"]
        ahead, behind, total = self.lattice(e)
        d_e = np.exp(ahead + behind - total[None, :, None])
        np.put_along_axis(d_e, y[:, :, None], np.take_along_axis(d_e, y[:, :, None], 2) - 1, 2)
        both = np.exp(ahead[:-1, :, :, None] + p["t"] + (e + behind)[1:, :, None, :] - total[None, :, None, None])
        g_t = both.sum(axis=(0, 1))
        np.subtract.at(g_t, (y[:-1].ravel(), y[1:].ravel()), 1)
        d_h = d_e @ p["o"].T
        d_f, g_f = self.back(x, "f", kf, d_h[:, :, :HIDDEN])
        d_b, g_b = self.back(x, "b", kb, d_h[:, :, HIDDEN:])
        g_e = np.zeros_like(p["e"])
        np.add.at(g_e, classes.T, d_f + d_b)
        g = {"e": g_e, "o": np.einsum("tnh,tnl->hl", h, d_e), "ob": d_e.sum(axis=(0, 1)), "t": g_t, **g_f, **g_b}
        return {k: v / n for k, v in g.items()}

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest labels of one text's e (time, label) by Viterbi, and the probability of each character's label."""
        t, best, back = self.p["t"], e[0], []
        for k in range(1, len(e)):
            s = best[:, None] + t
            back.append(s.argmax(axis=0))
            best = s.max(axis=0) + e[k]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        labels = np.array(out[::-1])
        ahead, behind, total = self.lattice(e[:, None, :])
        return labels, np.exp(ahead[:, 0] + behind[:, 0] - total[0])[np.arange(len(e)), labels]


def train(texts: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 8, rows: int = 64, rate: float = 0.01, seed: int = 20240817) -> Tagger:
    """texts: labelled windows. Adam over mini-batches of windows, cut or filled to WINDOW characters."""
    x, y = np.full((len(texts), WINDOW), 32), np.zeros((len(texts), WINDOW), np.int64)
    for i, (text, spans) in enumerate(texts):
        c, labels = classes_of(text)[:WINDOW], labels_of(len(text), spans)[:WINDOW]
        x[i, : len(c)], y[i, : len(labels)] = c, labels
    tagger, r = Tagger.new(seed), np.random.default_rng(seed)
    tagger.p = {k: w.astype(np.float32) for k, w in tagger.p.items()}
    m, v, step = ({k: np.zeros_like(w) for k, w in tagger.p.items()} for _ in range(2)), None, 0
    m, v = m
    for turn in range(rounds):
        order = r.permutation(len(x))
        for at in range(0, len(x), rows):
            own, step = order[at : at + rows], step + 1
            for k, g in tagger.gradient(x[own], y[own]).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                tagger.p[k] = tagger.p[k] - rate * 0.9**turn * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tagger


class LabelledSpans:
    """Made windows with labelled spans: personal data of the four kinds in some spellings, and numbers that are none.

    Six of ten spans are in spellings that the patterns miss (`missed`).
    """

    def __init__(self, seed: int = 20240817):
        self.random = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.random.choices("0123456789", k=n))

    def word(self, low: int = 2, high: int = 9) -> str:
        return "".join(self.random.choices("abcdefghijklmnopqrstuvwxyzéüñöç", k=self.random.randint(low, high)))

    def email(self) -> str:
        r = self.random
        name = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) + r.choice(["", "." + self.digits(2), "_x", "." + "".join(r.choices("abcdefgh", k=4))])
        return f"{name}@{''.join(r.choices('abcdefghijklmnop', k=r.randint(3, 7)))}{r.choice(['', self.digits(1)])}.{r.choice(['com', 'example.com', 'org', 'net', 'co.uk'])}"

    def ip(self) -> str:
        return ".".join(str(self.random.randint(0, 255)) for _ in range(4))

    def card(self) -> str:
        body = self.digits(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return self.random.choice(["", " ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.random.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+49 {a} {b}{c}", f"+{self.digits(2)}-{a}-{b}-{c}"])

    def host(self) -> tuple[str, str]:
        r = self.random
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))), r.choice(["com", "org", "net", "example", "de", "fr", "es", "io", "co"])

    def missed(self, kind: str) -> str:
        """A spelling without a match in the base: spaced or spelled e-mails and at signs of other widths, phones without +, cards of other lengths or separators, digits of other scripts."""
        r = self.random
        if kind == "email":
            name = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))
            host, end = self.host()
            at, dot = r.choice([(" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", "."), (" @ ", " . "), ("@", " dot "), ("\uff20", "."), ("\uff20", "\uff0e")])
            if r.random() < 0.3:
                name += r.choice([dot, ".", "_"]) + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 7)))
            return name + at + host + dot + end
        if kind == "phone":
            a, b, c = self.digits(3), self.digits(3), self.digits(4)
            piece = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"0{a[:2]} {b[:2]} {c[:2]} {a[:2]} {c[2:]}", f"0{a}/{b}{c}", f"0{a[0]}-{c}-{b}{a[1]}", f"00{a[:2]} {b} {c}{a}"])
            return piece if r.random() < 0.8 else self.wide(piece)
        if kind == "ip":
            return self.wide(self.ip()) if r.random() < 0.6 else r.choice([" . ", "[.]", "(.)", " dot "]).join(self.ip().split("."))
        if r.random() < 0.4:
            return self.wide(self.card())
        if r.random() < 0.5:
            return r.choice([".", "/", "_", "  ", "\u2013"]).join(re.findall("....", re.sub("[^0-9]", "", self.card())))
        body = r.choice(["34", "37"]) + self.digits(12)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice(["", " ", "-"]).join((number[:4], number[4:10], number[10:]))

    def wide(self, piece: str) -> str:
        zero = self.random.choice([0xFF10, 0xFF10, 0x660, 0x6F0, 0x966])
        marks = zero == 0xFF10 and self.random.random() < 0.5
        return "".join(chr(zero + ord(c) - 48) if "0" <= c <= "9" else chr(0xFEE0 + ord(c)) if marks and c in ".-()" else c for c in piece)

    def other(self) -> str:
        r = self.random
        return r.choice([
            lambda: f"at {self.word()}", lambda: f"look at the {self.word()} dot", lambda: f"dot {self.word()}", lambda: f"@ {r.randint(1, 99)}", lambda: f"{r.randint(1, 30)} {self.word()} {r.randint(1, 999)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 999)} {self.digits(3)} {self.digits(3)}", lambda: self.wide(self.digits(r.randint(1, 6))),
            lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1900, 2030)}", lambda: f"password={''.join(r.choices('0123456789abcdef', k=18))}",
            lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), lambda: f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"',
            lambda: f"{r.randint(1, 999)},{self.digits(3)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23)}:{self.digits(2)}",
            lambda: self.digits(r.randint(1, 13)), lambda: "@" + self.word(), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        ])()

    def window(self) -> tuple[str, list[tuple[int, int, int]]]:
        r, text, spans = self.random, "", []
        while len(text) < WINDOW + 10:
            x = r.random()
            if x < 0.25:
                k = r.randrange(4)
                piece = getattr(self, KINDS[k])() if r.random() < 0.4 else self.missed(KINDS[k])
                spans.append((k, len(text), len(text) + len(piece)))
                text += piece
            else:
                text += self.other() if x < 0.4 else self.word()
            text += r.choice([" ", " ", " ", ", ", ". ", "\n"])
        cut = r.randint(0, 8)
        return text[cut:], [(k, max(a - cut, 0), b - cut) for k, a, b in spans if b > cut]


@lru_cache(4)
def trained(windows: int = 4000, seed: int = 20240817) -> Tagger:
    made = LabelledSpans(seed)
    return train([made.window() for _ in range(windows)])


def triggers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, margin) of what no span is without."""
    for m in DIGIT.finditer(text):
        yield m.start(), m.end(), MARGIN
    for m in AT.finditer(text):
        yield m.start(), m.end(), SIDE
    dots = [m.end() for m in DOT_WORD.finditer(text)]
    k = 0
    for m in AT_WORD.finditer(text) if dots else ():
        while k < len(dots) and dots[k] < m.end():
            k += 1
        if k < len(dots) and dots[k] - m.end() <= SPELLED:
            yield m.start(), dots[k], SIDE


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text around the characters without which no span can be."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a - w), min(len(text), b + w)) for a, b, w in triggers(text)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def possible(kind: str, span: str) -> bool:
    """Whether an added span has what its kind can't be without."""
    if kind == "email":
        return bool(AT.search(span) or AT_WORD.search(span) and DOT_WORD.search(span))
    return len(DIGIT.findall(span)) >= DIGITS[kind]


def find(texts: list[str], tagger: Tagger, rows: int = 256) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text, the base spans and the added ones.

    Windows overlap; a region's scores are the means of its windows' scores, and labels are decoded once over the
    whole region, so that windows agree. An added span must not touch a base span.
    """
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    areas = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    at, waiting, size = 0, [], 0
    while at < len(areas) or waiting:
        if at < len(areas) and size < rows:
            i, a, b = areas[at]
            begins = [*range(0, max(b - a - WINDOW, 0), STEP), max(b - a - WINDOW, 0)]
            waiting.append((i, a, b, begins))
            size, at = size + len(begins), at + 1
            continue
        windows = np.full((size, WINDOW), 32)
        k = 0
        for i, a, b, begins in waiting:
            c = classes_of(texts[i][a:b])
            for w in begins:
                part = c[w : w + WINDOW]
                windows[k, : len(part)] = part
                k += 1
        scores = np.concatenate([tagger.emissions(windows[j : j + rows]) for j in range(0, size, rows)])
        k = 0
        for i, a, b, begins in waiting:
            total, n = np.zeros((b - a, LABELS)), np.zeros((b - a, 1))
            for w in begins:
                part = min(WINDOW, b - a - w)
                total[w : w + part] += scores[k, :part]
                n[w : w + part] += 1
                k += 1
            labels, sure = tagger.decode(total / n)
            for s in np.flatnonzero((labels % 2 == 1)):
                e = s + 1
                while e < len(labels) and labels[e] == labels[s] + 1:
                    e += 1
                kind = (labels[s] - 1) // 2
                if sure[s:e].mean() >= CONFIDENT and e - s >= 5 and possible(KINDS[kind], texts[i][a + s : a + e]) and not any(x < a + e and a + s < y for _, x, y in base[i]):
                    added[i].append((int(kind), int(a + s), int(a + e)))
        waiting, size = [], 0
    return list(zip(base, added, strict=True))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, tagger: Tagger, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone and base (spans of the patterns) and spans (these and the tagger's).

    Spans are kind:start:end, in code points, end exclusive, by kind as in KINDS and then start. Null counts as an empty
    text; texts without a digit of any script, an at sign and the words at and dot have none. Whole texts are searched. Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        found = find(texts, sent.value)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        return [*counts, pa.array([written(base) for base, _ in found], pa.string()), pa.array([written(base + more) for base, more in found], pa.string())]

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(c, T.StringType()) for c in ("base", "spans")]
    return append_columns(docs, fn, fields, drop)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(), drop=("text",))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
