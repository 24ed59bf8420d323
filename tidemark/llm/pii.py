"""Personal data: fixed patterns, and what a linear-chain conditional random field adds to them.

Base patterns, leftmost and without overlaps within a kind, whatever fails its check dropped without retry:
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

The field labels tokens by their word shape and their neighbours' shapes; it learns from labelled_table(), a small
table of sentences, and finds forms that the patterns miss (addresses that spell out "at" and "dot", national phone
numbers). It reads windows (long ones in overlapping sequences) around anchors (a digit, "@", or the word "at" or "dot" in any case); what has none of them
is no span. Its spans are checked like the base ones (digits, Luhn, parts) and never replace or overlap them.

Defined results: a null text counts as empty; a text without spans gives counts of zero and the digest of nothing;
repeated rows are searched each by itself; an empty table gives an empty table. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
#: A match never starts within a run of digits unless one starts at its first.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if _DOTTED.search(text):
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# The field.

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|\w", re.UNICODE)
_WORDS = ("at", "dot", "phone", "tel", "call", "mail", "email", "card", "ip", "com", "org", "net", "token", "version")
_PUNCTUATION = "@.-+()[]_/:,"
SHAPES = {s: k for k, s in enumerate(["^", "$", "lower", "Title", "UPPER", "mixed", "d1", "d2", "d3", "d4", "d5", "d7", "d9", "d13", "d20", "mark", *_WORDS, *_PUNCTUATION])}
#: How far a token looks to both sides.
REACH = 2
#: Tokens of a sequence at most, and of those to either side that another sequence repeats, so that no span is cut;
#: tokens that are decoded at once, and characters of texts whose windows are held at once.
LONGEST, OVERLAP, BATCH, HELD = 512, 64, 1 << 17, 1 << 21


@lru_cache(maxsize=100_000)
def shape(token: str) -> int:
    low = token.lower()
    if low in _WORDS or token in _PUNCTUATION:
        return SHAPES[low]
    if "0" <= token[0] <= "9":
        n = len(token)
        return SHAPES[f"d{n}" if n <= 5 else "d5" if n == 6 else "d7" if n <= 8 else "d9" if n <= 12 else "d13" if n <= 19 else "d20"]
    if not token[0].isalpha():
        return SHAPES["mark"]
    return SHAPES["lower" if token.islower() else "UPPER" if token.isupper() else "Title" if token.istitle() else "mixed"]


def tokenize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans and shape numbers of the tokens; a token that follows without blank has its shape's second number."""
    spans, shapes, last = [], [], -1
    for m in _TOKEN.finditer(text):
        spans.append(m.span())
        shapes.append(2 * shape(m.group()) + (m.start() == last))
        last = m.end()
    return np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(shapes, dtype=np.int64)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, time, 2 REACH + 1) shape numbers around each token, and the lengths."""
    lengths = np.array([len(s) for s in sequences])
    wide = np.full((len(sequences), lengths.max() + 2 * REACH), 2 * SHAPES["$"], dtype=np.int64)
    wide[:, :REACH] = 2 * SHAPES["^"]
    for k, s in enumerate(sequences):
        wide[k, REACH : REACH + len(s)] = s
    return np.stack([wide[:, o : o + lengths.max()] for o in range(2 * REACH + 1)], axis=2), lengths


class Field:
    def __init__(self):
        n = len(LABELS)
        self.emit = np.zeros((2 * REACH + 1, 2 * len(SHAPES), n))
        self.move = np.zeros((n, n))
        # I-x follows B-x or I-x only, and starts nothing.
        self.legal = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])
        self.first = np.array([b[0] != "I" for b in LABELS])

    def _scores(self, context: np.ndarray) -> np.ndarray:
        return sum(self.emit[o][context[:, :, o]] for o in range(2 * REACH + 1))

    def fit(self, table: list[tuple[str, list[Span]]], steps: int = 90, rate: float = 0.2, l2: float = 1e-3) -> Field:
        """Conditional likelihood by forward-backward over the whole table at each step, Adam on its gradient."""
        sequences, golds = [], []
        for text, spans in table:
            at, shapes = tokenize(text)
            gold = np.zeros(len(shapes), dtype=np.int64)
            for kind, a, b in spans:
                inside = np.flatnonzero((at[:, 0] >= a) & (at[:, 1] <= b))
                gold[inside] = LABELS.index(f"I-{kind}")
                gold[inside[:1]] = LABELS.index(f"B-{kind}")
            sequences.append(shapes)
            golds.append(gold)
        context, lengths = _padded(sequences)
        size, longest = context.shape[:2]
        y = np.zeros((size, longest), dtype=np.int64)
        for k, g in enumerate(golds):
            y[k, : len(g)] = g
        inside = np.arange(longest)[None] < lengths[:, None]
        hot = np.eye(len(LABELS))[y] * inside[:, :, None]
        pairs = inside[:, 1:]
        seen = np.einsum("bti,btj->ij", hot[:, :-1] * pairs[:, :, None], hot[:, 1:])
        params, moments = [self.emit, self.move], [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move)]
        blocked, unstarted = np.where(self.legal, 0.0, -1e9), np.where(self.first, 0.0, -1e9)
        for step in range(1, steps + 1):
            e, m = self._scores(context), self.move + blocked
            alpha, beta = np.empty_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + unstarted
            for t in range(1, longest):
                alpha[:, t] = np.where(inside[:, t, None], e[:, t] + _logsum(alpha[:, t - 1, :, None] + m[None], 1), alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                beta[:, t] = np.where(inside[:, t + 1, None], _logsum(m[None] + (e[:, t + 1] + beta[:, t + 1])[:, None], 2), 0.0)
            z = _logsum(alpha[:, -1], 1)
            belief = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
            d_emit = np.zeros_like(self.emit)
            for o in range(2 * REACH + 1):
                np.add.at(d_emit[o], context[:, :, o], hot - belief)
            both = alpha[:, :-1, :, None] + m[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]
            d_move = seen - (np.exp(np.minimum(both, 0)) * pairs[:, :, None, None]).sum((0, 1))
            for p, g, mv in zip(params, (d_emit, d_move), moments, strict=True):
                g = g / size - l2 * p
                mv[0][:] = 0.9 * mv[0] + 0.1 * g
                mv[1][:] = 0.99 * mv[1] + 0.01 * g * g
                p += rate * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, sequences: list[np.ndarray], batch: int = BATCH) -> list[np.ndarray]:
        """The best labels of each sequence: Viterbi over batches of sequences of like length, of at most `batch` tokens with their padding (one sequence at least)."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sequences)
        order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: len(sequences[k]))
        move, unstarted = self.move + np.where(self.legal, 0.0, -1e9), np.where(self.first, 0.0, -1e9)
        while order:
            # The longest first: what it is padded to decides how many fit.
            part = order[-max(1, batch // len(sequences[order[-1]])) :]
            del order[-len(part) :]
            context, lengths = _padded([sequences[k] for k in part])
            e = self._scores(context)
            best, back = e[:, 0] + unstarted, np.zeros(e.shape, dtype=np.int8)
            for t in range(1, e.shape[1]):
                way = best[:, :, None] + move[None]
                back[:, t] = way.argmax(1)
                best = np.where((t < lengths)[:, None], way.max(1) + e[:, t], best)
            label = best.argmax(1)
            path = np.zeros(e.shape[:2], dtype=np.int64)
            for t in range(e.shape[1] - 1, -1, -1):
                path[:, t] = label
                label = np.where(t < lengths, back[np.arange(len(part)), t, label], label)
            for row, k in enumerate(part):
                out[k] = path[row, : lengths[row]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return Field().fit(labelled_table() + spelled_table())


def labelled_table(n: int = 400, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences with known spans, made by rule: what the patterns find, what they miss, and numbers that are neither."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("aeiounrstldmh"), r.integers(2, 9)))
    some = lambda k: " ".join(w.upper() if r.random() < 0.05 else w.title() if r.random() < 0.1 else w for w in (word() for _ in range(k)))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[r.integers(len(x))]

    def email() -> str:
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."))
        host = word() + pick("", num(1))
        return f"{word()}{pick('', '.' + num(2), '.' + word(), '_' + word())}{at}{host}{dot}{pick('com', 'org', 'net')}"

    makers = {
        "email": email,
        "ip": lambda: ".".join(str(x) for x in r.integers(0, 256, 4)),
        "card": lambda: pick(num(16), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", num(13)),
        "phone": lambda: pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(2)}", f"tel {num(3)}-{num(3)}-{num(4)}"),
    }
    others = [
        lambda: f"version {num(1)}.{num(1)}", lambda: f"CC BY-NC {num(1)}.{num(1)}", lambda: f'token = "{"".join(r.choice(list("0123456789abcdef"), 12))}"', lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: num(int(r.integers(1, 8))),
        lambda: f"{num(2)}:{num(2)}", lambda: f"{num(1)}.{num(2)}", lambda: f"{word()} at {word()}", lambda: f"{word()}@{word()}", lambda: f"{num(3)} | {num(3)} | {num(3)}", lambda: f"{word()} dot {word()}", lambda: f"meet at {num(2)}", lambda: f"{num(1)}.{num(1)}.{num(1)}",
    ]
    table = []
    for k in range(n):
        text, spans = some(r.integers(1, 5)) + pick(" ", ", ", ": ", '. "', " "), []
        for _ in range(r.integers(1, 3)):
            if k % 2:
                kind = KINDS[r.integers(4)]
                found = makers[kind]()
                lead = 4 if found.startswith("tel ") else 0
                spans.append((kind, len(text) + lead, len(text) + len(found)))
                text += found
            else:
                text += others[r.integers(len(others))]()
            text += pick(" ", ", ", ". ", "!! ", "*** ") + some(r.integers(1, 4)) + " "
        table.append((text, spans))
    return table


def spelled_table(n: int = 240, seed: int = 8) -> list[tuple[str, list[Span]]]:
    """Addresses that spell out "at" and "dot", without a number about, and sentences in which the two words are no address."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("aeiounrstldmhbcfgkpvw"), r.integers(2, 11)))
    pick = lambda *x: x[r.integers(len(x))]
    some = lambda k: " ".join(w.title() if r.random() < 0.1 else w for w in (word() for _ in range(k)))
    table = []
    for k in range(n):
        text, spans = some(r.integers(0, 5)), []
        text += pick(" ", ", ", ": ", ". ") if text else ""
        if k % 4:
            at, dot = pick((" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"))
            found = pick("", "", "", f"{word()}.", f"{word()}_") + word() + at + word() + pick("", "", dot + word()) + dot + pick("com", "org", "net", word()[:3])
            found = pick(found, found, found, found.title(), found.upper())
            spans.append(("email", len(text), len(text) + len(found)))
            text += found
        else:
            text += pick(f"{word()} at the {word()}", f"{word()} at {word()} {word()}", f"{word()} dot {word()}", f"at {word()} {word()} dot", f"{word()} at the dot {word()}", f"the dot at {word()}", f"at {word()}, dot {word()}")
        table.append((text + pick("", ".", " ", ", ", ". ") + " " + some(r.integers(0, 4)), spans))
    return table


_ANCHOR = re.compile(r"[0-9@]|(?<![^\W\d_])(?:at|dot)(?![^\W\d_])", re.IGNORECASE)
#: Characters to both sides of an anchor that a window holds at least.
WINDOW = 60


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around anchors, cut at blanks."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _ANCHOR.search(text, at):
        a, b = max(m.start() - WINDOW, 0), min(m.end() + WINDOW, len(text))
        while a and not text[a - 1].isspace() and m.start() - a < 2 * WINDOW:
            a -= 1
        while b < len(text) and not text[b].isspace() and b - m.end() < 2 * WINDOW:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        # Anchors are looked for on from the next token; what this window holds already is extended.
        at = m.end()
        while at < b and not text[at].isspace():
            at += 1
    return out


def passes(kind: str, found: str) -> bool:
    d = _digits(found)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 7 <= len(d) <= 15 and not re.search(r"[^0-9+(). -]", found)
    if kind == "ip":
        return len(p := re.findall("[0-9]+", found)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p)
    return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[(]at[\])]|\bat\b) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]|\bdot\b) ?[\w-]+)+", found, re.IGNORECASE))


def _sequences(n: int) -> list[tuple[int, int, int, int]]:
    """For n tokens of a window: (first, end) of each sequence, and (first, end) of the tokens that a span of its own starts with."""
    if n <= LONGEST:
        return [(0, n, 0, n)]
    step, out = LONGEST - 2 * OVERLAP, []
    for a in range(0, n - 2 * OVERLAP, step):
        last = a + step >= n - 2 * OVERLAP
        out.append((a, min(a + LONGEST, n), a + OVERLAP if a else 0, n if last else a + OVERLAP + step))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans, both by kind as listed, then start. Spans of more than OVERLAP tokens are not added in windows of more than LONGEST."""
    base, where, sequences = [], [], []
    for n, text in enumerate(texts):
        base.append(base_spans(text))
        for a, b in windows(text):
            at, shapes = tokenize(text[a:b])
            for first, end, own, others in _sequences(len(shapes)) if len(shapes) else ():
                where.append((n, at[first:end] + a, own - first, others - first))
                sequences.append(shapes[first:end])
    added: dict[int, list[Span]] = defaultdict(list)
    taken: dict[int, bytearray] = {}
    for (n, at, own, others), labels in zip(where, field.decode(sequences), strict=True):
        starts = np.flatnonzero(labels % 2 == 1)
        for s in starts[(starts >= own) & (starts < others)].tolist():
            e = s + 1
            while e < len(labels) and labels[e] == labels[s] + 1:
                e += 1
            kind, a, b = LABELS[labels[s]][2:], int(at[s, 0]), int(at[e - 1, 1])
            if n not in taken:
                taken[n] = bytearray(len(texts[n]))
                for _, x, y in base[n]:
                    taken[n][x:y] = b"\1" * (y - x)
            if not any(taken[n][a:b]) and passes(kind, texts[n][a:b]):
                added[n].append((kind, a, b))
                taken[n][a:b] = b"\1" * (b - a)
    return [(b, sorted(b + added[n], key=lambda x: (KINDS.index(x[0]), x[1]))) for n, b in enumerate(base)]


def _held(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, about HELD characters at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; the counts are of base spans."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for held in _held([t or "" for t in batch.column(1).to_pylist()]) for x in all_spans(held, field)]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
