"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes.

The base patterns find whole e-mail addresses, network addresses, cards and phone numbers. The chain
adds what is written otherwise (a national phone number without a plus, a spelled-out address), from
the shapes of a word and its neighbours; its spans never touch a base span. It is trained from a small
labelled table, by gradient steps on the exact likelihood, and decoded by Viterbi over batches of lines.

Every kind has a digit or an at sign (as such, or spelled in brackets). Lines without one hold no such
data, so they need no table.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, schema_of, slices, texts

#: Kinds in the order of their ranks at equal starts, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AT_SIGN = re.compile(r"[(\[](?:at|AT)[)\]]")
SPELLED_AT, SPELLED_DOT = re.compile(r"(?i)[\x20\x09]at[\x20\x09].*[\x20\x09]dot[\x20\x09]"), re.compile(r"(?i)[\x20\x09]dot[\x20\x09]")
#: A line without any of these has nothing to add.
MARKED = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]|[\x20\x09](?:dot|DOT|Dot)[\x20\x09]")

#: Labelled lines used at most for a fit; a larger table is cut to the first of them by their hash.
MAX_LABELLED = 2_000
#: Words of the lines decoded in one table.
TABLE_WORDS = 200_000

SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, by start and kind; leftmost, not overlapping within a kind."""
    found: list[tuple[int, int, int]] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            found.append((lo, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = NOT_DIGITS.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# --- the chain ---

#: A kind's number labels the first word of a span of it, ``INSIDE`` more the words behind it.
OUTSIDE = len(KINDS)
INSIDE = len(KINDS) + 1
LABELS = 2 * len(KINDS) + 1
PLAIN, EDGE = "x", "<edge>"
TRIM_LEFT, TRIM_RIGHT = "\"'`<[{", "\"'`>]},;:!?."


#: Runs of a word's shape that are held as they are.
RUNS = 12
#: Words that spell an address.
SPELLED = {"at": "at", "dot": "dot", "com": "tld", "org": "tld", "net": "tld", "edu": "tld", "gov": "tld", "info": "tld"}


def shape(word: str) -> str:
    """What a word looks like: runs of letters and digits by kind and length class, marks as they are, all of it."""
    if word.isalpha():
        return SPELLED.get(word.lower(), PLAIN)
    core = word.strip(TRIM_LEFT).rstrip(TRIM_RIGHT)
    if word.lower() in ("(at)", "[at]"):
        return "(at)"
    if not core or core.isalpha():
        return SPELLED.get(core.lower(), PLAIN)
    out, i, n = [], 0, len(core)
    while i < n:
        c, j = core[i], i
        if "0" <= c <= "9":
            while j < n and "0" <= core[j] <= "9":
                j += 1
            k = j - i
            out.append(str(k) if k <= 4 else "5-8" if k <= 8 else "9-11" if k <= 11 else ("card" if luhn(core[i:j]) else "12+") if k <= 19 else "20+")
        elif c.isalpha():
            while j < n and core[j].isalpha():
                j += 1
            out.append("x")
        else:
            j += 1
            out.append(c if c in "@.()+-/:_=" else "?")
        i = j
    if len(out) > RUNS:  # the rest by a hash, and by the mark that traits look for
        rest = out[RUNS:]
        out = [*out[:RUNS], *(["@"] if "@" in rest and "@" not in out[:RUNS] else []), f"~{zlib.crc32(' '.join(rest).encode()):x}"]
    return " ".join(out)


def traits(kind: str) -> list[str]:
    """The features of a shape: itself and a few of its traits, so that unseen shapes still say something."""
    parts = kind.split(" ")
    out = ["s:" + kind]
    if "@" in parts:
        out.append("has@")
    if parts[0] == "(":
        out.append("opens")
    if any(p[0].isdigit() for p in parts):
        out.append("digits")
    if "x" in parts:
        out.append("letters")
    if parts.count(".") >= 3:
        out.append("dots")
    return out


class Chain:
    """Weights over (feature, place before/here/after, label) and over neighbouring labels."""

    def __init__(self, features: dict[tuple[int, str], int], weights: np.ndarray, moves: np.ndarray):
        self.features, self.weights, self.moves = features, weights, moves
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        for s in (EDGE, PLAIN):
            self.shape_id(s)

    def shape_id(self, kind: str) -> int:
        known = self.ids.get(kind)
        if known is None:
            row = np.zeros((3, LABELS))
            for place in range(3):
                for t in traits(kind) if kind != EDGE else [EDGE]:
                    f = self.features.get((place, t))
                    if f is not None:
                        row[place] += self.weights[f]
            known = len(self.rows)
            if known < 200_000:  # bounds memory only
                self.ids[kind] = known
            self.rows.append(row)
        return known

    def decode(self, lines: list[list[int]]) -> list[np.ndarray]:
        """The best labels of each line of shape ids, by Viterbi over one padded table."""
        if not lines:
            return []
        size = np.array([len(x) for x in lines])
        n, t = len(lines), int(size.max())
        ids = np.zeros((n, t + 2), dtype=np.int64)  # EDGE is 0
        for k, x in enumerate(lines):
            ids[k, 1 : len(x) + 1] = x
        table = np.stack(self.rows)
        scores = table[ids[:, :-2], 0] + table[ids[:, 1:-1], 1] + table[ids[:, 2:], 2]
        best, back = scores[:, 0].copy(), np.zeros((n, t, LABELS), dtype=np.int8)
        ends = np.empty((n, LABELS))
        ends[size == 1] = best[size == 1]
        for k in range(1, t):
            through = best[:, :, None] + self.moves
            back[:, k] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[:, k]
            ends[size == k + 1] = best[size == k + 1]
        labels = np.full((n, t), OUTSIDE, dtype=np.int8)
        now = ends.argmax(axis=1)
        labels[np.arange(n), size - 1] = now
        for k in range(t - 1, 0, -1):
            inside = k < size
            now = np.where(inside, back[np.arange(n), k, now], now)
            labels[inside, k - 1] = now[inside]
        return [labels[k, : size[k]] for k in range(n)]


def fit(lines: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Fit to lines of (shapes, labels) by gradient steps on the exact conditional likelihood."""
    features: dict[tuple[int, str], int] = {}
    rows = []
    for shapes, labels in lines:
        padded = [EDGE, *shapes, EDGE]
        cells = []
        for k in range(1, len(padded) - 1):
            own = []
            for place in range(3):
                kind = padded[k + place - 1]
                for t in traits(kind) if kind != EDGE else [EDGE]:
                    own.append(features.setdefault((place, t), len(features)))
            cells.append(own)
        rows.append((cells, labels))
    n, t = len(rows), max(len(c) for c, _ in rows)
    width = max(len(own) for c, _ in rows for own in c)
    none = len(features)
    at, mask, gold = np.full((n, t, width), none), np.zeros((n, t)), np.zeros((n, t), dtype=int)
    for i, (cells, labels) in enumerate(rows):
        for k, own in enumerate(cells):
            at[i, k, : len(own)] = own
            mask[i, k], gold[i, k] = 1, labels[k]
    weights, moves = np.zeros((none + 1, LABELS)), np.zeros((LABELS, LABELS))
    speed = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    hot = np.eye(LABELS)[gold] * mask[:, :, None]
    pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:] * mask[:, 1:, None])

    used = np.flatnonzero(at.ravel() != none)
    feature, cell = at.ravel()[used], used // width
    goes_on = mask[:, 1:, None]
    for _ in range(steps):
        emit = weights[at].sum(axis=2)
        own, step = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves)
        # Both passes in shares of each place, so that no line is too long for a float; padding changes nothing.
        forward, backward, total = np.zeros_like(own), np.ones_like(own), np.ones((n, t, 1))
        for k in range(t):
            new = own[:, k] if k == 0 else (forward[:, k - 1] @ step) * own[:, k]
            total[:, k, 0] = np.where(mask[:, k] > 0, new.sum(axis=1), 1)
            forward[:, k] = np.where(mask[:, k, None] > 0, new / total[:, k], forward[:, k - 1])
        ahead = own / total
        for k in range(t - 2, -1, -1):
            backward[:, k] = np.where(mask[:, k + 1, None] > 0, (ahead[:, k + 1] * backward[:, k + 1]) @ step.T, 1)
        p = forward * backward * mask[:, :, None]
        expected = step * np.tensordot(forward[:, :-1], ahead[:, 1:] * backward[:, 1:] * goes_on, axes=([0, 1], [0, 1]))
        gap = (hot - p).reshape(-1, LABELS)[cell]
        slope = np.stack([np.bincount(feature, gap[:, j], none + 1) for j in range(LABELS)], axis=1)
        for value, grad, seen in ((weights, slope / n - decay * weights, speed[0]), (moves, (pairs - expected) / n - decay * moves, speed[1])):
            seen += grad * grad
            value += rate * grad / np.sqrt(seen)
    return Chain(features, weights[:-1], moves)


def labelled_lines(count: int = 1_000, seed: int = 5) -> list[tuple[str, str]]:
    """Labelled lines made by rule: the text, and its spans as ``kind:start:end`` joined by commas."""
    rng = random.Random(seed)
    plain = ["the", "of", "und", "der", "les", "de", "que", "word", "lines,", "today.", "at", "dot", "it", "call", "or", "write", "Then", "after"]

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def name() -> str:
        return "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9)))

    made = [
        ("phone", lambda: f"+1 ({d(3)}) 555-{d(4)}"), ("phone", lambda: f"({d(3)}) 555-{d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", lambda: f"+{d(2)} {d(3)} {d(4)} {d(3)}"),
        ("email", lambda: f"{name()}.{d(2)}@mail{d(1)}.example.com"), ("email", lambda: f"{name()}@{name()}.org"), ("email", lambda: f"{name()}.{name()} (at) {name()}.com"),
        ("card", card), ("card", lambda: "-".join(card()[i : i + 4] for i in (0, 4, 8, 12))),
        ("ip", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        ("", lambda: str(rng.randint(1, 99999))), ("", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}"), ("", lambda: f"{rng.randint(1, 99)}.{d(2)}"),
        ("", lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(36))}"'), ("", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"), ("", lambda: f"{rng.randint(1990, 2030)}-{d(2)}-{d(2)}"),
        ("", lambda: "1" + d(15) if not luhn("1" + (x := d(15))) else "1" + x), ("", lambda: f"{rng.randint(1, 23)}:{d(2)}"), ("", lambda: f"({rng.randint(1, 99)})"), ("", lambda: f"{name()} at {name()} dot {name()}"),
        ("phone", lambda: f"0{d(2)} {d(7)}"), ("phone", lambda: f"0{d(3)}/{d(7)}"), ("phone", lambda: f"0{d(3)}-{d(6)}"), ("phone", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"), ("", lambda: f"{d(2)}/{d(2)}/{rng.randint(1990, 2030)}"), ("", lambda: f"{d(2)} {d(4)}"),
        *[("email", lambda: f"{name()} at {name()} dot {rng.choice(['com', 'org', 'net', 'edu'])}")] * 3, ("email", lambda: f"{name()} dot {name()} at {name()} dot {rng.choice(['com', 'org', 'net'])}"), ("", lambda: f"at {name()} com"), ("", lambda: f"dot {rng.choice(['com', 'org'])}"),
    ]
    out = []
    for _ in range(count):
        parts, spans, at = [], [], 0
        for _ in range(rng.randint(1, 3)):
            parts += [rng.choice(plain) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.75:
                kind, f = rng.choice(made)
                parts.append((kind, f()))
                if rng.random() < 0.25:  # two of one kind side by side are two spans
                    parts.append((kind, f()))
        text = ""
        for p in parts:
            kind, value = p if isinstance(p, tuple) else ("", p)
            text += " " if text else ""
            at = len(text)
            text += value
            bare = NOT_DIGITS.sub("", value)
            if kind or (len(bare) == len(value) and 12 <= len(bare) <= 19 and luhn(bare)):
                spans.append(f"{kind or 'card'}:{at}:{len(text)}")
        out.append((text, ",".join(spans)))
    return out


def _training_line(text: str, spans: str) -> tuple[list[str], list[int]]:
    marked = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
    words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    labels = [next((k + INSIDE * (a > s) for k, s, e in marked if a < e and b > s), OUTSIDE) for a, b in words]
    return [shape(text[a:b]) for a, b in words], labels


def train(labelled: DataFrame | None = None) -> Chain:
    """The chain fitted to ``labelled`` (columns ``text, spans``), or to lines made by rule."""
    if labelled is None:
        pairs = labelled_lines()
    else:
        rows = labelled.where("text is not null").select("text", F.coalesce("spans", F.lit("")).alias("spans")).orderBy(F.xxhash64("text"), "text").limit(MAX_LABELLED)
        pairs = [(r.text, r.spans) for r in rows.collect()]  # bounded by MAX_LABELLED
    return fit([x for x in (_training_line(*p) for p in pairs) if x[0]])


def _chain_lines(chain: Chain, text: str) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    """Words and shape ids of the lines that need a table."""
    at, n = 0, len(text)
    while at <= n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        if MARKED.search(text, at, end):
            words = [m.span() for m in WORDS.finditer(text, at, end)]
            if words:
                yield words, [chain.shape_id(shape(text[a:b])) for a, b in words]
        at = end + 1


def _address(text: str) -> bool:
    """Whether an added email has a sign or word for @, and one for the dot of its domain."""
    if "@" in text or AT_SIGN.search(text):
        return "." in text or SPELLED_DOT.search(text) is not None
    return SPELLED_AT.search(text) is not None


def _four_parts(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def added_spans(text: str, lines: list[tuple[list[tuple[int, int]], np.ndarray]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A kind's first word and the words inside behind it as spans, without marks around them, clear of ``base`` and
    of what can't be personal. Words inside that follow no word of their kind begin a span."""
    out = []
    for words, labels in lines:
        k = 0
        while k < len(words):
            label, j = int(labels[k]) % INSIDE if labels[k] != OUTSIDE else OUTSIDE, k + 1
            while j < len(words) and label != OUTSIDE and labels[j] == label + INSIDE:
                j += 1
            if label != OUTSIDE:
                lo, hi = words[k][0], words[j - 1][1]
                while lo < hi and (text[lo] in TRIM_LEFT or label == 0 and text[lo] == "("):
                    lo += 1
                while hi > lo and (text[hi - 1] in TRIM_RIGHT or label == 0 and text[hi - 1] == ")"):
                    hi -= 1
                digits = len(NOT_DIGITS.sub("", text[lo:hi]))
                fits = {0: _address(text[lo:hi]) and j - k <= 7, 1: _four_parts(text[lo:hi]), 2: 12 <= digits <= 19, 3: 9 <= digits <= 15}[label]
                if fits and not any(s < hi and e > lo for s, _, e in base):
                    out.append((lo, label, hi))
            k = j
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_all(chain: Chain, held: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text; lines of all texts share the tables, sorted by length."""
    base = [base_spans(t) for t in held]
    todo = [(len(ids), doc, words, ids) for doc, t in enumerate(held) for words, ids in _chain_lines(chain, t)]
    todo.sort(key=lambda x: x[0])
    by_doc: list[list] = [[] for _ in held]
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and todo[end][0] * (end + 1 - at) <= TABLE_WORDS:
            end += 1
        for (_, doc, words, _), labels in zip(todo[at:end], chain.decode([x[3] for x in todo[at:end]]), strict=True):
            if (labels != OUTSIDE).any():
                by_doc[doc].append((words, labels))
        at = end
    return [(b, sorted([*b, *added_spans(t, lines, b)])) for t, b, lines in zip(held, base, by_doc, strict=True)]


def _span_batches(chain: Chain):
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = find_all(chain, b.column(1).to_pylist())
            counts = [[sum(k == i for _, k, _ in base) for base, _ in found] for i in range(len(KINDS))]
            yield batch_of(out, [b.column(0).to_pylist(), *counts, [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], [_joined(every) for _, every in found]])

    return run


def find(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans (``kind:start:end``, code points, end exclusive).

    Null or empty text has no spans; texts of any length are read whole; a null id stays null; repeated rows give
    repeated rows; an empty table gives none. Spans of two kinds may overlap where the base patterns do. Only the two columns
    named are read.
    """
    return texts(docs, id_col, text_col).mapInArrow(_span_batches(train(labelled)), schema_of(SPANS))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        lo, kind, hi = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < hi:
            hi = max(hi, spans[k][2])
            k += 1
        out += [text[at:lo], f"[{KINDS[kind].upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; null stays null and other columns stay as they are.

    Texts of any length are read whole; null ids, repeated ids and repeated rows stay as they are, and equal texts
    change alike; an empty table gives none. Only ``text_col`` is read, so other names can't clash.
    """
    bounded_batches(docs.sparkSession)
    chain, place = train(labelled), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = b.column(place).to_pylist()
            found = find_all(chain, [t or "" for t in held])
            new = pa.array([t if t is None else redacted(t, every) for t, (_, every) in zip(held, found, strict=True)], type=b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([new if i == place else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be passed to Arrow functions
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
