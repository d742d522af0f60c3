"""Operator 2: personal data by a semi-Markov conditional random field over whole spans.

Four kinds: email, ip, card, phone.  The base patterns always count; the field adds spans that they miss (numbers
without a plus, addresses spelled out, other separators).  A candidate segment is a whole span, scored as such:

* numbers: up to ``MOST_GROUPS`` runs of digits and ``MOST_DIGITS`` digits, no more than ``MOST_GAP`` other characters and no
  letter between two runs, with the bracket before the first;
* addresses: an at-mark (``@``, *at* between blanks or in brackets) with the whole local part before it, to which spelled
  dot-marks may join more, and labels after it, each behind a dot-mark, the last of letters.  Neither part has a bound: a
  chain of more than ``PIECES`` joined pieces is a candidate as a whole only, never a part of it.

Candidates that touch a base span or reach over a line end are left out.  Dynamic programming over all candidates of a
text chooses boundaries and types jointly; a segment's score is the fitted field's less ``NONE``, the score of no segment
in its place.  There are no windows: the result is the best segmentation of the whole text.  Weights are fitted here by
likelihood on generated examples (:func:`examples`), the same at every call.

Row by row, without a shuffle; time is linear in the text, for long runs of digits or local parts too.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows give
repeated results; other columns are kept by ``redact`` only.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import by_batch, mapped, renamed, table

KINDS = ("email", "ip", "card", "phone")
#: Of a number: runs of digits (the kinds have no more), digits, and other characters between two runs.
MOST_GROUPS, MOST_DIGITS, MOST_GAP = 6, 19, 4
#: Pieces of an address on either side of its at-mark that are candidates one by one.
PIECES = 8
#: Log odds that a segment needs, as the score of 'none' in its place.
NONE = 1.0
#: Last labels that are common.
COMMON = frozenset("com org net edu gov info io de fr es it uk nl ch at eu us".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text) is None:
        return out
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            # four groups at a time, as a search from left to right takes them
            parts, pos = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                    out.append((1, pos, pos + size))
                pos += size + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_DIGIT = re.compile(r"[0-9]")
_B = r"[^\S\n]"
_BRACKETED_DOT = rf"{_B}{{0,2}}[\[({{<]{_B}?(?:dot|\.){_B}?[\])}}>]{_B}{{0,2}}|{_B}{{1,2}}dot{_B}{{1,2}}"
_DOT = re.compile(rf"{_BRACKETED_DOT}|\.", re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"(?:{_BRACKETED_DOT})\Z", re.IGNORECASE)
_LONGEST_DOT = 14
_LABEL = re.compile(r"[A-Za-z0-9-]*[A-Za-z0-9]")
_LAST = re.compile(r"[A-Za-z]{2,}\Z")
#: Where an at-mark can be; ``at_mark`` looks closer.
_AT = re.compile(r"@|[^A-Za-z0-9@]at(?=[^A-Za-z0-9])", re.IGNORECASE)
_AT_MARK = re.compile(rf"{_B}{{0,2}}[\[({{<]{_B}?(?:at|@){_B}?[\])}}>]{_B}{{0,2}}|{_B}{{1,2}}at{_B}{{1,2}}|@", re.IGNORECASE)
_NEAR = re.compile(r"[0-9@]|[^A-Za-z0-9]at[^A-Za-z0-9]", re.IGNORECASE)
_CUE = re.compile(r"([A-Za-z]+)(?:[:=#]|[^\S\n])*\Z")
_GROUP = re.compile(r"[0-9]+")


def at_mark(text: str, at: int) -> tuple[int, int] | None:
    """The whole at-mark around a place that ``_AT`` has found, with its brackets and blanks."""
    for start in range(max(0, at - 3), at + 1):
        m = _AT_MARK.match(text, start)
        if m and m.end() > at + (text[at] != "@"):
            return m.span()
    return None


def addresses(text: str) -> list[tuple[int, int]]:
    """Candidate addresses, by at-mark."""
    out, free = [], 0
    for m in _AT.finditer(text):
        mark = at_mark(text, m.start())
        if mark is None or mark[0] < free:
            continue
        x, y = mark
        free = y
        lefts, k = [], x
        while k > 0:
            r = k
            while r > 0 and _LOCAL.match(text[r - 1]):
                r -= 1
            start = next((i for i in range(r, k) if text[i].isalnum()), None)
            if start is None:
                break
            lefts.append(start)
            before = _DOT_BEFORE.search(text, max(0, r - _LONGEST_DOT), r)
            if before is None:
                break
            k = before.start()
        label = _LABEL.match(text, y) if lefts else None
        rights = []
        while label and (dot := _DOT.match(text, label.end())):
            label = _LABEL.match(text, dot.end())
            if label and _LAST.match(label.group()):
                rights.append(label.end())
        # a long chain is one address or none
        lefts, rights = (z if len(z) <= PIECES else z[-1:] for z in (lefts, rights))
        out += [(i, j) for i in lefts[::-1] for j in rights]
    return out


def numbers(text: str) -> list[tuple[int, int]]:
    """Candidate numbers, by start."""
    runs = [m.span() for m in _GROUP.finditer(text)]
    out = []
    for i, (a, b) in enumerate(runs):
        start = a - 1 if a and text[a - 1] == "(" else a
        digits, j = b - a, i
        while digits <= MOST_DIGITS and j < i + MOST_GROUPS:
            if digits >= 4:
                out += [(z, runs[j][1]) for z in {start, a}]
            j += 1
            if j == len(runs) or runs[j][0] - runs[j - 1][1] > MOST_GAP or any(c == "\n" or c.isalnum() for c in text[runs[j - 1][1] : runs[j][0]]):
                break
            digits += runs[j][1] - runs[j][0]
    return out


def candidate_segments(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the spans that may be personal data and touch no taken span (sorted, apart), by end, then start."""
    out = set(numbers(text)) | set(addresses(text))
    if taken:
        starts = [s for s, _ in taken]
        out = {(a, b) for a, b in out if (k := bisect.bisect_left(starts, b)) == 0 or taken[k - 1][1] <= a}
    return sorted(out, key=lambda x: (x[1], x[0]))


def segment_features(text: str, a: int, b: int) -> list[str]:
    """Of the whole span, its neighbours and the word before it; kinds have weights of their own for each."""
    s = text[a:b]
    if any(c.isalpha() for c in s):
        plain = "@" in s
        out = ["address", f"sign={plain}", f"bracketed={bool(re.search(r'[\[({<]', s))}", f"dot={bool(re.search(r'(?i)[^a-z]dot[^a-z]', s))}"]
        last = _LAST.search(s).group().lower()
        out.append(f"last={last if last in COMMON else 'other'}")
    else:
        groups = _GROUP.findall(s)
        digits = "".join(groups)
        n = len(digits)
        seps = "".join(sorted({c for c in _DIGIT.sub("", s)}))
        out = ["number", f"digits={min(n, 20)}", f"shape={'-'.join(str(len(g)) for g in groups)}", f"separators={seps[:6]}", f"groups={len(groups)}"]
        if set(seps) - set(" -./()[]"):
            out.append("odd separators")
        if 13 <= n <= 19:
            out.append(f"luhn={luhn(digits)}")
        if len(groups) == 4:
            out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
        if len(set(_DIGIT.sub(" ", s).split())) == 1 and len(groups) > 2:
            out.append("even separators")
        if s.count("(") != s.count(")"):
            out.append("unbalanced")
    if m := _CUE.search(text, max(0, a - 24), a):
        out.append(f"after={m.group(1).lower()}")
    if b < len(text) and (text[b].isalnum() or text[b] in "-/%@") or a and (text[a - 1].isalnum() or text[a - 1] in "-/.$@+"):
        out.append("joined")
    return out


class Field:
    """Weights of (kind, feature); segments without any stand for 'none', which scores nothing."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.zero = np.zeros(len(KINDS))

    def scores(self, features: list[str]) -> np.ndarray:
        return sum((self.weights.get(f, self.zero) for f in features), self.zero)

    def decode(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation of the text."""
        ends, best, back = [0], [0.0], [None]  # best scores up to the ends of candidates, ascending
        for a, b in candidate_segments(text, taken):
            scores = self.scores(segment_features(text, a, b))
            k = int(np.argmax(scores))
            i = bisect.bisect_right(ends, a) - 1
            total = best[i] + scores[k] - NONE
            if total > best[-1]:
                step = (i, (k, a, b))
                if ends[-1] == b:
                    best[-1], back[-1] = total, step
                else:
                    ends.append(b)
                    best.append(total)
                    back.append(step)
        out, i = [], len(ends) - 1
        while i:
            i, span = back[i]
            out.append(span)
        return out[::-1]

    def added_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        taken: list[tuple[int, int]] = []
        for s, e in sorted((s, e) for _, s, e in base):
            if taken and s <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        return self.decode(text, taken)


def examples(seed: int, count: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated snippets with the spans in them that the base patterns do not find."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def card(sep):
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = f"{rng.randint(2, 9)}{digits(2)}", digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{rng.randint(1, 9)} {a} {b} {c}"])

    def ip():
        o = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice(["[.]", " . ", "(.)"]).join(o)

    def email():
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" at ", " dot "), ("@", " dot "), (" at ", ".")])
        end = word() if at.strip()[0] in "[({" and rng.random() < 0.3 else rng.choice(["com", "org", "net", "de", "fr", "io", "edu", "uk", "info"])
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", word() + (dot if dot != "." else "[dot]") + word()])
        return local + at + word() + "".join(dot + word() for _ in range(rng.choice([0, 0, 0, 1]))) + dot + end

    def other():
        return rng.choice(
            [
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", lambda: f"{rng.randint(10, 23)}:{digits(2)}:{digits(2)}",
                lambda: digits(rng.randint(1, 12)), lambda: digits(rng.randint(13, 20)), lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"{digits(2)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(4)} {digits(4)}",
                lambda: f"{digits(3)} {digits(3)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()} and {word()}", lambda: f"{word()} dot {word()}", lambda: f"{word()}@{word()}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()}.{word()}",
                lambda: " ".join(digits(rng.randint(1, 5)) for _ in range(rng.randint(2, 6))), lambda: "-".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(2, 5))), lambda: ".".join(digits(rng.randint(1, 5)) for _ in range(rng.randint(2, 4))), lambda: f"{word()} {digits(4)}", lambda: f"${digits(3)}.{digits(2)}",
                lambda: rng.choice([", ", ":", ",", "; ", "=", " | "]).join(digits(rng.randint(1, 4)) for _ in range(rng.randint(3, 6))), lambda: "".join(digits(rng.randint(1, 3)) + rng.choice([":", ", ", ",", "; "]) for _ in range(rng.randint(3, 6))) + digits(2),
            ]
        )()

    makers = [(0, email, ["email", "mail", "write", "contact"]), (1, ip, ["host", "ip", "server", "address"]), (2, lambda: card(rng.choice([".", "/", "  "])), ["card", "visa", "pay"]), (3, phone, ["call", "phone", "tel", "mobile"])]
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ", ", ": ", " "])
            if rng.random() < 0.5:
                kind, make, cues = rng.choice(makers)
                if rng.random() < 0.5:
                    text += rng.choice(cues) + rng.choice([" ", ": "])
                made = make()
                if not any(k == kind for k, _, _ in base_spans(made)):
                    spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += other()
            text += rng.choice([" ", ". ", "\n", ", "])
        out.append((text + word(), spans))
    return out


@functools.cache
def fitted(seed: int = 7, count: int = 480, epochs: int = 8, rate: float = 0.4, decay: float = 2e-3) -> Field:
    """The field fitted by gradient steps on the log likelihood of generated examples; a few seconds, once a process."""
    index: dict[str, int] = {}
    data = []
    for text, spans in examples(seed, count):
        arcs = candidate_segments(text, sorted((x, y) for _, x, y in base_spans(text)))
        feats = [[index.setdefault(f, len(index)) for f in segment_features(text, a, b)] for a, b in arcs]
        gold = {(x, y): k for k, x, y in spans}
        true = np.array([gold.get(x, -1) for x in arcs], int)
        if arcs:
            places = sorted({0, *(x for arc in arcs for x in arc)})
            at = {x: i for i, x in enumerate(places)}
            data.append((len(places) - 1, np.array([(at[a], at[b]) for a, b in arcs]), np.repeat(np.arange(len(arcs)), [len(f) for f in feats]), np.concatenate(feats).astype(int), true))
    w, seen = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for n, arcs, owner, feat, true in data:
            s = np.full((len(arcs), len(KINDS)), -NONE)
            np.add.at(s, owner, w[feat])
            most = s.max(axis=1)
            total = most + np.log(np.exp(s - most[:, None]).sum(axis=1))  # over kinds
            ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for x, (i, j) in enumerate(arcs.tolist()):
                ends[j].append(x)
                starts[i].append(x)
            alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1] if not ends[j] else np.logaddexp.reduce([alpha[j - 1], *(alpha[arcs[x, 0]] + total[x] for x in ends[j])])
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1] if not starts[i] else np.logaddexp.reduce([beta[i + 1], *(beta[arcs[x, 1]] + total[x] for x in starts[i])])
            p = np.exp(alpha[arcs[:, 0], None] + s + beta[arcs[:, 1], None] - alpha[n])
            g = -p
            hit = np.flatnonzero(true >= 0)
            g[hit, true[hit]] += 1
            step = np.zeros_like(w)
            np.add.at(step, feat, g[owner])
            rows = np.unique(feat)
            grad = step[rows] - decay * w[rows]
            seen[rows] += grad**2
            w[rows] += rate * grad / np.sqrt(seen[rows])
    return Field({f: w[i].round(6) for f, i in index.items()})


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("base", _SPAN), ("spans", _SPAN)])
_DDL = "array<struct<kind:string,start:long,end:long>>"


def _named(spans):
    return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]


def all_spans(text: str | None, field: Field) -> tuple[list, list]:
    """Base spans, and all spans, by kind, then start."""
    if not text or _NEAR.search(text) is None:
        return [], []
    base = base_spans(text)
    return base, sorted(base + field.added_spans(text, base))


def find_personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, base and spans (all, the base ones among them): arrays of kind, start, end."""
    field = field or fitted()

    def work(batch):
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            found = [all_spans(t, field) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_named(x) for x, _ in found], _SPAN), pa.array([_named(y) for _, y in found], _SPAN)], schema=_ARROW)

    return by_batch(renamed(df, id_col, text_col), work, f"doc_id long, base {_DDL}, spans {_DDL}")


def redact(df: DataFrame, *, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """The same rows with each span of ``text_col`` replaced by its kind in angle brackets; other columns as they are."""
    field = field or fitted()
    at = df.columns.index(text_col)

    def clean(text):
        _, spans = all_spans(text, field)
        if not spans:
            return text
        out, done = [], 0
        for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if e > done:
                # spans of two kinds may overlap: the later one has only what is left
                out += [text[done:s] if s > done else "", f"<{KINDS[k].upper()}>" if s >= done else ""]
                done = e
        return "".join(out) + text[done:]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                cols = part.columns
                cols[at] = pa.array([clean(t) for t in cols[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    # its type may be one of Spark's others; plain strings go through Python
    return mapped(df.withColumn(text_col, F.col(text_col).cast("string")), run, df.withColumn(text_col, F.col(text_col).cast("string")).schema)


def joined(spans: str):
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


QUERIES = {"op2_personal_data": op2_personal_data}
ORACLE_SQL: dict[str, str] = {}
