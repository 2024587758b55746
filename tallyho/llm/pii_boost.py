r"""Personal data: base patterns, and candidates chosen by boosted trees.

Base matches of four kinds always stand.  High-recall generators propose
further, overlapping spans (digit groups, dotted numbers, addresses written
with at and dot).  Candidates that fail a format check of their kind (suffix,
octets, check digit, number of digits, piece of a longer number or word) are
never added, nor learned from.  Boosted trees judge the others by their shape
and the words around them.  They learn only from candidates that touch no base
span, as these alone can be added: base matches of all
documents, rewritten in forms that the base rules miss (at and dot in words,
no plus sign, other separators), are the positive class; ordinary numbers and
words that pass the format check (counts, decimals, dates, identifiers, "stood
at rome.org"), put between words at places drawn by hash over the whole texts,
are the negative one.  Candidates found in the texts are in neither class, so
real addresses in such forms are no counter-examples.  Each kind's threshold is
the least score at which the held-out half of the documents has ``PRECISION``.
Candidates that pass, touch no base span and win over the candidates they
overlap are added.

The generators propose local parts of at most 64, labels of at most 63 code
points, and hosts of at most nine labels, which is what addresses may have.

Positions are code points, ends exclusive.  Null texts count as empty.
Repeated rows are scanned row by row; ties between overlapping candidates go
to the earlier, then longer, then earlier-listed one.  Only ``doc_id`` and
``text`` are read.  Without both classes nothing is added.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.llm.common import map_texts, staged
from tallyho.llm.quality_gbt import BINS, DEPTH, LEAST, RATE, RIDGE, Trees

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.98         # of added spans, on held-out candidates
CONTEXT = 40             # code points before and after that are looked at
ORDINARY = 6             # ordinary numbers and words put into a document
UNIT = 2.0 ** 20         # of a gradient of 1; sums stay exact up to 2 ** 33 examples
STEPS = 2 ** 16          # of a score, for thresholds

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, as the whole run would match as well
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: High-recall generators: kind, pattern.
GENERATORS = [
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
                         r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){0,8}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,5}(?:(?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?|\x20dot\x20)[0-9]{1,5}){2,7}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}(?![0-9])")),
]
_WRITTEN = re.compile(r"@|[\[(]at|\x20dot\x20")
_SPOKEN = re.compile(r"\x20at\x20[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
_SEPARATOR = re.compile(r"@|\x20?[\[(]at[\])]\x20?|\x20at\x20")
_CUES = [re.compile(p, re.I) for p in
         (r"mail|contact|write", r"\bip\b|address|host|server", r"card|visa|credit|pay", r"tel|phone|call|mobile|fax")]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping addresses, found from their at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of ``KINDS``."""
    digits = any(map(text.__contains__, "0123456789"))
    out: list[list[tuple[int, int]]] = [list(_emails(text)) if "@" in text else [], [], [], []]
    if not digits:
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all((p.lstrip("0") or "0").isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in m[0].split(".")):
                out[1].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            number = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(number) <= 19 and luhn(number):
                out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out[3].append(m.span())
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every proposed span; spans of several kinds may overlap."""
    digits = any(map(text.__contains__, "0123456789"))
    out = []
    for kind, (_, pattern) in enumerate(GENERATORS):
        if digits if kind else any(map(text.__contains__, ("@", "(at", "[at", " dot "))):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    out = [c for c in out if c[0] or _WRITTEN.search(text, c[1], c[2])]
    for m in _SPOKEN.finditer(text) if " at " in text else ():
        start = m.start()
        while start and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
    return list(dict.fromkeys(out))


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of a span and of what surrounds it.  Cues of other kinds do not
    count: personal data of one kind often follows that of another."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    digits = sum(c in "0123456789" for c in span)
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    name = _SEPARATOR.split(span)[0]
    return [kind == k for k in range(4)] + [
        end - start, digits, sum(c.isalpha() for c in span), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
        span.count("."), span.count("-"), span.count(" "), span.count("("), span.startswith("+"), "@" in span,
        len(span.rsplit(".", 1)[-1]), " at " in span, "(at)" in span or "[at]" in span, "dot" in span,
        sum(not c.isalpha() for c in name), len(name), len(name) == sum(c.islower() for c in name),
        len(groups) > 1 and set(sizes[1:]) == {3}, any(len(g) == 4 and g[:2] in ("19", "20") for g in groups),
        before[-1:].isspace() or not before, before[-1:].isalnum(), after[:1].isspace() or not after, after[:1].isalnum(),
        sum(c in "0123456789" for c in before), sum(c in "0123456789" for c in after),
        bool(_CUES[kind].search(before)), digits == end - start]


_NUMBER_BEFORE, _NUMBER_AFTER = re.compile(r"[0-9][.,:/]\Z"), re.compile(r"[.,:/-][0-9]")


def fails(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a candidate's format rules its kind out."""
    span = text[start:end]
    if kind == 0:   # no suffix of letters
        labels = re.split(r"\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20", _SEPARATOR.split(span)[-1])
        return len(labels) < 2 or not (labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24)
    if text[max(0, start - 1):start].isalnum() or text[end:end + 1].isalnum():   # a piece of a longer word
        return True
    if _NUMBER_BEFORE.search(text[max(0, start - 2):start]) or _NUMBER_AFTER.match(text[end:end + 2]):
        return True
    numbers = re.findall(r"[0-9]+", span)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) != 4 or any(int(n) > 255 for n in numbers)
    if kind == 2:
        return not (13 <= len(digits) <= 19 and luhn(digits))
    return not 9 <= len(digits) <= 15


_AT = ["(at)", " (at) ", "[at]", " [at] ", " at "]
_DOT = ["(dot)", " (dot) ", "[dot]", " [dot] ", " dot "]


def rewritten(kind: int, span: str, turn: int) -> list[str]:
    """Forms of a base match that the base rules miss."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        name, _, host = span.rpartition("@")
        labels = host.split(".")
        form = turn % 5
        letters, two = re.sub("[^A-Za-z]", "", name) or "jo", re.sub("[0-9]+", re.sub("[^A-Za-z]", "", host)[:6], name)
        bracket, short = turn % 4, ".".join(labels[-2:])
        return [name + _AT[form] + _DOT[form].join(labels), name + _AT[form] + ".".join(labels), name + " at " + host,
                letters[:2 + turn % 9] + _AT[bracket] + _DOT[bracket].join(labels), letters + _AT[bracket] + short,
                two + " at " + host, two + " at " + short]
    if kind == 1:
        numbers = span.split(".")
        return [_DOT[turn % 5].join(numbers), ["[.]", "(.)"][turn % 2].join(numbers)]
    if kind == 2:
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    last = digits[-10:]
    groups = [last[:-7], last[-7:-4], last[-4:]]
    return [span.lstrip("+"), " .-"[turn % 3].join(groups), f"({groups[0]}) {groups[1]}-{groups[2]}"]


def _checked(number: str) -> str:
    """The number with its last digit changed so that it passes Luhn's check."""
    head = number.rstrip("0123456789") + number[len(number.rstrip("0123456789")):-1]
    return next(head + c for c in "0123456789" if luhn(re.sub("[^0-9]", "", head + c)))


def ordinary(turn: int, word: str) -> str:
    """An ordinary number, or ordinary words, that may look like personal data."""
    rng = random.Random(turn)

    def num(n, first="123456789"):
        return rng.choice(first) + "".join(rng.choices("0123456789", k=n - 1))

    year, day, month = f"{rng.randint(1900, 2060)}", f"{rng.randint(1, 28):02d}", f"{rng.randint(1, 12):02d}"
    time = [f"{rng.randint(0, 23):02d}", *(f"{rng.randint(0, 59):02d}" for _ in range(2))]
    thousands = [num(rng.randint(1, 3)), *(num(3, "0123456789") for _ in range(rng.randint(2, 5)))]
    host = rng.choice(["", "www.", f"docs{num(1)}.", "mail."]) + f"{word.lower()}.{rng.choice(['org', 'com', 'net', 'html', 'info', 'de'])}"
    forms = [
        " ".join(thousands), ".".join(thousands), _checked(".".join([*thousands, num(3), num(3)])),
        f"{num(rng.randint(1, 3))}.{num(rng.randint(6, 12), '0123456789')}", _checked(f"{num(1)}.{num(rng.randint(12, 16), '0123456789')}"),
        f"-{num(rng.randint(1, 2))}.{num(rng.randint(7, 9), '0123456789')}",
        "-".join([year, month, day]) + " " + rng.choice(["-", "."]).join(time), f"{day}.{month}.{year} " + ".".join(time[:2]),
        f"{day}.{month}.{year}-{num(2)}.{month}", f"{year}{month}{day}-" + "".join(time), f"{year}{month}{day}" + "".join(time),
        num(rng.randint(9, 15)), f"978-{num(1)}-{num(rng.randint(2, 5))}-{num(4)}-{num(1)}", f"{year}-{num(rng.randint(5, 8))}",
        f"{num(1)}.{num(rng.randint(1, 2))}.{num(rng.randint(1, 3))}-{num(rng.randint(6, 9))}",
        f"{word} at {host}", f"{word} at {word.lower()} dot {host.split('.')[-1]}", f"{word} at {num(2)}.{num(2)}.{host}"]
    return rng.choice(forms)


def _made(text: str, at: int, end: int, form: str):
    """Candidates of ``form`` in place of text[at:end] that pass their format check
    and touch no base span: (kind, whether it covers the form, features)."""
    around = 2 * CONTEXT
    start = min(at, around)
    part = text[at - start:at] + form + text[end:end + around]
    own = Spans(s for found in base_spans(part) for s in found)
    for c in candidates(part):
        if c[1] < start + len(form) and c[2] > start and not own.touch(c[1], c[2]) and not fails(part, *c):
            yield c[0], c[1] <= start and c[2] >= start + len(form), features(part, *c)


def examples(text: str):
    """(kind, y, features) of the candidates to learn from; none touches a base span."""
    base = base_spans(text)
    taken = Spans(s for spans in base for s in spans)
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    for i in range(ORDINARY):
        turn = zlib.crc32(f"{seed}:{i}".encode())
        at = text.find(" ", turn % (len(text) + 1)) + 1
        if at and not taken.touch(at - CONTEXT, at + CONTEXT):
            word = re.match(r"[A-Za-z]*", text[at:at + 20])[0] or "page"
            for kind, _, x in _made(text, at, at, ordinary(turn, word) + " "):
                yield kind, 0, x
    for kind, spans in enumerate(base):
        for start, end in spans:
            turn = zlib.crc32(text[start:end].encode("utf-8", "replace"))
            for form in rewritten(kind, text[start:end], turn):
                for found, whole, x in _made(text, start, end, form):
                    if found == kind and whole:
                        yield kind, 1, x


@dataclass
class PiiModel:
    """Trees over candidates of all kinds, and one threshold a kind."""

    trees: Trees | None
    thresholds: list[float]

    def added(self, text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
        """The chosen (kind, start, end) that touch no base span or each other."""
        if self.trees is None:
            return []
        taken = Spans(s for spans in base for s in spans)
        found = [c for c in candidates(text) if not taken.touch(c[1], c[2]) and not fails(text, *c)]
        if not found:
            return []
        score = self.trees.score(np.array([features(text, *c) for c in found], float))
        passed = sorted(((-s, c[1], -c[2], c[0]) for s, c in zip(score, found) if s >= self.thresholds[c[0]]))
        chosen, used = [], Spans(())
        for _, start, end, kind in passed:
            if not used.touch(start, -end):
                chosen.append((kind, start, -end))
                used.add(start, -end)
        return sorted(chosen)


class Spans:
    """Spans merged into runs that do not overlap, searched by bisection."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touch(self, start: int, end: int) -> bool:
        """Whether a run shares a position with [start, end)."""
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """Add a span that touches none."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def counted_examples(docs: DataFrame) -> DataFrame:
    """(held, kind, y, x, n): the examples of all documents, equal ones counted;
    ``x`` holds the features, which are whole numbers, as 32-bit integers."""
    def task(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text):
                held = hashlib.md5(str(doc_id).encode()).digest()[0] % 2 == 0
                rows += [(held, kind, y, np.array(x, "<i4").tobytes()) for kind, y, x in examples(text)]
            yield pd.DataFrame(rows, columns=["held", "kind", "y", "x"])

    return (docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
            .mapInPandas(task, "held boolean, kind int, y int, x binary")
            .groupBy("held", "kind", "y", "x").agg(F.count(F.lit(1)).alias("n")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), -1).astype(float)


def _edges(rows: DataFrame) -> list[np.ndarray]:
    """Cuts between bins of each feature: quantiles of all rows."""
    def task(batches):
        for b in batches:
            x, n = _matrix(b.x), b.n.to_numpy()
            for j in range(x.shape[1]):
                value, at = np.unique(x[:, j], return_inverse=True)
                yield pd.DataFrame({"feature": j, "value": value, "n": np.bincount(at, n).astype(int)})

    # a feature counts or measures something in a span and its surroundings, so its values are few
    seen = (rows.mapInPandas(task, "feature int, value double, n long")
            .groupBy("feature", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["feature", "value"]))
    out = []
    for _, own in seen.groupby("feature"):
        value, upto = own.value.to_numpy(), own.n.to_numpy().cumsum()
        at = np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1)
        low, high = (value[np.searchsorted(upto, f(at), side="right")] for f in (np.floor, np.ceil))
        out.append(np.unique(low + (at - np.floor(at)) * (high - low)))
    return out


def _histograms(rows: DataFrame, done: Trees, tree: tuple[np.ndarray, np.ndarray], level: int,
                edges: list[np.ndarray]) -> np.ndarray:
    """Sums of gradients, second derivatives and rows by node of a level, feature
    and bin.  Each is added up as whole numbers, so order does not matter."""
    width, f = 2 ** level, len(edges)

    def task(batches):
        sums = np.zeros((3, width * f * BINS))
        for b in batches:
            x, n = _matrix(b.x), b.n.to_numpy(float)
            p = done.score(x)
            node = np.zeros(len(x), np.int64)
            for _ in range(level):
                node = 2 * node + 1 + (x[np.arange(len(x)), tree[0][node]] > tree[1][node])
            binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
            cell = ((node - width + 1)[:, None] * (f * BINS) + np.arange(f) * BINS + binned).ravel()
            for i, v in enumerate((np.rint(UNIT * (b.y.to_numpy() - p)), np.rint(UNIT * p * (1 - p)), 1)):
                sums[i] += np.bincount(cell, np.repeat(v * n, f), width * f * BINS)
        yield pd.DataFrame({"sums": [sums.tobytes()]})

    parts = rows.coalesce(64).mapInPandas(task, "sums binary").collect()   # at most 64 arrays of 0.6 MB
    total = sum(np.frombuffer(r.sums) for r in parts).reshape(3, width, f, BINS).cumsum(3)
    return total / np.array([UNIT, UNIT, 1.0])[:, None, None, None]


def boost_counted(rows: DataFrame, share: float, trees: int = 40) -> Trees:
    """``quality_gbt.boost`` on all rows of a table (y, x, n), a pass a level:
    executors add up the histograms, the driver chooses the splits."""
    edges = _edges(rows)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    mean = np.clip(share, 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)),
                float(np.log(mean / (1 - mean))))

    def worth(a, b):
        return a * a / (b + RIDGE)

    for t in range(trees):
        done = Trees(out.feature[:t], out.threshold[:t], out.leaf[:t], out.base)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            g, h, c = _histograms(rows, done, (out.feature[t], out.threshold[t]), level, edges)
            gain = worth(g, h) + worth(g[..., -1:] - g, h[..., -1:] - h) - worth(g[..., -1:], h[..., -1:])
            gain[(c < LEAST) | (c[..., -1:] - c < LEAST)] = 0
            for k, best in enumerate(gain.reshape(width, -1).argmax(1)):
                j, cut = divmod(int(best), BINS)
                split = gain[k, j, cut] > 1e-9 and cut < len(edges[j])
                if split:
                    out.feature[t, first + k], out.threshold[t, first + k] = j, edges[j][cut]
                if level == DEPTH - 1:   # what went left and right are the leaves
                    left = np.array([v[k, j, cut if split else -1] for v in (g, h)])
                    for side, (a, b) in enumerate((left, np.array([v[k, 0, -1] for v in (g, h)]) - left)):
                        out.leaf[t, 2 * k + side] = RATE * a / (b + RIDGE)
    return out


def fit_pii(docs: DataFrame) -> PiiModel:
    """Learn from the examples of all documents: trees from one half by hash of
    the ids, thresholds from the other."""
    rows = staged(counted_examples(docs), "pii-examples")
    size = {r.y: r.n for r in rows.where("not held").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(size) < 2:
        return PiiModel(None, [2.0] * 4)
    trees = boost_counted(rows.where("not held").select("y", "x", "n"), size[1] / sum(size.values()))
    return PiiModel(trees, thresholds(rows.where("held"), trees))


def thresholds(rows: DataFrame, trees: Trees) -> list[float]:
    """Of each kind the least score, in steps of 1 / ``STEPS``, at which all
    candidates from it up have ``PRECISION``; 2 if there is none."""
    def task(batches):
        for b in batches:
            yield pd.DataFrame({"kind": b.kind, "step": np.floor(STEPS * trees.score(_matrix(b.x))).astype(int),
                                "right": b.y * b.n, "n": b.n})

    # at most ``STEPS`` + 1 rows a kind
    seen = (rows.mapInPandas(task, "kind int, step int, right long, n long").groupBy("kind", "step")
            .agg(F.sum("right").alias("right"), F.sum("n").alias("n")).toPandas().sort_values("step", ascending=False))
    out = [2.0] * len(KINDS)
    for kind, own in seen.groupby("kind"):
        right = own.right.cumsum() / own.n.cumsum()
        good = own.step[(right >= PRECISION) & (own.step >= STEPS / 2)]
        if len(good) and own.right.sum() >= 5:
            out[kind] = float(good.iloc[-1]) / STEPS
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    def one(text):
        text = text or ""
        base = base_spans(text)
        flat = [(k, s, e) for k, spans in enumerate(base) for s, e in spans]
        return (*map(len, base), hashlib.sha256(_joined(flat).encode()).hexdigest(),
                _joined(flat + model.added(text, base)))

    fields = {**{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string()}
    return map_texts(docs, fields, lambda: lambda texts: zip(*map(one, texts)) if texts else [[]] * 6)


def pii_query(docs: DataFrame) -> DataFrame:
    """Fit on every document, then scan every document."""
    return find_pii(docs, fit_pii(docs))
