"""Personal data: candidate spans from high-recall generators, chosen by boosted trees.

Well-formed e-mail addresses, IPv4 addresses, payment cards and international
phone numbers (the base spans) are always redacted. Further generators propose
looser forms: spelled-out e-mail addresses, IPv6, cards of 13 to 15 digits or with
other separators, national phone numbers. Format and context features of each
proposal go through gradient-boosted trees; proposals above the kind's calibrated
threshold stay, unless they overlap a base span or a likelier proposal.

There are no labelled spans, so the trees learn from ``TRAINING`` synthetic rows
made here with a fixed seed, proposals of each kind among look-alikes (dates,
amounts, versions, order numbers, digests), of either sort less than half beside a
word that says what they are. Recall and precision on sentences of another making
are in the README. A third of those rows calibrates the
probabilities and sets each kind's threshold at a precision of ``PRECISION``.

Cases: null text is empty; offsets are code points, end exclusive; n_email to
n_phone and base_sha256 count base spans, ``spans`` lists all; kinds overlap only
between base spans; rows that repeat count each time; null ids are handed on;
extra columns are not read, and come through the stage unchanged but for n_chars, the
length of the new text; a very long text is one row of the slices; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.boosting import Boosted
from helixmill.llm.common import bounded_batches, slices

KINDS = ("email", "ip", "card", "phone")
TRAINING, PRECISION = 12_000, 0.995
ROUNDS, DEPTH = 150, 4  # trees and their depth

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A run of digits matches from its first digit or not at all, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[Span]:
    """Base spans by kind as in KINDS, then start."""
    out: list[Span] = []
    end, at = 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and t[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(t, at)):
            end = m.end()
            out.append(("email", lo, end))
        at = t.find("@", at + 1)
    if not _DIGIT.search(t):
        return out
    if "." in t:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(t) if m.end() - m.start() > 15 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in t:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15]
    return out


_AT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\[at\]|\(at\)|(?<= )at(?= )|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:(?::(?=[0-9A-Fa-f]))?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CARD2 = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]?[0-9]){8,15}(?![0-9A-Za-z])")
_PHONE2 = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|00[0-9]{1,3}|0[0-9]{1,4}|[0-9]{3})(?: ?[./-] ?| )?[0-9]{2,4}(?:(?: ?[./-] ?| )?[0-9]{2,4}){1,4}(?![0-9A-Za-z])")
_PHONE3 = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4})??(?![0-9])")


def proposals(t: str) -> list[Span]:
    """High recall: spans of any kind that look like personal data."""
    out: list[Span] = []
    low = t.lower() if "dot" in t or "DOT" in t or "[at]" in t or "(at)" in t else ""
    if low:
        for w in re.finditer(r"\[at\]|\(at\)| at (?=[a-z0-9-]{1,63}(?: ?\[dot\]| ?\(dot\)| dot ))", low):
            lo = max(0, w.start() - 70)
            out += [("email", m.start(), m.end()) for m in _AT.finditer(t, lo, min(len(t), w.end() + 320)) if m.start() <= w.start() < m.end()]
    if _DIGIT.search(t):
        if ":" in t:
            out += [("ip", m.start(), m.end()) for m in _V6.finditer(t)]
        out += [("card", m.start(), m.end()) for m in _CARD2.finditer(t)]
        out += [("phone", m.start(), m.end()) for m in _PHONE2.finditer(t) if 7 <= len(_digits(m[0])) <= 15]
        if "+" in t:
            out += [("phone", m.start(), m.end()) for m in _PHONE3.finditer(t)]
    return list(dict.fromkeys(out))


#: Words that stand near personal data.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address"),
    "ip": ("ip", "ipv6", "host", "server", "address", "gateway", "dns", "ping"),
    "card": ("card", "visa", "amex", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "telefono", "handy", "ring", "dial"),
}
_OTHER = ("isbn", "order", "version", "invoice", "ticket", "page", "id", "sku", "date", "total", "ref", "build", "hash", "time")
_ZONES = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ch", "at", "pl", "br", "in", "jp")
_WORD = re.compile(r"[a-z0-9-]+")


def features(t: str, span: Span) -> list[float]:
    kind, lo, hi = span
    s, before, after = t[lo:hi], t[max(0, lo - 40) : lo].lower(), t[hi : hi + 12]
    d = _digits(s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    seps = [c for c in s if not c.isalnum()]
    near = _WORD.findall(before)[-4:]
    return [
        KINDS.index(kind), len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0, d[:2] == "00",
        len(set(seps)), len(seps), "(" in s and ")" in s, "." in s, "/" in s, "-" in s, " " in s, s.count(":"), "::" in s, luhn(d) if len(d) >= 13 else 0,
        int(d[0]) if d else -1, len(set(d)), sum(a == b for a, b in zip(d, d[1:])) / max(len(d), 1), d[:2] in ("19", "20"), d[:2] in ("34", "37", "30", "36", "38", "97"),
        sum(w.rstrip(".:") in CONTEXT[kind] for w in near), sum(w in _OTHER for w in near),
        before[-1:] in ("", " ", "\n", ":", "(", "<"), before[-1:] in ("$", "#", "=", "/", "."), after[:1] in ("", " ", "\n", ".", ",", ")", ">"), before[-1:].isdigit() or before[-2:-1].isdigit(), after[:1] in ("%", "/", "=", "-", ":"),
        s.lower().endswith(_ZONES), s.lower().count("dot"), "." in s.split(" ")[0], "[" in s or "(a" in s.lower(), sum(c.isalpha() for c in s),
    ]


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _with_luhn(d: str) -> str:
    return next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c))


def synthetic(n: int = TRAINING, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of proposals made by rule."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    true = {
        "email": lambda: f"{name()}{r.choice(['', _number(r, 2), '.' + name(), '_' + name()])}{r.choice(['[at]', ' [at] ', '(at)', ' (at) ', ' at '])}{name()}{r.choice(['.', ' dot ', ' [dot] ', '(dot)'])}{r.choice(_ZONES)}",
        "ip": lambda: ":".join(hexa(r.randint(3, 4)) for _ in range(8)) if r.random() < 0.5 else "::".join(":".join(hexa(r.randint(1, 4)) for _ in range(r.randint(1, 3))) for _ in range(2)),
        "card": lambda: r.choice([lambda: (lambda x: r.choice([x, f"{x[:4]} {x[4:10]} {x[10:]}", f"{x[:4]}-{x[4:10]}-{x[10:]}"]))(_with_luhn(r.choice(["34", "37"]) + _number(r, 13))), lambda: (lambda x, c: c.join(x[i : i + 4] for i in range(0, 16, 4)))(_with_luhn(r.choice("45") + _number(r, 15)), r.choice(["", "", " ", ".", "/", "_"]))])(),
        "phone": lambda: r.choice([lambda: f"+{r.randint(1, 99)} ({r.randint(200, 989)}) {r.randint(200, 999)}-{_number(r, 4)}", lambda: f"+{r.randint(1, 99)} {r.randint(20, 989)} {_number(r, 3)} {_number(r, 4)}", lambda: f"({r.randint(200, 989)}) {r.randint(200, 999)}-{_number(r, 4)}", lambda: f"{r.randint(200, 989)}-{r.randint(200, 999)}-{_number(r, 4)}", lambda: f"{r.randint(200, 989)}.{r.randint(200, 999)}.{_number(r, 4)}", lambda: f"00{r.randint(1, 99)} {r.randint(10, 999)} {_number(r, 3)} {_number(r, 4)}", lambda: f"0{r.randint(10, 999)} {_number(r, 4)} {_number(r, 3)}", lambda: f"0{r.randint(1, 9)} {_number(r, 2)} {_number(r, 2)} {_number(r, 2)} {_number(r, 2)}", lambda: (lambda c: f"{r.choice(['0', '00'])}{_number(r, r.randint(2, 3))}{r.choice([c, ' / ', ' '])}{c.join(_number(r, r.randint(2, 4)) for _ in range(r.randint(2, 3)))}")(r.choice(" -."))])(),
    }
    day = lambda: f"{r.randint(1990, 2030)}{(c := r.choice('-/.'))}{r.randint(1, 12):02}{c}{r.randint(1, 28):02}"
    false = [
        day, lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2030)}", lambda: f"{day()} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
        lambda: f"{_number(r, 3)} {_number(r, 3)} {_number(r, 3)}", lambda: f"0.{_number(r, r.randint(6, 14))}", lambda: f"{r.randint(1, 999)}.{_number(r, 4)}.{_number(r, 4)}", lambda: _number(r, r.randint(7, 19)), lambda: _number(r, 16), lambda: f"{r.randint(1, 9)}{_number(r, 3)}.{_number(r, 8)}",
        lambda: f"978-{r.randint(0, 9)}-{_number(r, 4)}-{_number(r, 4)}-{r.randint(0, 9)}", lambda: f"978{_number(r, 10)}", lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{hexa(2)}:{hexa(2)}:{hexa(2)}:{hexa(2)}:{hexa(2)}:{hexa(2)}",
        lambda: "-".join(_number(r, r.randint(2, 5)) for _ in range(r.randint(3, 4))), lambda: " ".join(_number(r, r.randint(2, 4)) for _ in range(r.randint(3, 5))), lambda: f"meet at {name()} dot {name()}", lambda: f"00{_number(r, 9)}", lambda: f"{_number(r, 4)} {_number(r, 4)} {_number(r, 4)}",
    ]
    filler = lambda: " ".join(name() for _ in range(r.randint(1, 5)))
    rows, labels = [], []
    while len(rows) < n:
        kind = r.choice(KINDS)
        good = r.random() < 0.4
        s = (true[kind] if good else r.choice(false))()
        # words that say what a number is stand before some of either sort, so that form counts too
        says = r.random()
        if good:
            lead = (r.choice(CONTEXT[kind]) if says < 0.4 else name()) + r.choice([": ", " ", " ", ", "])
        else:
            lead = (r.choice(_OTHER) if says < 0.4 else r.choice(CONTEXT[kind]) if says < 0.45 else name()) + r.choice([": ", " ", " ", " #", "=", " $"])
        if r.random() < 0.1:  # right after another number
            lead = (true["phone"] if kind == "card" else true["card"])() + " "
        head = f"{filler()} {lead}"
        t = f"{head}{s}{r.choice([' ', '. ', ', ', chr(10)])}{filler()}"
        for p in proposals(t):
            if p[1] < len(head) + len(s) and p[2] > len(head):
                rows.append(features(t, p))
                # national phone forms without a word that says so are told from other numbers by form alone
                labels.append(good and p[0] == kind and p[1] <= len(head) + 1 and p[2] >= len(head) + len(s) - 1)
    return np.array(rows[:n], float), np.array(labels[:n], float)


class Chooser:
    def __init__(self):
        x, y = synthetic()
        third = np.arange(len(y)) % 3 == 0
        self.model = Boosted(ROUNDS, DEPTH).fit(x[~third], y[~third]).calibrate(x[third], y[third])
        p, self.least = self.model.probability(x[third]), {}
        for i, kind in enumerate(KINDS):
            of = x[third][:, 0] == i
            q, z = p[of], y[third][of]
            order = np.argsort(-q, kind="stable")
            good = np.cumsum(z[order]) >= PRECISION * np.arange(1, len(order) + 1)
            at = np.flatnonzero(good)
            self.least[kind] = max(float(q[order][at[-1]]) if len(at) else 2.0, 0.7)

    def choose(self, t: str, base: list[Span]) -> list[Span]:
        """Spans added to the base spans."""
        found = [s for s in proposals(t) if not any(s[1] < hi and lo < s[2] for _, lo, hi in base)] if t else []
        if not found:
            return []
        p = self.model.probability(np.array([features(t, s) for s in found], float))
        out: list[Span] = []
        for q, s in sorted(zip(p.tolist(), found), key=lambda x: (-x[0], x[1][1], x[1])):
            if q >= self.least[s[0]] and not any(s[1] < hi and lo < s[2] for _, lo, hi in out):
                out.append(s)
        return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    bounded_batches(docs.sparkSession)
    chooser = Chooser()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, sha, spans = [], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                counts.append([sum(s[0] == k for s in base) for k in KINDS] if base else [0, 0, 0, 0])
                text = _joined(base)
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                more = chooser.choose(t or "", base)
                spans.append(_joined(base + more) if more else text)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(t: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, end = [], 0
    for k, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= end:
            out += [t[end:lo], f"[{k.upper()}]"]
        end = max(end, hi)
    return "".join([*out, t[end:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data in text replaced and n_chars of the new text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    chooser, arrow = Chooser(), to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            at = b.schema.get_field_index("text")
            texts = []
            for t in b.column(at).to_pylist():
                base = base_spans(t or "")
                spans = base + chooser.choose(t or "", base)
                texts.append(redact(t, spans) if spans else t)
            cols = list(b.columns)
            cols[at] = pa.array(texts, arrow.field("text").type)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
