"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The base patterns give e-mail addresses, IP addresses, card and phone numbers; their spans always
stay. The field then looks at the text around triggers (digits, assigned values, words for secrets, spelled-out
addresses) outside the base spans and adds spans of the kinds ``account``, ``contact``, ``secret``
and ``tel``. Its edges are whole candidate spans of at most ``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters, scored
by features of the whole span and its surroundings; all other tokens are single, unscored steps. One dynamic
program over a window chooses boundaries and kinds jointly. The weights maximise the conditional
likelihood of generated sentences with known spans, by gradient steps on forward-backward
expectations; they are fitted here, once for each process, and no document is looked at for it.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import long_texts

#: The kinds of the base patterns, in order.
BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("account", "contact", "secret", "tel")
KINDS = BASE_KINDS + FIELD_KINDS
MOST_TOKENS = 12
#: The longest candidate; windows grow by more, so that none is cut.
MOST_CHARS = 512
_MARGIN = 48
_GROWTH = 8 * MOST_CHARS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each ``@``: the address runs left as far as its characters go."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        block = 64
        while start > low:
            left = max(low, start - block)
            piece = text[left:start]
            m = _tail(piece)
            start -= m
            if m < len(piece):
                break
            block *= 2
        if start < at and (m2 := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m2.end()))
            low = m2.end()
            at = text.find("@", low)
        else:
            low = max(low, at + 1)
            at = text.find("@", at + 1)
    return found


_ADDRESS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _tail(piece: str) -> int:
    """How many characters at the end of the piece may stand in an address."""
    n = 0
    for c in reversed(piece):
        if c not in _ADDRESS:
            break
        n += 1
    return n


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and apart within each kind; failing matches drop out."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


#: Where a window opens: digits, an assigned value, a spelled-out address; and a value after a word for a secret.
_TRIGGER = re.compile(r"[0-9]{4}|[0-9]{3}[-. )]|[:=] ?[\"']?(?=[A-Za-z0-9_+/=-]{12})|[\[( ]dot[\]) ]|[\[(]at[\])]")
_SECRET_WORDS = ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential")
_AFTER_WORD = re.compile(rf"(?:{'|'.join(_SECRET_WORDS)})[a-z]{{0,12}}[\"']?[ :=]{{1,3}}[\"']?(?=[a-z0-9_+/=-]{{12}})")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SHAPE = {
    "account": re.compile(r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{9,20}|[0-9]{3,6}(?:[ -][0-9]{2,7}){2,5})"),
    "contact": re.compile(r"\w+(?:(?: dot | ?[\[(]dot[\])] ?|[._])\w+)*(?: at | ?[\[(]at[\])] ?)\w+(?:(?: dot | ?[\[(]dot[\])] ?)\w+)+"),
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{12,}"),
    "tel": re.compile(r"\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2})?"),
}
_KEYWORD = {
    "account": re.compile(r"(?i)(?:account|acct|iban|card|konto|cuenta|compte|no\.?|number|#)\W{0,3}$"),
    "contact": re.compile(r"(?i)(?:mail|e-mail|contact|write to|reach)\W{0,3}$"),
    "secret": re.compile(r"(?i)(?:token|secret|passw\w*|pwd|key|auth\w*|bearer|credential)s?[\"']?\s?[:=]?\s?[\"']?$"),
    "tel": re.compile(r"(?i)(?:tel|phone|call|fax|mobile|ring)\W{0,3}$"),
}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
_GROUPED = re.compile(r"[0-9]{1,3}(?:[.,][0-9]{3})+")
_PER_KIND = 24


def span_features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Places of the features of one whole candidate span that hold, for its kind."""
    body, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    digits = sum(c.isdigit() for c in body)
    letters = sum(c.isalpha() for c in body)
    prev, nxt = before[-1:], after[:1]
    got = [0]
    tests = (
        bool(_KEYWORD[kind].search(before)),
        prev.isalnum() or (prev in "-.,/_+" and before[-2:-1].isalnum()),
        nxt.isalnum() or (nxt != "" and nxt in "-/_%" and after[1:2].isalnum()),
        prev in "\"'" and nxt in "\"'" and prev != "",
        prev.isspace() or prev == "",
        nxt.isspace() or nxt == "",
        digits < 7,
        7 <= digits <= 11,
        12 <= digits <= 13,
        digits >= 14,
        digits > 0 and letters > 0,
        letters == 0,
        len(body) >= 20,
        len(body) >= 32,
        all(c in "0123456789abcdef" for c in body),
        bool(_DATE.search(body)),
        " " in body,
        "(" in body,
        bool(re.match(r"[A-Z]{2}[0-9]{2}", body)),
        digits == 0 and (body.islower() or body.istitle()),
        any(c.isupper() for c in body[1:]) and any(c.islower() for c in body),
        digits == 0 and prev not in "\"'",
        bool(_GROUPED.fullmatch(body)),
    )
    base = FIELD_KINDS.index(kind) * _PER_KIND
    got += [k + 1 for k, t in enumerate(tests) if t]
    return [base + k for k in got]


def lattice(text: str, taken: list[Span] = ()) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[int]]]]:
    """Tokens of a window, and its candidate edges: first token, token after the last, kind, features."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    free = [not any(a < e and s < b for _, a, b in taken) for s, e in tokens]
    edges = []
    for i, (s, _) in enumerate(tokens):
        if not free[i]:
            continue
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            if not free[j]:
                break
            e = tokens[j][1]
            if e - s > MOST_CHARS:
                break
            for kind in FIELD_KINDS:
                if _SHAPE[kind].fullmatch(text, s, e):
                    edges.append((i, j + 1, kind, span_features(kind, text, s, e)))
    return tokens, edges


WIDTH = _PER_KIND * len(FIELD_KINDS)


def best_path(n: int, edges: list, scores: np.ndarray) -> list[int]:
    """Edges on the best way through a lattice of n tokens; tokens alone score 0."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _, _) in enumerate(edges):
        into[j].append(k)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in into[j]:
            value = best[edges[k][0]] + scores[k]
            if value > best[j]:
                best[j], back[j] = value, k
    path, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            path.append(back[j])
            j = edges[back[j]][0]
    return path[::-1]


def _expected(n: int, edges: list, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition and the probability of each edge, forward and backward."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    out: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _, _) in enumerate(edges):
        into[j].append(k)
        out[i].append(k)
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[j - 1], *(a[edges[k][0]] + scores[k] for k in into[j])])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[i + 1], *(b[edges[k][1]] + scores[k] for k in out[i])])
    return a[n], np.array([np.exp(a[i] + s + b[j] - a[n]) for (i, j, _, _), s in zip(edges, scores, strict=True)])


def _examples(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated sentences with known spans, and such as only look like it."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "ou", "ci", "en", "ver", "la"]) for _ in range(rnd.randint(1, 4)))
    some = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))

    def entity() -> tuple[str, str, str, str]:
        kind = rnd.choice(FIELD_KINDS)
        if kind == "account":
            body = rnd.choice([
                digits(rnd.choice([12, 14, 15, 16, 16, 16, 18])), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)),
                some("DEFRGBS", 2) + digits(2) + " " + " ".join(digits(4) for _ in range(4)),
            ])
            return kind, rnd.choice(["", "", "", "account ", "IBAN: ", "no. ", "| "]), body, ""
        if kind == "contact":
            dot = rnd.choice([" dot ", " dot ", "[dot]", " (dot) "])
            at = rnd.choice([" at ", "[at]", " (at) "])
            return kind, rnd.choice(["", "mail ", "contact: "]), word() + rnd.choice(["", "." + word()]) + at + word() + dot + rnd.choice(["com", "org", "net"]), ""
        if kind == "secret":
            body = rnd.choice([some("0123456789abcdef", 40), some("0123456789abcdef", 32), some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop0123456789", rnd.randint(16, 44))])
            quote = rnd.choice(['"', '"', "'", ""])
            return kind, rnd.choice(["token = ", "api_key: ", "password=", "secret = ", "bearer "]) + quote, body, quote
        a, b, c = digits(3), digits(3), digits(4)
        return kind, rnd.choice(["", "call ", "tel. "]), rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}"]), ""

    def decoy() -> str:
        return rnd.choice([
            str(rnd.randint(1900, 2030)), f"{rnd.randint(1, 999)},{digits(3)}", f"{rnd.randint(2000, 2030)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}",
            f"{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}", digits(4), digits(5), digits(6), f'{word()} = "{word()}"', f"{rnd.randint(10, 23)}:{digits(2)}:{digits(2)}",
            word() + " dot " + word(), f'{word()} = "{word()}{word()}{word()}{word()}"', f"{word()}: {word()}{word()}{word()}{word()}", f"the key {word()}{word()}{word()}{word()}", f"{digits(3)}-{digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"ISBN {digits(1)}-{digits(3)}",
        ])

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rnd.randint(1, 3)):
            text += " ".join(word() for _ in range(rnd.randint(1, 5))) + rnd.choice([" ", " ", ", ", ". "])
            if rnd.random() < 0.55:
                kind, lead, body, tail = entity()
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += lead + body + tail
            else:
                text += decoy()
            text += rnd.choice([" ", " ", ". ", " | ", ", "])
        out.append((text + word(), spans))
    return out


@functools.lru_cache(maxsize=2)
def fit(count: int = 260, epochs: int = 40, seed: int = 7, l2: float = 0.02) -> tuple[float, ...]:
    """Weights of the field, by adaptive gradient steps on the conditional likelihood."""
    rows = []
    for text, spans in _examples(count, seed):
        tokens, edges = lattice(text)
        gold = {(k, s, e) for k, s, e in spans}
        x = np.zeros((len(edges), WIDTH))
        for r, (_, _, _, features) in enumerate(edges):
            x[r, features] = 1
        y = np.array([float((k, tokens[i][0], tokens[j - 1][1]) in gold) for i, j, k, _ in edges])
        if len(edges):
            rows.append((len(tokens), edges, x, y))
    w, square = np.zeros(WIDTH), np.full(WIDTH, 1e-6)
    for _ in range(epochs):
        gradient = -l2 * w * len(rows) / 10
        for n, edges, x, y in rows:
            _, p = _expected(n, edges, x @ w)
            gradient = gradient + x.T @ (y - p)
        square += gradient**2
        w = w + 0.7 * gradient / np.sqrt(square)
    return tuple(w)


def field_spans(text: str, taken: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans that the field adds: windows around all triggers, each decoded as a whole."""
    places = [m.span() for m in _TRIGGER.finditer(text)]
    low = text.lower()
    low = low if len(low) == len(text) else text  # some letters grow, and places would shift
    if any(w in low for w in _SECRET_WORDS):
        places = sorted(places + [m.span() for m in _AFTER_WORD.finditer(low)])
    windows: list[list[int]] = []
    for s, e in places:
        s, e = max(0, s - _MARGIN), min(len(text), e + _MARGIN)
        if windows and s <= windows[-1][1]:
            windows[-1][1] = max(e, windows[-1][1])
        else:
            windows.append([s, e])
    out, t = [], 0
    for s, e in windows:
        first, high = max(0, s - _GROWTH), min(len(text), e + _GROWTH)
        while s > first and not text[s - 1].isspace():
            s -= 1
        while e < high and not text[e].isspace():
            e += 1
        while t < len(taken) and taken[t][2] <= s:
            t += 1
        near = [(k, a - s, b - s) for k, a, b in taken[max(0, t - 4) :] if a < e and b > s] if t < len(taken) else []
        piece = text[s:e]
        tokens, edges = lattice(piece, near)
        if edges:
            scores = np.array([sum(weights[f] for f in features) for _, _, _, features in edges])
            for k in best_path(len(tokens), edges, scores):
                i, j, kind, _ = edges[k]
                span = (kind, s + tokens[i][0], s + tokens[j - 1][1])
                if not out or span[1] >= out[-1][2]:
                    out.append(span)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def finder(weights: tuple[float, ...]):
    """For mapInArrow over doc_id and text."""
    w = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                every = sorted(base + field_spans(text, base, w), key=_order)
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), bool(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "is_personal"],
            )

    return run


def find_personal_data(documents: DataFrame) -> DataFrame:
    """For every document: counts of base spans, their SHA-256, all spans and whether there are any.

    Null and empty texts have none; rows that repeat an id or a text each have their own. An empty table gives an
    empty result. Other columns take no part.
    """
    long_texts(documents.sparkSession)
    source = documents.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return source.mapInArrow(finder(fit()), f"doc_id {kind}, {counts}, base_sha256 string, spans string, is_personal boolean")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=_order):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])
