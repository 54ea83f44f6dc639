"""PII: base patterns, and a semi-Markov conditional random field that adds the spans they miss."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from functools import cache, lru_cache, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Bounds of an entity: groups and digits of a number; labels of an address before and after its sign.
MOST_GROUPS, MOST_DIGITS, MOST_LOCAL, MOST_LABELS = 7, 24, 4, 6

# What the base patterns match, written so that no text makes them slow: an email is found from its @, and a run of
# digits is tried once, from its start.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind: leftmost, not overlapping, those that fail their test dropped."""
    found = []
    if "@" in text:
        at, free = text.find("@"), 0
        while at >= 0:
            start = at
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found.append(("email", start, m.end()))
                free = m.end()
            else:
                free = at + 1  # no address of a later @ can begin before this one
            at = text.find("@", free)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


# ---- the field ----

# Words that announce an entity or something else, ways to write a dot and an at sign, top-level names.
CUES = {
    "phone": {"tel", "phone", "call", "mobile", "fax", "telefon", "tél", "telephone", "teléfono", "cell"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "email": {"email", "mail", "contact", "write", "correo", "reach"},
}
OTHER_CUES = {"ref", "order", "invoice", "id", "no", "nr", "isbn", "issn", "version", "page", "case", "ticket", "serial", "sku", "part", "item", "code", "doi", "section", "total", "price"}
TOP_LEVEL = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu"}
ARTICLES = {"the", "a", "an", "this", "that", "my", "your", "our", "it", "home", "all", "least", "last", "first", "once", "der", "die", "das", "le", "la", "el", "los"}
DOT_WORDS, AT_WORDS = "dot|punto|point|punkt", "at|arroba"

DOT = rf"(?:\.|\s{{0,2}}[\[({{<]\s{{0,2}}(?:\.|{DOT_WORDS})\s{{0,2}}[\])}}>]\s{{0,2}}|\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}})"
LABEL = r"[A-Za-z0-9_%+-]+"
AT = re.compile(rf"\s{{0,2}}[\[({{<]\s{{0,2}}(?:{AT_WORDS}|@)\s{{0,2}}[\])}}>]\s{{0,2}}|\s{{1,2}}(?:{AT_WORDS})\s{{1,2}}(?={LABEL}{DOT}[A-Za-z]{{2}})|@", re.I)
DOMAIN_LABEL = re.compile(rf"({DOT})([A-Za-z0-9-]+)", re.I)
FIRST_LABEL = re.compile(r"[A-Za-z0-9-]+")
LAST_LABEL = re.compile(LABEL + r"\Z")
LAST_DOT = re.compile(rf"{DOT}\Z", re.I)
GROUPS = re.compile(rf"[0-9]+(?:(?:[^0-9A-Za-z\n]{{1,6}}|[^0-9A-Za-z\n]{{0,3}}(?:{DOT_WORDS})[^0-9A-Za-z\n]{{0,3}})[0-9]+)*", re.I)
GROUP = re.compile("[0-9]+")
WORDS = re.compile(r"[^\W\d_]+")
#: Characters before an entity in which cues are looked for.
CUE_REACH = 40


class Segment:
    """A candidate: its place, and what the features of the whole of it follow from."""

    __slots__ = ("end", "key", "start")

    def __init__(self, start: int, end: int, key: tuple):
        self.start, self.end, self.key = start, end, key

    @property
    def features(self) -> tuple[str, ...]:
        return number_features(*self.key) if len(self.key) == 10 else self.key


def _cues(text: str, start: int) -> tuple[str, ...]:
    before = text[max(0, start - CUE_REACH) : start]
    words = [w.lower() for w in WORDS.findall(before[before.rfind("\n") + 1 :])][-4:]
    named = [f"cue={k}" for k, cues in CUES.items() if cues.intersection(words)]
    if OTHER_CUES.intersection(words[-2:]):
        named.append("cue=other")
    return tuple(named) or ("no-cue",)


def _beside(c: str) -> str:
    return "edge" if not c else "letter" if c.isalpha() else "blank" if c.isspace() else c


def _mark(between: str) -> str:
    """How groups are joined: the marks without blanks, a dot word as such, a blank if there is nothing else."""
    return re.sub(DOT_WORDS, "dot", between.strip().lower()) or " "


def number_segments(text: str) -> list[Segment]:
    """Runs of digit groups, in every choice of first and last group, with the signs that can open them. Numbers of less
    than four digits are none."""
    out = []
    for m in GROUPS.finditer(text):
        spans = [g.span() for g in GROUP.finditer(text, *m.span())]
        if sum(b - a for a, b in spans) < 4:
            continue
        marks = [_mark(text[a[1] : b[0]]) for a, b in zip(spans, spans[1:], strict=False)]
        for i in range(len(spans)):
            digits = ""
            for j in range(i, min(len(spans), i + MOST_GROUPS)):
                digits += text[slice(*spans[j])]
                if len(digits) > MOST_DIGITS:
                    break
                if len(digits) >= 4:
                    out += _number(text, spans, marks, i, j, digits)
    return out


def _number(text: str, spans: list, marks: list[str], i: int, j: int, digits: str):
    lengths, end = tuple(b - a for a, b in spans[i : j + 1]), spans[j][1]
    octets = len(lengths) == 4 and max(lengths) <= 3 and all(int(text[a:b]) <= 255 for a, b in spans[i : j + 1])
    sums = luhn(digits) if 12 <= len(digits) <= 19 else None
    for opening in ("", "+", "(", "+(", "(+"):
        start = spans[i][0] - len(opening)
        if start < 0 or not text.startswith(opening, start):
            continue
        closed = text.count("(", start, end) == text.count(")", start, end)
        before = _beside(text[start - 1 : start] if start else "")
        after, more_after = _beside(text[end : end + 1]), j + 1 < len(spans) and marks[j]
        yield Segment(start, end, (lengths, tuple(marks[i:j]), octets, sums, opening, closed, before, not opening and i > 0 and marks[i - 1], (after, more_after), _cues(text, start)))


@lru_cache(1 << 14)
def number_features(lengths, marks, octets, sums, opening, closed, before, more_before, following, cues) -> tuple[str, ...]:
    digits, shape = sum(lengths), "-".join(map(str, lengths))
    signs = marks[0] if len(set(marks)) == 1 else "|".join(marks)[:24]
    after, more_after = following
    out = [
        f"digits={digits}", f"groups={len(lengths)}", f"shape={shape}", f"signs={signs}", f"shape={shape},signs={signs}", f"octets={octets}", f"alike={len(set(marks)) <= 1}", f"octets={octets},signs={signs}",
        f"luhn={sums}", f"digits={digits},luhn={sums}", f"more-after={more_after}", f"after={after}", f"opening={opening}", f"closed={closed}", f"before={before}", f"more-before={more_before}",
        f"in-word={before == 'letter' or after == 'letter'}", f"shape={shape},opening={opening}", f"octets={octets},more={bool(more_before)}{bool(more_after)}", *cues,
    ]
    return (*out, *(f"{c},{shape},{signs}" for c in cues), *(f"{c},octets={octets}" for c in cues), *(f"{c},luhn={sums}" for c in cues))


def address_segments(text: str) -> list[Segment]:
    """Around every sign that can stand for @: each choice of labels before and after it. A domain has two labels or more,
    the last of two letters or more."""
    out = []
    for at in AT.finditer(text):
        starts, begin, form = [], at.start(), "@" if at[0] == "@" else "bracket" if at[0].strip()[:1] in "[({<" else "word"
        while len(starts) < MOST_LOCAL and (label := LAST_LABEL.search(text, max(0, begin - 64), begin)):
            starts.append(label.start())
            if not (dot := LAST_DOT.search(text, max(0, label.start() - 16), label.start())):
                break
            begin = dot.start()
        first = FIRST_LABEL.match(text, at.end())
        if not starts or not first:
            continue
        ends, place, forms = [], first.end(), []
        while len(ends) + 1 < MOST_LABELS and (more := DOMAIN_LABEL.match(text, place)):
            place = more.end()
            forms.append("." if more[1] == "." else "bracket" if more[1].strip()[:1] in "[({<" else "word")
            ends.append((place, more[2].lower(), "|".join(sorted(set(forms))), more[1] != more[1].lstrip()))
        article = first[0].lower() in ARTICLES
        for n, start in enumerate(starts):
            cues = _cues(text, start)
            for k, (end, last, dots, _) in enumerate(ends):
                if len(last) < 2 or not last.isalpha():
                    continue
                more_after = ends[k + 1][2] if k + 1 < len(ends) else "no"
                features = [
                    f"at={form}", f"dots={dots}", f"at={form},dots={dots}", f"article={article}", f"article={article},at={form}", f"labels={k + 2}", f"top={last in TOP_LEVEL}", f"last={min(len(last), 7)}", f"locals={n + 1}", f"more-locals={n + 1 < len(starts)}",
                    f"more-labels={more_after}", f"top={last in TOP_LEVEL},more-labels={more_after}", f"before={_beside(text[start - 1 : start] if start else '')}", f"after={_beside(text[end : end + 1])}",
                    *cues, *(f"{c},at={form},dots={dots}" for c in cues),
                ]
                out.append(Segment(start, end, tuple(features)))
    return out


def segments(text: str) -> list[Segment]:
    """All candidates of a whole text, in the order of their ends."""
    found = number_segments(text) if DIGIT.search(text) else []
    if "@" in text or AT.search(text):
        found += address_segments(text)
    return sorted(found, key=lambda s: (s.end, s.start))


class Field:
    """Weights of (kind, feature); what is outside entities scores 0, character by character."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}
        self.bias = dict.fromkeys(KINDS, 0.0)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def top(self, s: Segment) -> tuple[float, str]:
        """The best kind's score; remembered by what the features follow from, once the weights are settled."""
        known = self.__dict__.setdefault("_known", {})
        if s.key not in known:
            if len(known) >= 1 << 16:
                known.clear()
            features = s.features
            known[s.key] = max((self.score(kind, features), kind) for kind in KINDS)
        return known[s.key]

    def score(self, kind: str, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return self.bias[kind] + sum(get((kind, f), 0.0) for f in features)

    def best(self, found: list[Segment]) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end) of the highest total: boundaries and kinds chosen together. Only places where a
        candidate ends can raise the total; candidates that score no more than 0 are never on the best path."""
        ends, totals, back = [0], [0.0], [None]
        for s in found:
            score, kind = self.top(s)
            if score <= 0:
                continue
            at = bisect_right(ends, s.start) - 1
            total = totals[at] + score
            if total > totals[-1]:
                if ends[-1] == s.end:
                    totals[-1], back[-1] = total, (kind, s, at)
                else:
                    ends.append(s.end)
                    totals.append(total)
                    back.append((kind, s, at))
        out, at = [], len(ends) - 1
        while at > 0:
            kind, s, before = back[at]
            out.append((kind, s.start, s.end))
            at = before
        return out[::-1]

    def expected(self, found: list[Segment]) -> tuple[float, list[tuple[str, int, float]]]:
        """log of the sum over all segmentations, and each candidate's probability by kind, by forward and backward sums."""
        places = sorted({0} | {s.start for s in found} | {s.end for s in found})
        number = {p: i for i, p in enumerate(places)}
        items = [(self.score(kind, s.features), number[s.start], number[s.end], kind, k) for k, s in enumerate(found) for kind in KINDS]
        ends, starts = {}, {}
        for item in items:
            ends.setdefault(item[2], []).append(item)
            starts.setdefault(item[1], []).append(item)

        def log_sum(values: list[float]) -> float:
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        forward, backward = [0.0] * len(places), [0.0] * len(places)
        for j in range(1, len(places)):
            forward[j] = log_sum([forward[j - 1], *(forward[i] + s for s, i, _, _, _ in ends.get(j, ()))])
        for i in range(len(places) - 2, -1, -1):
            backward[i] = log_sum([backward[i + 1], *(backward[j] + s for s, _, j, _, _ in starts.get(i, ()))])
        whole = forward[-1]
        return whole, [(kind, k, math.exp(forward[i] + s + backward[j] - whole)) for s, i, j, kind, k in items]


def training_texts(count: int = 1300, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up lines with labelled entities, written as the base patterns have them and in other ways, and lines that only
    look like them."""
    rng = random.Random(seed)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))

    def card(good=True):
        while True:
            d = rng.choice("3456") + digits(15)
            if luhn(d) == good:
                return d

    def name():
        return rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}", f"{word()}.{word()}{digits(2)}"])

    def top():
        return rng.choice(sorted(TOP_LEVEL)) if rng.random() < 0.6 else "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.choice([2, 2, 2, 3, 4])))

    def email():
        a, d = rng.choice([
            ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("[at]", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[@]", "."), (" (at) ", "."), ("{at}", "{dot}"), (" AT ", " DOT "), ("@", "."), ("@", "."),
            ("@", "[.]"), (" arroba ", " punto "), ("<at>", "<dot>"),
        ])
        domain = [word()] + ([word()] if rng.random() < 0.25 else []) + [top()]
        return name() + a + d.join(domain)

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"+1-{a}-{b}-{c}", f"+{digits(11)}"])

    def announced_phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"0{digits(3)} {digits(6)}", f"0{digits(2)}/{digits(7)}", f"{b}-{c}"])

    def ip():
        parts = [str(rng.choice([rng.randrange(256), rng.randrange(10)])) for _ in range(4)]
        return rng.choice(["[.]", "(.)", " . ", "[dot]", " dot ", "{.}", "."]).join(parts)

    def split_card():
        d, sep = card(), rng.choice(["", " ", "-", ".", "/", "  ", "_", " - "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def cue(kind):
        return rng.choice(sorted(CUES[kind])) + rng.choice([": ", " ", " is ", " = ", " to "])

    makers = {"email": email, "phone": phone, "ip": ip, "card": split_card}

    def other():
        return rng.choice(sorted(OTHER_CUES)) + rng.choice([" ", ": ", " #", " "])

    def lookalike():
        d, year = card(False), f"{rng.choice(['19', '20'])}{digits(2)}"
        a, b, c = digits(3), digits(3), digits(4)
        plain = rng.choice([
            d, "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4)), digits(rng.randrange(4, 24)), f"{a}.{b}.{c}", f"{a} {b} {c}",
            f"{year}-{digits(2)}-{digits(2)}", f"{year}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", f"{digits(2)}/{digits(2)}/{year}", f"{word()} at {word()}", f"{word()} at {rng.choice(sorted(ARTICLES))} dot {rng.choice([word(), top()])}",
            f"{digits(2)}:{digits(2)}:{digits(2)}.{digits(3)}", ".".join(str(rng.randrange(256, 999)) for _ in range(4)), f"{a},{b},{digits(3)}", f"{a}.{b}.{digits(3)},{digits(2)}", f"{year}, {year}", f"{year}-{year}",
            f"{a} {b} {a} {b} {a}", f"{digits(1)}.{digits(2)}.{c}", f"meet at {word()}.{top()}", f"look at {word()}.{word()}", f"{digits(5)} {digits(5)}", " ".join(digits(2) for _ in range(5)), f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"({year})", f"({digits(2)}) {c}", f"{b}-{c}", f"${digits(1)},{a}.{digits(2)}", f"{digits(4)}.{digits(2)}", f"@{word()}", f"{word()}[{digits(4)}]",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), f'token = "{"".join(rng.choice("0123456789012345abcdef") for _ in range(32))}"', f"{word()}{digits(rng.randrange(4, 17))}{rng.choice(['', word()])}",
        ])
        marked = rng.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"978-{digits(1)}-{c}-{c}-{digits(1)}", f"{a}{b}{c}", f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(1)}", d, f"{b}-{c}", f"({a}) {b}", f"{digits(6)}-{digits(3)}"])
        return other() + marked + rng.choice(["", f" {word()}", " id"]) if rng.random() < 0.4 else plain

    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randrange(0, 4))), []
        text += " " if text else ""
        for _ in range(rng.choice([1, 2, 3])):
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                announced = rng.random() < 0.6
                text += cue(kind) if announced else ""
                entity = announced_phone() if announced and kind == "phone" and rng.random() < 0.5 else makers[kind]()
                spans.append((kind, len(text), len(text) + len(entity)))
                text += entity
            else:
                text += lookalike()
            # now and then the next one follows at once
            text += rng.choice([" ", ", ", ". ", "; "]) + "".join(word() + " " for _ in range(rng.choice([0, 1, 2, 3, 4])))
        out.append((text, spans))
    return out


@cache
def trained_field(rounds: int = 6, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Weights of highest likelihood on training_texts, by adaptive gradient steps; alike on every run."""
    field, sums = Field(), {}
    lines = []
    for text, spans in training_texts():
        found = segments(text)
        at = {(s.start, s.end): k for k, s in enumerate(found)}
        lines.append((found, {(kind, at[a, b]) for kind, a, b in spans if (a, b) in at}))
    order = random.Random(5)
    for _ in range(rounds):
        order.shuffle(lines)
        for found, true in lines:
            if not found:
                continue
            step: dict = {}
            for kind, k, p in field.expected(found)[1]:
                d = ((kind, k) in true) - p
                if abs(d) > 1e-3:
                    for f in (None, *found[k].features):
                        step[kind, f] = step.get((kind, f), 0.0) + d
            for key, d in step.items():
                kind, f = key
                now = field.bias[kind] if f is None else field.weights.get(key, 0.0)
                d -= decay * now
                sums[key] = sums.get(key, 0.0) + d * d
                now += rate * d / math.sqrt(sums[key] + 1e-8)
                if f is None:
                    field.bias[kind] = now
                else:
                    field.weights[key] = now
    return field


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Entities that the field finds in the whole text, away from all base spans."""
    found = segments(text)
    if base and found:
        taken = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        free = lambda s: (k := bisect_left(starts, s.end)) == 0 or reach[k - 1] <= s.start
        found = [s for s in found if free(s)]
    return field.best(found)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


COLUMNS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def _found(batches, field: Field):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base, field)
            counts = [sum(kind == k for kind, _, _ in base) for k in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_added.

    spans (kind:start:end in code points, end exclusive, by start) has all base matches and what the field adds:
    entities written in other ways, none of which overlaps a base match. A null text is empty and has no spans.
    Rows are handled one by one, so repeated rows and null ids are like any others; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_found, field=field or trained_field()), COLUMNS)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
