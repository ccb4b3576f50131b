"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans come from four fixed patterns. The field then scores whole candidate segments
around what they left: features of the complete span and its two neighbours, one weight
for each feature and kind. Dynamic programming over segments of bounded length picks
boundaries and kinds of all added spans together; tokens outside score nothing.

The field is trained here, without hand-made labels: on windows around base spans, on the
same windows with the span rewritten (spelt-out at and dot, other separators, no plus),
and on windows with digits that are no personal data, which must stay outside.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import deque
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Tokens in a span at most.
MAX_TOKENS = 26
#: Digits in a span without an `at` at most: those of the longest card number.
MAX_DIGITS = 19
#: Windows the field is trained on: at most so many documents for each
#: of the STARTS give theirs.
TRAIN_DOCUMENTS = 50
STARTS = (r"[A-Za-z0-9]@[A-Za-z0-9]", r"\+[0-9]", r"[0-9]{13,}", r"(?:[0-9]{1,3}\.){3}[0-9]")
EPOCHS = 30
#: An added span must beat staying outside by this much.
MIN_SCORE = 0.5

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1]]
    return (sum(odd[0::2]) + sum(2 * d - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def _emails(text: str):
    """Matches of `[A-Za-z0-9._%+-]+@...`, found from each @ outwards in linear time."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _not_digit.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= len(_not_digit.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_token = re.compile(r"[0-9]+|[^\W\d_]+|\n|[^\S\n]+|.", re.S)
#: What starts a window: an @; `at` in brackets; `at` as a word and soon after it a dot, as
#: a mark in a name, as a word or in brackets; seven digits with at most three other
#: characters between neighbours; or four short groups of digits with a dot between each two.
_number = re.compile(r"[0-9](?:[^0-9\n]{0,3}[0-9]){6,60}")
_groups = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[^0-9\n.]?\.[^0-9\n.]?[0-9]{1,3}){3}(?![0-9])")
_bracketed = re.compile(r"[(\[{] ?[aA][tT] ?[)\]}]")
_words = re.compile(r"(?<=\w) [aA][tT] (?=([^\n]{1,60}?(?:\.\w|[(\[{ ][dD][oO][tT][)\]} ])))")


def _starts(text: str) -> list[tuple[int, int]]:
    out = [m.span() for m in _number.finditer(text)] + [m.span() for m in _groups.finditer(text)]
    if "@" in text:
        out += [m.span() for m in re.finditer("@", text)]
    if any(c in text for c in "([{"):
        out += [m.span() for m in _bracketed.finditer(text)]
    if any(x in text for x in (" at ", " At ", " AT ", " aT ")):
        out += [(m.start(), m.end(1)) for m in _words.finditer(text)]
    return sorted(out)


def windows(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of text around starts that no taken span covers, as long as starts follow
    one another, so no span is cut; they don't overlap."""
    out: list[list[int]] = []
    taken = sorted(taken)
    k = 0
    for a, b in _starts(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] <= a and taken[k][1] >= b:
            continue
        a, b = max(0, a - 40), min(len(text), b + 40)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _side(c: str) -> str:
    return "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "symbol" if c in "_=/\\+-@#%." else "mark"


_spelt_at = re.compile(r"[(\[{ ]at[)\]} ]", re.I)
_spelt_dot = re.compile(r"[(\[{ ]dot[)\]} ]", re.I)
_address = re.compile(r"[\w.%+-]+(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[\w.%+-]+)*(?:@|\s?[(\[{]?\s?\bat\b\s?[)\]}]?\s?)[\w-]+(?:(?:\.|\s?[(\[{]?\s?\bdot\b\s?[)\]}]?\s?)[\w-]+)+", re.I)


def features(text: str, a: int, b: int) -> list[str]:
    """Whole-span features of text[a:b] and its neighbours."""
    span = text[a:b]
    digits = _not_digit.sub("", span)
    n, groups = len(digits), len(re.findall(r"[0-9]+", span))
    letters = sum(c.isalpha() for c in span)
    out = [f"before:{_side(text[a - 1 : a])}", f"after:{_side(text[b : b + 1])}", f"first:{_side(span[0])}", f"last:{_side(span[-1])}"]
    ats = span.count("@") + len(_spelt_at.findall(span))
    if ats:  # how many dots and digits a name has says nothing
        out.append(f"ats:{min(ats, 2)}")
        if ats == 1 and _address.fullmatch(span):
            spelt = " " in span and not _spelt_dot.search(span) and not re.search(r"[(\[{]", span)
            out.append("loose address" if spelt else "address")
        return out
    out.append("digits:" + ("0" if not n else "1-6" if n < 7 else "7-9" if n < 10 else "10-11" if n < 12 else "12-15" if n < 16 else "16-19" if n < 20 else "20+"))
    out.append(f"groups:{min(groups, 6)}")
    out.append("letters:" + ("0" if not letters else "few" if letters < 4 else "many"))
    if n >= 12:
        out.append("luhn" if luhn(digits) else "no luhn")
    out.append(f"dots:{min(span.count('.'), 4)}")
    if n and not letters:
        others = set(span) - set("0123456789")
        out.append("separators:" + ("none" if not others else "one" if len(others) == 1 else "several"))
        parts = re.split(r"[^0-9]+", span)
        if len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append("four parts")
        if re.fullmatch(r"(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:(?: - |[ .-])?[0-9]{2,4}){2,4}", span):
            out.append("phone shape")
        if n >= 10 and span.startswith("00"):
            out.append("opens:00")
        if span[0] in "+(":
            out.append("opens:" + span[0])
        if "\n" in span:
            out.append("line break")
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Stretches that spans cover, in order and apart; touching ones become one."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def candidates(text: str, start: int, end: int, taken=()):
    """For each token of text[start:end], in order: where it begins and ends, and its candidate
    segments as (tokens, end). At most MAX_TOKENS tokens are held at a time.

    A segment has seven digits, an `at` or four groups of digits with dots; without an
    `at` it has at most MAX_DIGITS digits. It reaches into no taken stretch.
    """
    source = _token.finditer(text, start, end)
    ahead: deque = deque()  # (begin, end, sums up to the token's end)
    before = last = (0, 0, 0, 0, 0)
    at = 0
    while True:
        for m in islice(source, MAX_TOKENS - len(ahead)):
            x, y = m.span()
            c = text[x]
            digit = c.isdigit()
            last = (
                last[0] + (y - x if digit else 0), last[1] + (c == "@" or text[x:y].lower() == "at"), last[2] + digit, last[3] + (c == "."), last[4] + c.isalpha()
            )
            ahead.append((x, y, last))
        if not ahead:
            return
        a, stop_at, own = ahead[0]
        found = []
        if text[a].isalnum() or text[a] in "+(":
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            stop = taken[at][0] if at < len(taken) else math.inf
            d0, d1, d2, d3, d4 = before
            # Most places of a text have no segment at all.
            some = last[1] > d1 or last[0] - d0 >= 7 or last[2] - d2 >= 4
            for n, (_, b, sums) in enumerate(ahead if some else (), 1):
                if stop < b:
                    break
                if sums[1] == d1:
                    digits = sums[0] - d0
                    if digits > MAX_DIGITS:
                        continue
                    if digits < 7 and (sums[2] - d2 != 4 or sums[3] - d3 != 3 or sums[4] != d4):
                        continue
                if not text[b - 1].isalnum():
                    continue
                found.append((n, b))
        yield a, stop_at, found
        before = own
        ahead.popleft()


class Candidates:
    """The tokens of a short window, its candidate segments and their features as numbers."""

    def __init__(self, text: str, start: int, end: int, names: dict[str, int], grow: bool, taken=()):
        self.tokens: list[tuple[int, int]] = []
        self.segments: list[tuple[int, int]] = []
        self.rows: list[list[int]] = []
        for i, (a, stop, found) in enumerate(candidates(text, start, end, merged(taken))):
            self.tokens.append((a, stop))
            for n, b in found:
                self.segments.append((i, i + n))
                own = features(text, a, b)
                self.rows.append([names.setdefault(f, len(names)) for f in own] if grow else [names[f] for f in own if f in names])

    def matrix(self, n: int) -> np.ndarray:
        out = np.zeros((len(self.rows), n))
        for i, r in enumerate(self.rows):
            out[i, r] = 1
        return out


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights by feature and kind."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def best(self, text: str, start: int, end: int, taken=()) -> list[tuple[str, int, int]]:
        """The best choice of added spans in a window of any length. taken: stretches in order
        and apart.

        Tokens pass one after another: of the segments only the best into each of the next
        MAX_TOKENS ends is held. Where no held segment can be chosen any more, the spans so far
        are settled and nothing before is kept.
        """
        out: list[tuple[str, int, int]] = []
        opened: dict[int, tuple] = {}  # token end -> (total, token start, span)
        picks: dict[int, tuple] = {}  # token end -> (token start, span) where a segment is best
        total = 0.0
        for i, (a, _, found) in enumerate(candidates(text, start, end, taken)):
            total = self._close(i, total, opened, picks)
            if not opened and picks:
                out += _chain(picks, i)
                picks.clear()
            for n, b in found:
                own = [self.names[f] for f in features(text, a, b) if f in self.names]
                scores = self.weights[own].sum(0) + self.weights[-1] - MIN_SCORE
                kind = int(scores.argmax())
                value = total + float(scores[kind])
                if scores[kind] > 0 and (i + n not in opened or value > opened[i + n][0]):
                    opened[i + n] = value, i, (KINDS[kind], a, b)
        for j in sorted(opened):
            total = self._close(j, total, opened, picks)
        return out + (_chain(picks, max(picks)) if picks else [])

    @staticmethod
    def _close(j: int, total: float, opened: dict[int, tuple], picks: dict[int, tuple]) -> float:
        """The best total of the tokens before j, once all segments that end there are known."""
        found = opened.pop(j, None)
        if found and found[0] > total:
            picks[j] = found[1:]
            return found[0]
        return total


def _chain(picks: dict[int, tuple], j: int) -> list[tuple[str, int, int]]:
    """The chosen spans up to token end j, in order."""
    out = []
    for k in sorted(picks, reverse=True):
        if k <= j:
            j, span = picks[k]
            out.append(span)
    return out[::-1]


def _rewritten(kind: str, span: str) -> list[str]:
    """Other ways to write a base span."""
    if kind == "email":
        name, _, host = span.partition("@")
        ways = [(" at ", " dot "), ("(at)", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("[at]", "[dot]")]
        return [name.replace(".", dot) + at + host.replace(".", dot) for at, dot in ways[3:]] + [name + at + host.replace(".", dot) for at, dot in ways]
    digits = _not_digit.sub("", span)
    if kind == "phone":
        area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        return ["-".join((area, first, last)), ".".join((area, first, last)), f"({area}) {first}-{last}", f"({area}) {first} {last}", " - ".join((area, first, last)), "00" + digits]
    if kind == "card":
        return [by.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for by in ("-", " ", ".", " - ")]
    return [span.replace(".", by) for by in ("[.]", " . ")]


def examples(texts: list[str]) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """Training windows (text, start, end, spans) of texts."""
    out = []
    for turn, text in enumerate(texts):
        spans = base_spans(text)
        for kind, a, b in spans[:8]:
            # A window with other spans at hand would teach that they are none.
            if sum(x < b + 60 and a - 60 < y for _, x, y in spans) == 1:
                left, right = text[max(0, a - 40) : a], text[b : b + 40]
                for span in [text[a:b], *_rewritten(kind, text[a:b])]:
                    whole = left + span + right
                    out.append((whole, 0, len(whole), [(kind, len(left), len(left) + len(span))]))
        for a, b in windows(text, [(x, y) for _, x, y in spans])[:8]:
            if not any(x < b and a < y for _, x, y in spans):
                out.append((text[a:b], 0, b - a, []))
        # Digits that are no personal data: numbers in a series, years, codes.
        words = [w for w in text[:400].split() if w.isalpha()][:6]
        if len(words) == 6:
            for number in (f"{turn % 97}, {turn % 89}, {1900 + turn % 120}, {turn % 61}", f"{2000 + turn % 25}-0{1 + turn % 9}-1{turn % 9} 1{turn % 9}:2{turn % 7}:3{turn % 5}", f"x{turn:07d}a{turn * 7919 % 10**9}", f"{turn * 104729 % 10**9}.{turn * 7919 % 10**6}", f"{turn * 15485863 % 10**13}"):
                whole = " ".join(words[:3]) + f" {number} " + " ".join(words[3:])
                out.append((whole, 0, len(whole), []))
            whole = f"{words[0]} {words[1]} at {words[2]} {words[3]}. {words[4]} {words[5]}"
            out.append((whole, 0, len(whole), []))
    return out


def fit(texts: list[str], epochs: int = EPOCHS) -> Field:
    """Weights that make the examples likely: conditional likelihood of segmentations, by
    forward and backward sums over segments and adaptive gradient steps."""
    names: dict[str, int] = {}
    cases = []
    for text, a, b, spans in examples(texts):
        c = Candidates(text, a, b, names, True)
        starts = {x: i for i, (x, _) in enumerate(c.tokens)}
        ends = {y: i + 1 for i, (_, y) in enumerate(c.tokens)}
        place = {s: i for i, s in enumerate(c.segments)}
        gold = []
        for kind, x, y in spans:
            s = place.get((starts.get(x, -1), ends.get(y, -1)))
            if s is None:
                break
            gold.append((s, KINDS.index(kind)))
        else:
            if c.segments:
                cases.append((c, gold))
    n = len(names)
    weights = np.zeros((n + 1, len(KINDS)))
    weights[-1] = -2.0
    if not cases:
        weights[-1] = -1e6
        return Field(names, weights)
    mats = [np.hstack([c.matrix(n), np.ones((len(c.rows), 1))]) for c, _ in cases]
    power = np.full_like(weights, 1e-6)
    for _ in range(epochs):
        grad = -0.01 * weights
        for (c, gold), m in zip(cases, mats, strict=True):
            scores = m @ weights
            size = len(c.tokens)
            each = np.logaddexp.reduce(scores, axis=1).tolist()
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for s, (i, j) in enumerate(c.segments):
                by_end.setdefault(j, []).append(s)
                by_start.setdefault(i, []).append(s)
            fore, back = [0.0] * (size + 1), [0.0] * (size + 1)
            for j in range(1, size + 1):
                fore[j] = _log_add([fore[j - 1], *(fore[c.segments[s][0]] + each[s] for s in by_end.get(j, ()))])
            for i in range(size - 1, -1, -1):
                back[i] = _log_add([back[i + 1], *(back[c.segments[s][1]] + each[s] for s in by_start.get(i, ()))])
            ends = np.array([fore[i] + back[j] - fore[size] for i, j in c.segments])
            want = -np.exp(np.minimum(scores + ends[:, None], 0))
            for s, k in gold:
                want[s, k] += 1
            grad += m.T @ want
        power += grad**2
        weights += 0.5 * grad / np.sqrt(power)
    return Field(names, weights)


def train(documents: DataFrame, most: int = TRAIN_DOCUMENTS) -> Field:
    """A field fitted on a bounded sample: of each of STARTS, the `most` documents with the
    smallest hashes in which it stands. At most 400 characters around it reach the driver,
    never whole texts."""
    near = []
    for start in STARTS:
        place = F.regexp_extract("text", rf"(?s)(.{{0,200}}(?:{start}).{{0,200}})", 1)
        rows = documents.where(F.col("text").rlike(start)).select(F.xxhash64("text").alias("h"), place.alias("near"))
        near.append(rows.distinct().orderBy("h", "near").limit(most))
    table = near[0]
    for more in near[1:]:
        table = table.union(more)
    return fit([r.near for r in sorted(table.collect())])


def find_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans, each by kind as listed, then start."""
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    held = merged(taken)
    added = []
    for a, b in windows(text, taken):
        first, last = bisect_right(held, a, key=lambda s: s[1]), bisect_left(held, b, key=lambda s: s[0])
        added += field.best(text, a, b, held[first:last])
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added.

    Null texts are empty and have none. Repeated rows each give a row; an empty table gives
    none. The field is fitted on the documents unless given.
    """
    rows = documents.select("doc_id", "text")
    field = field or train(rows)

    def run(texts, _):
        found = [find_spans(t, field) for t in texts]
        out = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found]
        out["spans"] = [_listed(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))) for base, more in found]
        out["n_added"] = pa.array([len(more) for _, more in found], pa.int64())
        return {k: pa.array(v, pa.string()) if isinstance(v, list) else v for k, v in out.items()}

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(rows, run, f"{counts}, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = b
    return "".join(out) + text[at:]


def redact(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents, with every column, and personal data in text replaced by `<KIND>`."""
    field = field or train(documents.select("doc_id", "text"))

    none, clean = f"none_{uuid.uuid4().hex}", f"clean_{uuid.uuid4().hex}"  # names of no other column

    def run(texts, others):
        out = []
        for text, missing in zip(texts, others[none].to_pylist(), strict=True):
            base, more = find_spans(text, field)
            out.append(None if missing else mask(text, base + more))
        return {clean: pa.array(out, pa.string())}

    done = map_texts(documents.withColumn(none, F.col("text").isNull()), run, f"{clean} string")
    return done.select(*[F.col(clean).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def query(spark: SparkSession, path: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{path}/documents.parquet"))
