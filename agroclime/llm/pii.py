"""Personal data: validated base patterns, and further candidates judged by boosted trees.

High-recall generators propose overlapping spans that the base patterns leave: numbers in phone or card layout, IP
addresses in other notations, written-out mail addresses, and long tokens that may be secrets. Trees score each on its
format and the words around it; a threshold per kind, calibrated on layouts that the trees have not seen, selects.
Base spans always stay.

The trees learn from items planted into real text, one place in every document (``contexts``), and every kind has
positive layouts and look-alikes in three sets, for training, calibration and tests (``LAYOUTS``). No labels are needed.
Of the text before an item the trees read which kinds of words it holds; so Spark counts those readings over all
documents, and an example's weight is the share of the documents that read so.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
PRECISION = 0.98
REACH = 40  # characters before a span that its features read

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Matches of ip, card and phone lie inside maximal runs of these characters.
_RUN = re.compile(r"[0-9 ().+\-]{7,}")
_FIRST = re.compile(r"[+0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping addresses, from each @ outwards, so a long run without @ costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _regions(text: str):
    for run in _RUN.finditer(text):
        a, b = run.span()
        if first := _FIRST.search(text, a, b):
            while text[b - 1] not in "0123456789" and b > first.start() + 1:
                b -= 1
            if b - first.start() >= 7:
                yield first.start(), b


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind, then start."""
    spans = [(0, s, e) for s, e in _emails(text)]
    for a, b in _regions(text):
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text, a, b):
            digits = _DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
        for m in _PHONE.finditer(text, a, b):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, *m.span()))
    return sorted(spans)


# ---- candidates -------------------------------------------------------------------------------------------------

_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{2,6}(?:[ .-][0-9]{2,6}){0,4}(?![0-9A-Za-z])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./-]?[0-9]{3,6}){2,4}(?![0-9A-Za-z])")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])")
_DEFANGED = re.compile(r"(?<![0-9A-Za-z.\]])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9A-Za-z])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WORDS = {
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|tél|téléphone|telefon|teléfono|móvil)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|amex|debit|pay|karte|carte|tarjeta)\b", re.I),
    "mail": re.compile(r"\b(?:mail|email|e-mail|contact|write|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv6|host|server|address|client|login|from|peer)\b", re.I),
    "code": re.compile(r"\b(?:isbn|order|invoice|version|release|section|no|nr|ref|id|serial|date|page|chapter|time|at)\b", re.I),
    "secret": re.compile(r"(?:token|secret|passw|pwd|key|auth|bearer|credential)", re.I),
    "digest": re.compile(r"\b(?:commit|sha1|sha256|md5|checksum|digest|hash|revision|etag)\b", re.I),
}


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that might be personal data and touch no base span; they may overlap each other."""
    found = []
    for a, b in _regions(text):
        a = max(0, a - 1)
        found += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text, a, b)]
        found += [(2, *m.span()) for m in _LOOSE_CARD.finditer(text, a, b)]
        found += [(1, *m.span()) for m in _LOOSE_IP.finditer(text, a, b)]
    if "at" in text and ("[" in text or "(" in text):
        for mark in re.finditer(r"[\[(](?:at|AT)[\])]", text):
            start = mark.start() - (text[mark.start() - 1 : mark.start()] == " ")
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if m := _SPELLED.match(text, start):
                found.append((0, *m.span()))
    if "[.]" in text or "(.)" in text:
        found += [(1, *m.span()) for m in _DEFANGED.finditer(text) if m[0].count("[") + m[0].count("(")]
    if "::" in text or text.count(":") > 2:
        found += [(1, *m.span()) for m in _COLONS.finditer(text) if len(m[0]) > 4]
    for m in _TOKEN.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append((4, *m.span()))
    if not found:
        return found
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
    free = []
    for k, s, e in sorted(set(found)):
        before = int(np.searchsorted(starts, e)) if taken else 0
        if not before or reach[before - 1] <= s:
            free.append((k, s, e))
    return free


def _entropy(span: str) -> float:
    n = np.unique(np.frombuffer(span[:256].encode("utf-16-le"), "<u2"), return_counts=True)[1] / min(len(span), 256)
    return float(-(n * np.log2(n)).sum()) if len(span) else 0.0


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, left, right = text[start:end], text[max(0, start - REACH) : start], text[end : end + 12]
    digits = _DIGITS.sub("", span)
    groups = [len(g) for g in _DIGITS.split(span) if g]
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(digits), len(span), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0,
        max(groups, default=0), min(groups, default=0), float("(" in span), span.count("."), span.count("-"), span.count(" "), float(luhn(digits)) if len(digits) > 12 else 0.0,
        max((int(g[:4]) for g in _DIGITS.split(span) if g), default=0), float(left[-1:] in set("=\"'#$_/\\:")), float(left[-1:].isalnum()), float(right[:1].isalnum() or right[:1] in "%_/=\""),
        float(digits[:1] == "0"), int(digits[:2] or 0), span.count(":"), float("::" in span), span.count("["), hexes / max(len(span), 1), float(any(c.isupper() for c in span)),
        float(any(c.islower() for c in span)), _entropy(span), float(left.rstrip(" \"'")[-1:] in "=:"), *(float(bool(p.search(left))) for p in _WORDS.values()),
    ]


# ---- training ---------------------------------------------------------------------------------------------------

class _Maker:
    """Random items of given layouts. In a layout ``#`` is a digit, ``&`` a digit from 2 to 9, ``x`` a hex digit, ``*`` a
    letter or digit, ``w`` a small word; ``V`` is a valid check digit for the digits before it, ``U`` an invalid one."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def __call__(self, layout: str) -> str:
        out: list[str] = []
        for c in layout:
            if c == "#":
                out.append(self.r.choice("0123456789"))
            elif c == "&":
                out.append(self.r.choice("23456789"))
            elif c == "x":
                out.append(self.r.choice("0123456789abcdef"))
            elif c == "X":
                out.append(self.r.choice("0123456789ABCDEF"))
            elif c == "*":
                out.append(self.r.choice("abcdefghijkmnopqrstuvyzABCDEFGHIJKLMNOPQRSTYZ0123456789"))
            elif c == "w":
                out.append("".join(self.r.choice(["an", "er", "ti", "on", "la", "de", "sch", "ou", "re", "mi"]) for _ in range(self.r.randint(1, 3))))
            elif c in "VU":
                body = _DIGITS.sub("", "".join(out))
                right = next(d for d in "0123456789" if luhn(body + d))
                out.append(right if c == "V" else self.r.choice([d for d in "0123456789" if d != right]))
            else:
                out.append(c)
        return "".join(out)


#: Per set (train, calibrate, test) and kind: layouts of personal items with words before them, and of look-alikes.
LAYOUTS = {
    "train": {
        "email": (["w.## [at] w.com", "w(at)w.org", "w [at] w [dot] net", "w.w##(at)w [dot] com"], ["mail", "contact", "", "write"], [], []),
        "ip": (["&#[.]1##[.]&#[.]##", "2001:xxxx:xxxx::xxxx", "fe80::xxxx:xxxx:xxxx:xxxx", "xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx"], ["host", "ip", "server", "from", ""],
               ["1#:2#:3#", "0#:1#:4#", "###.###.###.9##", "3##.##.##.##", "1:2:3:4"], ["version", "at", "section", "time", ""]),
        "card": (["3### ###### ####V", "3#############V", "4###########V", "5###.####.####.###V", "4###/####/####/###V"], ["card", "visa", "carte", "pay", "credit"],
                 ["############U", "#############U", "##############U", "###############U", "#### #### #### ###U", "978##########", "####-####-####-###U"], ["order", "isbn", "ref", "the", "", "no"]),
        "phone": (["(&##) ###-####", "&##-###-####", "0## ### ## ##", "&##.###.####", "0#### ######", "&## ### ####"], ["call", "tel", "phone", "Telefon", "", "fax"],
                  ["19##-0#-1#", "20## 0# 1#", "1#.0#.20##", "### ## ##", "978-##-####-###", "### ### ### ### ###", "#### #### ####", "## ## ## ## ## ##", "1#-2#", "20##-20##"], ["order", "isbn", "date", "page", "", "version"]),
        "secret": (["x" * 40, "x" * 32, "*" * 40, "*" * 24, "AKIA" + "X" * 16], ['token = "', "api_key: ", "secret=", "password = ", 'auth_token="'],
                   ["x" * 40, "x" * 32, "wwww-www##", "www_www_wwww##", "x" * 64], ["commit ", "checksum ", "md5 ", "see ", "file ", "sha1: "]),
    },
    "calibrate": {
        "email": (["w_w(at)w.net", "w## [at] w [dot] org"], ["mail to", "", "contact"], [], []),
        "ip": (["1##(.)&#(.)1#(.)##", "2a02:xxx:xxxx:xx::x", "::1:xxxx:xxxx"], ["address", "login", "server", ""], ["0#:2#", "1#:0#:5#:2#", "2###.##.##.###"], ["time", "release", ""]),
        "card": (["3###-######-####V", "4####### ####V", "6###.####.####.###V"], ["debit", "card", "visa"], ["##############U", "###### ########U", "### ### ### ### ##U", "979##########"], ["invoice", "serial", "ref", "a", ""]),
        "phone": (["(&##)###-####", "0##-### ####", "&##-### ####", "0## ## ## ## ##"], ["mobile", "tel", "", "call"], ["20##.0#.1#", "####-##-##", "## ### ## #", "### #### ### ##", "#### ####"], ["section", "date", "ref", ""]),
        "secret": (["x" * 48, "*" * 32, "sk-" + "*" * 24], ["secret_key = '", "Bearer ", "pwd: ", "access token: "], ["x" * 40, "wwwww##www", "ww-ww-ww-ww##"], ["revision ", "digest ", "at ", "hash "]),
    },
    "test": {
        "email": (["w-w [at] w.com", "w.w (at) w [dot] net"], ["write to", "email", ""], [], []),
        "ip": (["&#[.]&#[.]1##.1##", "2606:xxxx::xxxx:xxxx", "fd00:xx:xx::xx"], ["client", "ip", "peer", ""], ["2#:1#:0#", "4##.###.##.#", "5:6:7"], ["version", "at", "chapter", ""]),
        "card": (["3#############V", "3### ######-####V", "4###.####.####V"], ["mastercard", "amex", "credit card"], ["#############U", "####.####.####.###U", "##############U"], ["id", "order no", "in", ""]),
        "phone": (["(0##) ### ####", "&##.### ####", "0#### ### ###"], ["phone", "call", "cell"], ["20##/0#/1#", "19## 1# 2#", "978 ## #### ###", "### ### ### ## ##"], ["date", "isbn", "page", ""]),
        "secret": (["x" * 36, "*" * 28, "*" * 44], ['token = "', "API key ", "password: ", "TOKEN="], ["x" * 64, "www##wwww", "x" * 40], ["commit ", "etag ", "sha256 ", "in "]),
    },
}


def _lead(hint: str) -> str:
    """A hint as it stands before an item: one that ends in a sign stands right before it."""
    return hint + " " if hint and hint[-1].isalnum() else hint


#: Characters of a document that the features of a planted item read before its hint: one number for each length of hint.
ROOMS = sorted({REACH - len(_lead(h)) for kinds in LAYOUTS.values() for _, near, _, far in kinds.values() for h in (*near, *far)}, reverse=True)
_AFTER = (" ", ", ", ".", "\" ", "!! ", "\n")
Contexts = tuple[tuple[int, int, int], ...]


_RUNS = re.compile(r"\w+")


@functools.lru_cache(1 << 16)
def _kinds(run: str) -> int:
    """Which kinds of words a run of letters, digits and underscores holds, as bits from 1 on: no pattern needs more than a run."""
    return sum(2 << i for i, p in enumerate(_WORDS.values()) if p.search(run))


def readings(tail: str) -> list[int]:
    """For each of ``ROOMS``, which kinds of words the features read in so many characters at the end, as bits.

    Bit 0 is a sign of assignment at the end, in the largest room alone: it is that of an item without a hint.
    """
    runs, out = [(m.start(), m.end(), m[0]) for m in _RUNS.finditer(tail)], []
    for room in ROOMS:
        start, read = max(0, len(tail) - room), 0
        for a, b, run in runs:
            if b > start:
                read |= _kinds(run if a >= start else run[start - a :])
        out.append(read)
    out[0] |= tail.rstrip(" \"'")[-1:] in "=:"
    return out


def _tails(docs: DataFrame, text_col: str) -> DataFrame:
    """(tail, h): of each text the characters before the begin of a word picked by its CRC-32, and its hash."""
    text = F.col(text_col).cast("string")
    upto = F.substring(text, F.lit(1), (F.crc32(text.cast("binary")) % (F.length(text) + 1)).cast("int"))
    left = F.substring(upto, F.lit(1), F.length(upto) - F.length(F.substring_index(upto, " ", -1)))
    return docs.filter(text.isNotNull()).select(F.right(left, F.lit(REACH)).alias("tail"), F.xxhash64(text).alias("h"))


def _counts(tails) -> Contexts:
    seen: Counter = Counter()
    for tail in tails:
        seen.update(zip(ROOMS, readings(tail), strict=True))
    return tuple(sorted((*key, n) for key, n in seen.items()))


def contexts(docs: DataFrame, text_col: str = "text") -> Contexts:
    """(room, reading, documents) of every document with text, before one word of it.

    Counted in the tasks; at most 256 readings of each room come back. Repeated rows count each; a null text counts
    nothing.
    """
    def read(batches):
        rows = _counts(tail for batch in batches for tail in batch.column(0).to_pylist())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["room", "reading", "n"])

    counted = _tails(docs, text_col).select("tail").mapInArrow(read, "room long, reading long, n long")
    return tuple(sorted(tuple(r) for r in counted.groupBy("room", "reading").agg(F.sum("n").alias("n")).collect()))


def sample_carriers(docs: DataFrame, text_col: str = "text") -> tuple[str, ...]:
    """For tests on small tables: what stands before the picked word of at most 300 documents. No query calls it."""
    return tuple(r.tail for r in _tails(docs, text_col).orderBy("h", "tail").limit(300).collect())


def planted(make: _Maker, kind: int, layout: str, hint: str, read: int) -> list[float]:
    """Features of a new item of the layout after a hint, where the document before them reads ``read``."""
    lead, span = _lead(hint), make(layout)
    x = features(lead + span + make.r.choice(_AFTER), kind, len(lead), len(lead) + len(span))
    first = len(x) - 1 - len(_WORDS)
    if not hint:
        x[first] = float(read & 1)
    for i in range(1, 1 + len(_WORDS)):
        x[first + i] = max(x[first + i], float(read >> i & 1))
    return x


def _by_room(found: Contexts | tuple[str, ...]) -> dict[int, list[tuple[int, int]]]:
    """(reading, documents) of each room; without documents, words of no kind. Texts stand for their contexts."""
    if found and isinstance(found[0], str):
        found = _counts(found)
    return {room: [(c, n) for r, c, n in found if r == room] or [(0, 1)] for room in ROOMS}


def _layouts(part: str):
    for kind, name in enumerate(KINDS):
        good, near, bad, far = LAYOUTS[part][name]
        for label, layouts, hints in ((1, good, near), (0, bad, far)):
            for layout in layouts:
                yield kind, label, layout, hints


def training_examples(part: str = "train", seed: int = 7, each: int = 60, found: Contexts | tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and kind of ``each`` planted spans of every layout of one set, in contexts drawn by their counts."""
    make, by_room = _Maker(seed), _by_room(found)
    x, y, kinds = [], [], []
    for kind, label, layout, hints in _layouts(part):
        for _ in range(each):
            hint = make.r.choice(hints)
            reads, n = zip(*by_room[REACH - len(_lead(hint))], strict=True)
            x.append(planted(make, kind, layout, hint, make.r.choices(reads, n)[0]))
            y.append(label)
            kinds.append(kind)
    return np.array(x), np.array(y, float), np.array(kinds)


def weighted_examples(part: str, seed: int, each: int, found: Contexts | tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, label, kind and weight of planted spans: every layout after every hint in every context.

    A layout weighs ``each``, split evenly over its hints and by the documents' counts over the contexts. A context of
    larger weight gets so many more items.
    """
    make, by_room = _Maker(seed), _by_room(found)
    x, y, kinds, weights = [], [], [], []
    for kind, label, layout, hints in _layouts(part):
        for hint in hints:
            room = by_room[REACH - len(_lead(hint))]
            total = sum(n for _, n in room)
            for read, n in room:
                weight = each * n / total / len(hints)
                items = max(1, round(weight))
                x += [planted(make, kind, layout, hint, read) for _ in range(items)]
                y += [label] * items
                kinds += [kind] * items
                weights += [weight / items] * items
    return np.array(x), np.array(y, float), np.array(kinds), np.array(weights)


@functools.lru_cache(8)
def model(found: Contexts | tuple[str, ...] = (), precision: float = PRECISION) -> tuple[BoostedTrees, tuple[float, ...]]:
    """Trees and one threshold per kind: the least score at which examples of the calibration layouts reach ``precision``."""
    x, y, _, w = weighted_examples("train", 7, 60, found)
    trees = BoostedTrees(trees=80, depth=4).fit(x, y, w)
    vx, vy, vk, vw = weighted_examples("calibrate", 8, 60, found)
    scores, cuts = trees.predict(vx), []
    for kind in range(len(KINDS)):
        s, t, w = scores[vk == kind], vy[vk == kind], vw[vk == kind]
        order = np.argsort(-s, kind="stable")
        good = np.cumsum((w * t)[order]) >= precision * np.cumsum(w[order])
        cuts.append(float(max(s[order][np.flatnonzero(good)[-1]], 0.5)) if good.any() and t.any() else 2.0)
    return trees, tuple(cuts)


def added_spans(text: str, base: list[tuple[int, int, int]], found: Contexts | tuple[str, ...] = ()) -> list[tuple[int, int, int]]:
    """The spans that the model of these contexts selects."""
    return selected(text, base, *model(found))


def selected(text: str, base: list[tuple[int, int, int]], trees: BoostedTrees, cuts: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """Selected candidates: best score first, of equal scores the first by kind and place, none overlapping another."""
    found = candidates(text, base)
    if not found:
        return []
    scores = np.concatenate([trees.predict(np.array([features(text, *c) for c in found[a : a + 4096]])) for a in range(0, len(found), 4096)])
    chosen: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []  # in order of place
    for i in np.argsort(-scores, kind="stable").tolist():
        kind, s, e = found[i]
        if scores[i] < cuts[kind]:
            continue
        at = bisect.bisect_left(taken, (s, e))
        if (at and taken[at - 1][1] > s) or (at < len(taken) and taken[at][0] < e):
            continue
        taken.insert(at, (s, e))
        chosen.append(found[i])
    return sorted(chosen)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    ordered = sorted((s, e, k) for k, s, e in spans)
    i = 0
    while i < len(ordered):
        s, e, k = ordered[i]
        i += 1
        while i < len(ordered) and ordered[i][0] < e:
            e = max(e, ordered[i][1])
            i += 1
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per document: id, base counts per kind, ``base`` and ``spans`` texts, and with ``redacted`` the clean text.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind (email, ip, card, phone, secret), then start;
    base spans are of the first four. A null or empty text has none (and stays null when redacted). Texts of any length
    are read whole. Rows that repeat each give a row; other columns are not read.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model(contexts(docs, text_col)))  # 80 trees of depth 4
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, *(f"n_{k}" for k in BASE_KINDS), "base", "spans", *(["redacted"] if redacted else [])]
    kinds = [pa.int64()] * 5 + [pa.string()] * (3 if redacted else 2)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = raw.as_py()
                text = whole or ""
                base = base_spans(text)
                spans = sorted([*base, *selected(text, base, *fitted.value)])
                counts = [sum(k == n for k, _, _ in base) for n in range(len(BASE_KINDS))]
                rows.append((doc_id, *counts, span_text(base), span_text(spans), *([redact(text, spans) if spans else whole] if redacted else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    longs = ", ".join(f"`{n}` long" for n in names[:5])
    return source.mapInArrow(run, longs + ", " + ", ".join(f"{n} string" for n in names[5:]))


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows with all spans of the text replaced, and ``length_col`` (if given) set to the new length of changed texts."""
    names = docs.columns
    fitted = docs.sparkSession.sparkContext.broadcast(model(contexts(docs, text_col)))  # 80 trees of depth 4

    def run(batches):
        for batch in batches:
            at = names.index(text_col)
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            lengths = columns[names.index(length_col)].to_pylist() if length_col else []
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    spans = [*base, *selected(text, base, *fitted.value)]
                    if spans:
                        texts[i] = redact(text, spans)
                        if length_col:
                            lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if length_col:
                columns[names.index(length_col)] = pa.array(lengths, columns[names.index(length_col)].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
