"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are applied as they are stated and their spans always stay.  The field adds
spans that the patterns miss: spelled-out addresses, numbers written otherwise, account numbers, keys.  Its segments
are runs of at most MAX_TOKENS tokens on one line; features are of the whole span (its shape, its check
digits, the word before it) and a dynamic programme over segment ends chooses boundaries and kinds together.  A segment needs
a trigger (a digit, an at sign or a spelled-out one), so text far from any trigger is outside for certain and is never scored:
the result is that of the whole text.

The field is trained here, by gradient ascent on the likelihood of generated sentences (GENERATED of them, a fixed seed), on
the driver and once a process.

Nulls: a null text is empty and has no span.  Repeated rows: each gives a row.  Extra columns are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BASE = ("email", "ip", "card", "phone")
#: Kinds of the field: the base's, written otherwise, and two that have no base pattern.
KINDS = (*BASE, "iban", "secret")
MAX_TOKENS, MAX_CHARS, NEAR = 16, 90, 8
GENERATED, EPOCHS, RATE, RIDGE = 900, 10, 0.3, 1e-3
#: What the likelihood of the field must gain over leaving a segment out.
BIAS = 1.0

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HARD = re.compile(r"[0-9@]")
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|AT|dot|DOT)\s?[\])}>]")
_SPELLED = re.compile(r"\s(?:at|AT)\s\S+\s(?:dot|DOT)\s")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\n")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns, each kind leftmost and without overlaps."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((first, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) < 12 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# The field


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _shape(s: str) -> str:
    s = re.sub(r"[0-9]+", "9", s)
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"\s+", " ", re.sub(r"(.{1,3}?)\1{2,}", r"\1*", s))[:24]


def _spread(s: str) -> float:
    return -sum((n := s.count(c) / len(s)) * math.log2(n) for c in set(s))


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """What the field sees of a candidate segment as a whole."""
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    compact = re.sub(r"\s+", "", s)
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].rpartition("\n")[2])
    spelled = re.sub(r"\s*[\[({<]?\s?\b(at|AT)\b\s?[\])}>]?\s*", "@", re.sub(r"\s*[\[({<]?\s?\b(dot|DOT)\b\s?[\])}>]?\s*", ".", s))
    edge_left = start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "@_.+-")
    edge_right = end == len(text) or not (text[end].isalnum() or text[end] in "@_-")
    hexed = bool(re.fullmatch(r"[0-9a-fA-F]+", compact))
    out = [
        f"shape={_shape(s)}",
        f"n={min(n_tokens, 12)}",
        f"digits={min(len(digits), 20)}",
        f"first={'9' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}",
        f"last={'9' if s[-1].isdigit() else 'a' if s[-1].isalpha() else s[-1]}",
        f"edges={edge_left}{edge_right}",
        f"word={before[-1].lower() if before else ''}",
        f"cards={12 <= len(digits) <= 19 and luhn(digits)}&{len(digits) == len(re.sub(r'[ .-]', '', s))}",
        f"address={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', spelled))}&{edge_left}{edge_right}&{spelled != s}",
        f"iban={_iban(s)}&{edge_left}{edge_right}",
        f"phone={bool(re.fullmatch(r'(?:[(][0-9]{2,4}[)][ ]?|00[1-9][0-9 ]{0,3}|0[0-9]{2,4}[ -]|[0-9]{3}[-. ])[0-9][0-9 .-]{5,12}[0-9]', s))}&{edge_left}{edge_right}",
        f"quad={bool(re.fullmatch(r'(?:[0-9]{1,3}[ ]?[.][ ]?|[0-9]{1,3}[\[(][.][\])]){3}[0-9]{1,3}', s)) and all(int(x) < 256 for x in re.findall('[0-9]+', s))}&{edge_left}{edge_right}",
        f"key={hexed and len(compact) >= 24 or len(compact) >= 20 and bool(re.fullmatch('[A-Za-z0-9_+/=-]+', compact)) and ' ' not in s and _spread(compact) > 3.5 and bool(digits)}&{n_tokens == 1 or ' ' not in s}&{edge_left}{edge_right}",
        f"gap={'  ' in s}{' ' in s}",
    ]
    return out


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def candidates(text: str, toks: list[tuple[int, int]], triggers: list[bool]) -> list[tuple[int, int]]:
    """Segments (first token, token after the last) that may be an entity: on one line, whole words, with a trigger."""
    out = []
    for i in range(len(toks)):
        if text[toks[i][0]] == "\n" or toks[i][0] and text[toks[i][0] - 1].isalnum() and text[toks[i][0]].isalnum():
            continue
        if not (text[toks[i][0]].isalnum() or text[toks[i][0]] in "+([{"):
            continue
        hot = False
        for j in range(i, min(len(toks), i + MAX_TOKENS)):
            a, z = toks[j]
            if text[a] == "\n" or z - toks[i][0] > MAX_CHARS or j > i and a - toks[j - 1][1] > 2:
                break
            hot |= triggers[j]
            if hot and z - toks[i][0] >= 7 and text[z - 1].isalnum() and not (z < len(text) and text[z].isalnum() and text[z - 1].isalnum()):
                out.append((i, j + 1))
    return out



class Field:
    """Weights of (kind, feature); a segment's score is their sum, and a token outside scores 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.none = weights, np.zeros(len(KINDS))

    def scores(self, features: list[str]) -> np.ndarray:
        total = self.weights.get("bias", self.none)
        for f in features:
            if (w := self.weights.get(f)) is not None:
                total = total + w
        return total

    def entities(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind, end) of the best segmentation of the whole text."""
        out = []
        for start, end in regions(text):
            toks = tokens(text, start, end)
            segments = candidates(text, toks, triggered(text, toks))
            if not segments:
                continue
            by_end: dict[int, list] = {}
            for i, j in segments:
                score = self.scores(span_features(text, toks[i][0], toks[j - 1][1], j - i)) - BIAS
                kind = int(score.argmax())
                if score[kind] > 0:
                    by_end.setdefault(j, []).append((float(score[kind]), i, kind))
            best, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
            for j in range(1, len(toks) + 1):
                best[j] = best[j - 1]
                for score, i, kind in by_end.get(j, ()):
                    if best[i] + score > best[j]:
                        best[j], back[j] = best[i] + score, (i, kind)
            j = len(toks)
            while j:
                if back[j] is None:
                    j -= 1
                else:
                    i, kind = back[j]
                    out.append((toks[i][0], kind, toks[j - 1][1]))
                    j = i
        return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around the triggers, far enough that no segment crosses an end."""
    out: list[list[int]] = []
    found_at = [m.span() for m in _HARD.finditer(text)] + [m.span() for m in _BRACKETED.finditer(text)]
    if " dot " in text or " DOT " in text:
        found_at += [m.span() for m in _SPELLED.finditer(text)]
    for first, last in sorted(found_at):
        a, z = max(0, first - MAX_CHARS), min(len(text), last + MAX_CHARS)
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    for r in out:  # not within a word
        while r[0] and text[r[0]].isalnum() and text[r[0] - 1].isalnum():
            r[0] -= 1
        while r[1] < len(text) and text[r[1]].isalnum() and text[r[1] - 1].isalnum():
            r[1] += 1
    joined: list[list[int]] = []
    for r in out:
        if joined and r[0] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], r[1])
        else:
            joined.append(r)
    return [(a, z) for a, z in joined]


def triggered(text: str, toks: list[tuple[int, int]]) -> list[bool]:
    out = []
    for a, z in toks:
        word = text[a:z]
        spelled = word in ("at", "AT") and re.match(r"\s?[\])}>]|\s\S+\s(?:dot|DOT)\s", text[z : z + 60]) is not None and (a > 0 and (text[a - 1] in "[({< "))
        out.append(spelled or word == "@" or any("0" <= c <= "9" for c in word))
    return out


# Training


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with the entities in them."""
    rnd = random.Random(seed)
    digit = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "la", "de", "ung", "ment", "os", "ci", "ba", "mo", "li"]) for _ in range(rnd.randint(1, 4)))

    def number(k: int) -> str:
        body = digit(k - 1)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def email() -> str:
        name = rnd.choice([f"{word()}.{digit(2)}", f"{word()}.{word()}", f"{word()}{digit(3)}", word()])
        host = [rnd.choice([word(), f"{word()}{digit(1)}"]) for _ in range(rnd.choice([1, 1, 2]))] + [rnd.choice(["com", "org", "net", "de", "example"])]
        at, dot = rnd.choice([("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" @ ", ".")])
        return name.replace(".", dot if rnd.random() < 0.5 and dot != "." else ".") + at + dot.join(host)

    def phone() -> str:
        return rnd.choice([f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"00{rnd.randint(10, 99)} {digit(3)} {digit(6)}", f"0{digit(3)} {digit(7)}", f"{rnd.randint(2, 9)}{digit(2)}-{digit(3)}-{digit(4)}", f"{rnd.randint(2, 9)}{digit(2)}.{digit(3)}.{digit(4)}", f"00{rnd.randint(10, 99)} {digit(2)} {digit(7)}"])

    def iban() -> str:
        land, body = rnd.choice(["DE", "FR", "ES", "GB"]), digit(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land) + "00") % 97
        s = f"{land}{check:02d}{body}"
        return s if rnd.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def ip() -> str:
        dots = rnd.choice([(".",) * 3, (" . ",) * 3, ("[.]",) * 3, tuple(rnd.choices([".", "[.]", "(.)"], k=3))])
        return "".join(f"{rnd.randint(0, 255)}{dot}" for dot in (*dots, ""))

    made = {
        "email": email,
        "ip": ip,
        "card": lambda: rnd.choice([lambda s: s, lambda s: " ".join(s[i : i + 4] for i in range(0, 16, 4)), lambda s: "-".join(s[i : i + 4] for i in range(0, 16, 4)), lambda s: ".".join(s[i : i + 4] for i in range(0, 16, 4))])(number(16)),
        "phone": phone,
        "iban": iban,
        "secret": lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([32, 40, 64]))),
    }
    other = [
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}",
        lambda: f"{rnd.randint(1, 23)}:{rnd.randint(10, 59)}:{rnd.randint(10, 59)}",
        lambda: f"{digit(3)},{digit(3)},{digit(3)}.{digit(2)}",
        lambda: f"version {rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 20)}",
        lambda: f"{word()} at {word()} {rnd.randint(1, 99)}",
        lambda: f"{digit(1)}.{digit(rnd.randint(6, 30))}",
        lambda: f"{digit(3)}-{digit(1)}-{digit(2)}-{digit(6)}-{digit(1)}",
        lambda: f"{rnd.randint(1, 99)} {word()} {rnd.randint(1, 999)}",
        lambda: digit(rnd.choice([4, 5, 6, 8, 9, 13, 20])),
        lambda: f"{digit(4)} {digit(4)} {digit(4)}",
        lambda: f"{digit(3)} {digit(3)} {digit(4)} {digit(2)}",
        lambda: f"(CC BY-NC {rnd.randint(1, 4)}.{rnd.randint(0, 9)}), {word()}",
        lambda: f"| {digit(3)} | {digit(4)} | {digit(2)}.{digit(2)} | {digit(6)} |",
        lambda: f"{word()}_{digit(12)}{word()}",
    ]
    cues = {"email": ["mail", "contact", ""], "ip": ["host", "address", ""], "card": ["card", "visa", ""], "phone": ["phone", "tel", "call", ""], "iban": ["iban", "account", ""], "secret": ["token =", "key:", "secret =", "password:"]}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(1, 3)):
            text += " ".join(word() for _ in range(rnd.randint(1, 4))) + " "
            if rnd.random() < 0.5:
                kind = rnd.choice(KINDS)
                cue = rnd.choice(cues[kind])
                quote = rnd.choice(['"', "", ""])
                text += (cue + " " if cue else "") + quote
                s = made[kind]()
                spans.append((len(text), KINDS.index(kind), len(text) + len(s)))
                text += s + quote + rnd.choice([" ", ". ", ", "])
            else:
                text += rnd.choice(other)() + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    """Maximises the likelihood of the generated segmentations; gradients by forward and backward sums over segments."""
    names: dict[str, int] = {"bias": 0}
    problems = []
    for text, spans in _examples(GENERATED, 7):
        toks = tokens(text, 0, len(text))
        segments = candidates(text, toks, triggered(text, toks))
        if not segments:
            continue
        feats = [[0, *(names.setdefault(f, len(names)) for f in span_features(text, toks[i][0], toks[j - 1][1], j - i))] for i, j in segments]
        gold = {(a, z): k for a, k, z in spans}
        label = np.array([gold.get((toks[i][0], toks[j - 1][1]), -1) for i, j in segments])
        problems.append((len(toks), np.array(segments), np.array(feats), label))
    weights, power = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6)
    for _ in range(EPOCHS):
        for n, segments, feats, label in problems:
            score = weights[feats].sum(1)
            kinds = np.logaddexp.reduce(score, 1)
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0.0
            by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for s, (i, j) in enumerate(segments.tolist()):
                by_end[j].append((i, kinds[s]))
                by_start[i].append((j, kinds[s]))
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1], *(ahead[i] + k for i, k in by_end[j])])
            for i in range(n - 1, -1, -1):
                behind[i] = _logsum([behind[i + 1], *(behind[j] + k for j, k in by_start[i])])
            log_p = score + (ahead[segments[:, 0]] + behind[segments[:, 1]])[:, None] - ahead[n]
            grad = -np.exp(np.minimum(log_p, 0))
            right = np.flatnonzero(label >= 0)
            grad[right, label[right]] += 1
            full = np.zeros_like(weights)
            np.add.at(full, feats, grad[:, None, :])
            touched = np.unique(feats)
            step = full[touched] - RIDGE * weights[touched]
            power[touched] += step**2
            weights[touched] += RATE * step / np.sqrt(power[touched])
    return Field({name: weights[i] for name, i in names.items() if np.abs(weights[i]).max() > 1e-3})


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top if len(x) == 1 or top == -math.inf else top + math.log(sum(math.exp(y - top) for y in x))


def found(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): the field's are added where they meet no base span."""
    base = base_spans(text) if _HARD.search(text) else []
    taken = sorted((a, z) for a, _, z in base)
    added, k, reach = [], 0, -1
    for a, kind, z in field.entities(text):
        while k < len(taken) and taken[k][0] < z:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            added.append((a, kind, z))
    return base, sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document: counts of base spans by kind, their digest, all spans, and how many the field added by kind and in all."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            n, digest, spans, added = [[] for _ in BASE], [], [], [[] for _ in KINDS]
            for t in batch.column(1):
                base, every = found(t.as_py() or "", field)
                for k in range(len(BASE)):
                    n[k].append(sum(1 for b in base if b[1] == k))
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
                for k in range(len(KINDS)):
                    added[k].append(sum(1 for x in every if x[1] == k) - sum(1 for x in base if x[1] == k))
            total = [sum(x) for x in zip(*n, *added, strict=True)]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string()), *(pa.array(x, pa.int64()) for x in added), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"added_{k}" for k in KINDS), "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + "".join(f"added_{k} long, " for k in KINDS) + "n_spans long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
