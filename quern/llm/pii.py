"""Personal data by a semi-Markov conditional random field.

A text's regions are the runs of blank-separated words that hold a digit or an at sign, are short
groups of letters after the head of an IBAN, or are assigned to the name of a secret
(`password=abcdefgh`); any run of blanks may stand between the words of a region. Nothing else is
searched: a secret of letters only without such a name and sign before it isn't found. A region is
cut into atoms: alphanumeric runs, runs of blanks, single signs. Features of a whole candidate span
- its shape, checks that need all of it, its neighbours and the words before it - score each span
of up to LONGEST atoms, and longer addresses and assigned secrets at their full extent, with each
type; dynamic programming over spans and their transitions finds the jointly best boundaries and
types. Weights maximise the likelihood of generated, labelled text, by forward and backward sums
and AdaGrad.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .lean import mapped

TYPES = ["O", "email", "phone", "ip", "card", "ssn", "secret", "iban"]
#: Atoms of the longest entity, but for addresses and assigned secrets.
LONGEST = 18
#: Generated regions that the field is fitted to.
SENTENCES = 700
_ATOM = re.compile(r"[^\W_]+|[\x00-\x20\s]+|.", re.S)
_NAME = r"(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret)[_-]?key)[\"'`]?[ \t]{0,8}"
_VALUE = r"[=>]?[ \t]{0,8}[\"'`]?(?=[^\x00-\x20\"'`])"
#: What stands before an assigned secret, at most 40 characters; its parts before and behind the sign.
_ASSIGNED = re.compile(f"{_NAME}[:=]{_VALUE}", re.I)
_NAMED, _VALUED = re.compile(f"{_NAME}$".encode(), re.I), re.compile(_VALUE.encode())
_BLANKS = rb"(?:[\x00-\x20]|\xc2\xa0|\xe2\x80[\x80-\x8a\xaf])+"
#: The rest of an IBAN behind its country and check digits: groups with a digit, or of up to four letters.
_GROUPS = re.compile(rb"[A-Za-z0-9]{0,30}(?:%b(?:[A-Za-z]{1,4}|[A-Za-z]*[0-9][A-Za-z0-9]*)(?![A-Za-z0-9])(?:(?=%b)|(?![\x80-\xff]))){0,12}" % (_BLANKS, _BLANKS))
_CUES = {"token": "S", "key": "S", "secret": "S", "password": "S", "passwd": "S", "bearer": "S", "apikey": "S", "api_key": "S", "phone": "P", "tel": "P", "call": "P", "fax": "P", "mobile": "P", "email": "E", "mail": "E", "contact": "E", "ip": "I", "host": "I", "addr": "I", "from": "I", "card": "C", "visa": "C", "ssn": "N", "iban": "B", "version": "V", "v": "V", "section": "V", "release": "V", "order": "Q", "no": "Q", "id": "Q"}
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True


def _shape(atom: str) -> str:
    if atom.isdigit():
        return f"d{len(atom)}"
    if atom[0].isalnum():
        if len(atom) >= 16:
            digits = sum(c.isdigit() for c in atom)
            if digits and digits < len(atom):
                return ("h" if all(c in "0123456789abcdefABCDEF" for c in atom) else "m") + ("L" if len(atom) >= 24 else "M")
            return "A"
        if atom[0].isalpha() and atom[-1].isdigit() and len(atom) <= 4 and atom[:2].isupper() and atom[2:].isdigit():
            return f"B{len(atom)}"
        return "x" if any(c.isdigit() for c in atom) else "a"
    return " " if _blank(atom) else atom


def _blank(atom: str) -> bool:
    return atom[0] <= " " or atom.isspace()


def _edge(c: str) -> str:
    return "w" if c.isalpha() else "d" if c.isdigit() else "_" if _blank(c) else c


def _iban(span: str) -> bool:
    """Whether the check digits are right, whatever blanks stand between."""
    s = "".join(c for c in span if not _blank(c)).upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_v6(span: str) -> bool:
    try:
        return IPv6Address(span).packed is not None
    except ValueError:
        return False


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


class Region:
    """Atoms of a region with what span features need; `before` is the text in front of it."""

    def __init__(self, text: str, before: str = ""):
        self.text, self.start = text, []
        self.atoms = []
        for m in _ATOM.finditer(text):
            self.atoms.append(m.group())
            self.start.append(m.start())
        self.start.append(len(text))
        self.shapes = [_shape(a) for a in self.atoms]
        words = re.findall(r"[^\W\d]+", before.lower())[-2:]
        self.cue0 = "".join(sorted({_CUES[w] for w in words if w in _CUES}))
        self.blank = [_blank(a) for a in self.atoms]
        self.words = [a.lower() if a[0].isalpha() else "" for a in self.atoms]
        values = {m.end() - len(before) for m in _ASSIGNED.finditer(before + text)}
        self.assigned = [x in values for x in self.start[:-1]]

    def key(self, i: int, j: int) -> tuple:
        """All that the features of atoms i..j-1 depend on."""
        shape = "".join(self.shapes[i:j])
        flags = ""
        if "@" in shape:
            local, _, domain = "".join(self.atoms[i:j]).partition("@")
            parts = domain.split(".")
            flags = "e" if domain.count("@") == 0 and local and len(parts) > 1 and all(parts) and parts[-1].isalpha() and 2 <= len(parts[-1]) <= 12 and not any(c.isspace() for c in local + domain) else "f"
            shape = re.sub(r"d\d+", "d", shape)
            shape = re.sub(r"[axdAhmBLM]+\d*", "w", shape)
            shape = re.sub(r"(?:w[._+-])+", "v", shape)
        elif "." in shape:
            span = "".join(self.atoms[i:j])
            quad = span.split(".")
            if len(quad) == 4 and all(q.isdigit() and len(q) <= 3 for q in quad):
                flags = "q" if all(int(q) < 256 for q in quad) else "r"
                shape = "d.d.d.d"
        elif ":" in shape and shape.count(":") > 1 and not set(shape) - set("dxaABhmLM0123456789:"):
            flags = "6" if _is_v6("".join(self.atoms[i:j])) else "7"
            shape = "g:g"
        digits = sum(len(a) for a, s in zip(self.atoms[i:j], self.shapes[i:j]) if s[0] == "d")
        if digits >= 12 and set(shape) <= set("d0123456789 -"):
            flags += "l" if _luhn("".join(c for c in "".join(self.atoms[i:j]) if c.isdigit())) else ""
        head = self.atoms[i]
        if len(head) >= 4 and head[:2].isalpha() and head[2:4].isdigit():
            flags += "i" if _iban("".join(self.atoms[i:j])) else ""
        if self.assigned[i]:
            flags += "a"
        if any(b and "\n" in a for a, b in zip(self.atoms[i:j], self.blank[i:j])):
            flags += "n"
        left = _edge(self.atoms[i - 1][-1]) if i else "^"
        right = _edge(self.atoms[j][0]) if j < len(self.atoms) else "$"
        deep_left = self.shapes[i - 2][0] if i > 1 else "^"
        deep_right = self.shapes[j + 1][0] if j + 1 < len(self.atoms) else "$"
        cue = "".join(sorted({_CUES[w] for w in self.words[max(0, i - 6) : i] if w in _CUES})) or (self.cue0 if i < 4 else "")
        return shape, flags, left, right, deep_left, deep_right, cue, min(digits, 20)


def _features(key: tuple) -> list[str]:
    shape, flags, left, right, deep_left, deep_right, cue, digits = key
    out = ["1", f"s={shape}", f"l={left}", f"r={right}", f"n={digits}", f"c={cue}", f"ll={left}{deep_left}", f"rr={right}{deep_right}", f"e={shape[:1]}", f"z={shape[-1:]}", f"sp={' ' in shape}", f"k={min(len(shape), 24) // 4}"]
    return out + [f"f={f}" for f in flags] + ([] if flags else ["f=0"])


@dataclass
class Field:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(TYPES), len(TYPES))))

    def score(self, key: tuple) -> np.ndarray:
        """Score by type of a span; 0 for O, whose spans are single atoms."""
        out = np.zeros(len(TYPES))
        for f in _features(key):
            w = self.weights.get(f)
            if w is not None:
                out += w
        out[0] = 0
        return out


def _spans(r: Region) -> list[tuple[int, int]]:
    """Candidate entities: no blank at either end, at most LONGEST atoms, a digit or an at sign or, without a blank, assigned to a secret's name; longer addresses and assigned secrets at their full extent."""
    n, out = len(r.atoms), []
    strong = [any(c.isdigit() or c == "@" for c in a) for a in r.atoms]
    upto = [0]
    for s in strong:
        upto.append(upto[-1] + s)
    for i in range(n):
        if not r.blank[i]:
            whole = r.assigned[i]
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                whole = whole and not r.blank[j - 1]
                if (upto[j] > upto[i] or whole) and not r.blank[j - 1]:
                    out.append((i, j))
    return sorted({*out, *_long(r)}) if n > LONGEST else out


def _long(r: Region) -> list[tuple[int, int]]:
    """Addresses and assigned secrets of more than LONGEST atoms, from the first to the last alphanumeric one; time is linear in the region."""
    n, out, upto = len(r.atoms), [], 0
    for k, atom in enumerate(r.atoms):
        if atom == "@":
            i, j = k, k + 1
            while i and (r.atoms[i - 1][0].isalnum() or r.atoms[i - 1] in "._%+-"):
                i -= 1
            while j < n and (r.atoms[j][0].isalnum() or r.atoms[j] in ".-"):
                j += 1
            while i < k and not r.atoms[i][0].isalnum():
                i += 1
            while j > k + 1 and not r.atoms[j - 1][0].isalnum():
                j -= 1
            if i < k < j - 1 and j - i > LONGEST:
                out.append((i, j))
        elif r.assigned[k] and k >= upto:
            j = k
            while j < n and not r.blank[j] and r.atoms[j] not in "\"'`,;":
                j += 1
            upto = j
            while j > k and not (r.atoms[j - 1][0].isalnum() or r.atoms[j - 1] in "=/+_-"):
                j -= 1
            if j - k > LONGEST:
                out.append((k, j))
    return out


def decode(model: Field, r: Region, cache: dict[tuple, list[float]]) -> list[tuple[int, int, int]]:
    """Best segmentation: (start, end, type) of the entities, in characters of the region."""
    n, y = len(r.atoms), range(len(TYPES))
    ends: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
    moves = model.moves.tolist()
    for i, j in _spans(r):
        key = r.key(i, j)
        s = cache.get(key)
        if s is None:
            s = cache[key] = model.score(key).tolist()
        if j - i > LONGEST:  # atoms beyond count as they would outside
            s = [x + (j - i - LONGEST) * moves[0][0] for x in s]
        ends[j].append((i, s))
    columns = list(zip(*moves))
    enter: list[tuple[list[float], list[int]]] = []
    best = [[0.0] + [-1e18] * (len(TYPES) - 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * len(TYPES)]
    for j in range(n + 1):
        if j:
            e, frm = enter[j - 1]
            row, where = [e[0]] + [-1e18] * (len(TYPES) - 1), [(j - 1, frm[0])] + [(0, 0)] * (len(TYPES) - 1)
            for i, s in ends[j]:
                e, frm = enter[i]
                for t in y[1:]:
                    v = e[t] + s[t]
                    if v > row[t]:
                        row[t], where[t] = v, (i, frm[t])
            best.append(row)
            back.append(where)
        now = best[j]
        values, choice = [], []
        for col in columns:
            v = [a + b for a, b in zip(now, col)]
            top = max(v)
            values.append(top)
            choice.append(v.index(top))
        enter.append((values, choice))
    t = best[n].index(max(best[n]))
    out, j = [], n
    while j > 0:
        i, before = back[j][t]
        if t:
            out.append((r.start[i], r.start[j], t))
        j, t = i, before
    return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


def _likelihood(r: Region, gold: dict[tuple[int, int], int], score: np.ndarray, spans: list[tuple[int, int]], moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, its gradient by span and type, by transition)."""
    n, y = len(r.atoms), len(TYPES)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        by_end[j].append(k)
        by_start[i].append(k)
    starts, ends = np.array([s[0] for s in spans], int), np.array([s[1] for s in spans], int)
    beyond = np.maximum(ends - starts - LONGEST, 0)[:, None]
    score = score + beyond * moves[0, 0]
    low = -1e9
    a, enter = np.full((n + 1, y), low), np.full((n + 1, y), low)
    a[0, 0] = 0
    enter[0] = moves[0]
    for j in range(1, n + 1):
        a[j, 0] = enter[j - 1, 0]
        if by_end[j]:
            ks = by_end[j]
            a[j, 1:] = _lse(enter[starts[ks], 1:] + score[ks, 1:], 0)
        enter[j] = _lse(a[j][:, None] + moves, 0)
    z = _lse(a[n], 0)
    b, leave = np.full((n + 1, y), low), np.full((n + 1, y), low)  # leave[i, t]: what may follow when a segment of type t starts at i
    b[n] = 0
    for i in range(n - 1, -1, -1):
        leave[i, 0] = b[i + 1, 0]
        if by_start[i]:
            ks = by_start[i]
            leave[i, 1:] = _lse(score[ks, 1:] + b[ends[ks], 1:], 0)
        b[i] = _lse(moves + leave[i][None], 1)
    g = np.zeros_like(score)
    if len(spans):
        g[:, 1:] = -np.exp(enter[starts, 1:] + score[:, 1:] + b[ends, 1:] - z)
    d = np.zeros_like(moves)
    for i in range(n):
        d -= np.exp(a[i][:, None] + moves + leave[i][None] - z)
    value, at, t = -z, 0, 0
    index = {s: k for k, s in enumerate(spans)}
    begins = {i: (j, k) for (i, j), k in gold.items()}
    while at < n:
        j, u = begins.get(at, (at + 1, 0))
        value += moves[t, u]
        d[t, u] += 1
        if u:
            k = index[at, j]
            value += score[k, u]
            g[k, u] += 1
        at, t = j, u
    d[0, 0] += (beyond * g).sum()
    return value, g, d


IBANS = """AT 5n 11n;BE 3n 7n 2n;BG 4a 4n 2n 8c;CH 5n 12c;DE 8n 10n;DK 4n 9n 1n;ES 4n 4n 1n 1n 10n;FI 14n;FR 5n 5n 11c 2n;GB 4a 6n 8n;GI 4a 15c;IE 4a 6n 8n;IT 1a 5n 5n 12c;LU 3n 13c
LV 4a 13c;MT 4a 5n 18c;NL 4a 10n;NO 4n 6n 1n;PL 8n 16n;PT 4n 4n 11n 2n;RO 4a 16c;SC 4a 2n 2n 16n 3a;SE 3n 16n 1n;TR 5n 1n 16c""".replace("\n", ";").split(";")


class Generator:
    """Labelled text: invented words, entities of all types, and numbers that are none."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        w = "".join(r.choice("aeiou" if k % 2 else "bcdfghlmnprst") for k in range(r.randint(2, 9)))
        return r.choice([w, w, w, w.capitalize(), w.upper()])

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def entity(self, kind: str) -> str:
        r, d, w = self.r, self.digits, lambda: self.word().lower()
        if kind == "email":
            if r.random() < 0.1:
                return ".".join(w() for _ in range(r.randint(2, 5))) + f"{r.choice('-_')}{w()}+{w()}@{w()}.{w()}.{w()}.{r.choice(['com', 'de', 'co.uk'])}"
            local = r.choice([w(), f"{w()}.{w()}", f"{w()}.{d(2)}", f"{w()}{d(r.randint(1, 4))}", f"{w()}_{d(2)}", f"{w()}-{w()}", f"{w()}+{w()}", f"{w()}.{w()}.{d(2)}"])
            return f"{local}@{r.choice(['', 'mail' + d(1) + '.', w() + '.', d(2) + w() + '.', w() + '-'])}{w()}.{r.choice(['com', 'org', 'net', 'io', 'de', 'co.uk', 'fr', 'example.com'])}"
        if kind == "phone":
            return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1{d(10)}", f"+49 {d(3)} {d(7)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(5)} {d(5)}", f"(0{d(2)}) {d(r.randint(6, 8))}", f"+{d(2)} (0){d(2)} {d(7)}"])
        if kind == "ip":
            if r.random() < 0.3:
                groups = [format(r.randint(0, 65535), "x") for _ in range(8)]
                cut, n = r.randint(0, 5), r.randint(2, 4)
                return r.choice([":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[min(8, cut + n + 1) :])])
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            four = [d(4) for _ in range(4)]
            return r.choice(["".join(four), "".join(four), " ".join(four), "-".join(four), f"{d(4)} {d(6)} {d(5)}", d(15)])
        if kind == "ssn":
            return f"{d(3)}-{d(2)}-{d(4)}"
        if kind == "iban":
            if r.random() < 0.75:
                return self.iban()
            country = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
            return r.choice([f"{country}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{country}{d(20)}"])
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64])))
        some = lambda n, of: "".join(r.choice(of) for _ in range(n))
        mixed = string.ascii_letters + string.digits
        if r.random() < 0.35:
            keyed = [f"AKIA{some(16, string.ascii_uppercase + string.digits)}", f"ghp_{some(36, mixed)}", f"{r.choice(['sk', 'pk', 'rk'])}_{r.choice(['live', 'test'])}_{some(24, mixed)}", ".".join(["eyJ" + some(r.randint(17, 60), mixed), "eyJ" + some(r.randint(17, 90), mixed), some(r.randint(30, 60), mixed)])]
            return r.choice(keyed)
        return r.choice([hexa, hexa, "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.choice([24, 32, 40])))])

    def iban(self) -> str:
        """With right check digits, in one piece, in fours, or cut as the country cuts it. In IBANS: n is a digit, a a letter, c either."""
        r = self.r
        country, *parts = r.choice(IBANS).split()
        kinds = {"n": string.digits, "a": string.ascii_uppercase, "c": string.digits * 3 + string.ascii_uppercase}
        parts = ["".join(r.choice(kinds[p[-1]]) for _ in range(int(p[:-1]))) for p in parts]
        check = 98 - int("".join(str(int(c, 36)) for c in f"{''.join(parts)}{country}00")) % 97
        whole = f"{country}{check:02}{''.join(parts)}"
        fours = " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))
        return r.choice([fours, fours, whole, " ".join([whole[:4], *parts])])

    def password(self) -> str:
        """A secret that may be of letters only."""
        r, d, w = self.r, self.digits, lambda: self.word()
        return r.choice([w(), w(), w() + w(), f"{w()}{d(2)}", f"{w()}-{w()}", f"{w()}_{w()}", f"{w()}!{d(1)}", f"{w()}{r.choice('!@#$%&*')}{w()}", "".join(r.choice(string.ascii_letters) for _ in range(r.choice([8, 12, 24, 32]))), ".".join(w() + d(1) for _ in range(3))])

    def decoy(self) -> str:
        r, d, w = self.r, self.digits, self.word
        return r.choice([str(r.randint(1900, 2030)), d(1), d(2), d(3), d(4), d(5), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"${d(2)}.{d(2)}", f"{d(2)}%", f"{r.randint(1980, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1980, 2030)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)},{d(3)}", f"{d(2)}-{d(2)}", f"@{w().lower()}", f"@{w().lower()}{d(2)}", f"{w()}@", f"{r.randint(300, 999)}.{r.randint(256, 999)}.{d(3)}.{d(1)}", f"{d(1)}rd", f"{w().lower()}{d(1)}", f"#{d(5)}", f"{d(6)}", f"{d(7)}", f"{d(8)}", f"({d(2)})", f"[{d(2)}]", f"{d(3)}.", f"{w()}-{d(2)}", f"{d(2)} {w()}", f"Version {d(1)}.{d(1)}", f"{d(4)} {d(4)}", f"{d(3)} {d(2)}", f"{d(1)}.{d(1)} {d(2)}", "-" * r.randint(1, 4) + d(2), f"{w()} {r.randint(1, 31)}, {r.randint(1900, 2030)}"])

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r, text, found = self.r, "", []
        for k in range(r.randint(1, 4)):
            text += " ".join(self.word() for _ in range(r.randint(0, 4)))
            text += r.choice(["", " ", " ", ". ", ", ", "\n", ": ", " (", ' "', "; "]) if text else ""
            if text and text[-1].isalnum():
                text += " "
            if r.random() < 0.6:
                kind = r.choice(TYPES[1:])
                cue = ""
                if kind == "secret":
                    cue = r.choice(['token = "', "api_key=", "secret: ", "password = '", "key: ", "password=", "password: ", '"password": "'])
                    text += cue
                elif r.random() < 0.2:
                    text += {"email": "email ", "phone": "phone: ", "ip": "host ", "card": "card ", "ssn": "SSN ", "iban": "IBAN: "}[kind]
                e = self.password() if cue and cue != "key: " and r.random() < 0.5 else self.entity(kind)
                if r.random() < 0.2:
                    e = "".join(r.choice(["  ", "   ", "\t", "\n", "\r\n", "\n  ", "\xa0", " "]) if c == " " else c for c in e)
                found.append((len(text), len(text) + len(e), kind))
                text += e
            else:
                text += self.decoy()
            text += r.choice([" ", " ", " ", ". ", ", ", '" ', ") ", "\n", "; ", "### ", "%%% ", "!! ", "*** ", " | ", "&&& ", "$$$ "])
        return text, found


def _beside(data: np.ndarray, offsets: np.ndarray, hits: np.ndarray) -> list[int]:
    """Places without a trigger that belong to a region: letter groups of IBANs, and what is assigned to a secret's name."""
    raw, out = data.tobytes(), []
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    word = letter.copy()
    word[48:58] = True
    two = hits[:-1][(np.diff(hits) == 1) & (data[hits[:-1]] != 64) & (data[hits[1:]] != 64)] - 2
    two = two[two >= 0]
    two = two[letter[data[two]] & letter[data[two + 1]]]
    doc = np.searchsorted(offsets, two, "right") - 1
    use = ((offsets[doc] == two) | ~word[data[np.maximum(two - 1, 0)]]) & (two + 4 <= offsets[doc + 1])
    for at, last in zip(two[use].tolist(), offsets[doc[use] + 1].tolist()):
        end = _GROUPS.match(raw, at + 4, last).end()
        out += [m.start() for m in re.compile(rb"[^\x00-\x20]+").finditer(raw, at, end)]
    signs = np.flatnonzero((data == 58) | (data == 61))
    doc = np.searchsorted(offsets, signs, "right") - 1
    for at, first, last in zip(signs.tolist(), offsets[doc].tolist(), offsets[doc + 1].tolist()):
        if _NAMED.search(raw, max(first, at - 24), at) and (m := _VALUED.match(raw, at + 1, last)):
            out.append(m.end())
    return out


def regions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the regions: blank-separated words with a trigger or beside one, joined across blanks."""
    hits = np.flatnonzero(_TRIGGER[data])
    hits = np.union1d(hits, np.array(_beside(data, offsets, hits), np.int64))
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks = np.flatnonzero(data <= 32)
    doc = np.searchsorted(offsets, hits, "right") - 1
    at = np.searchsorted(blanks, hits)
    edges = np.concatenate([[-1], blanks, [len(data)]])
    start, end = np.maximum(edges[at] + 1, offsets[doc]), np.minimum(edges[at + 1], offsets[doc + 1])
    start, one = np.unique(start, return_index=True)
    end, doc = end[one], doc[one]
    between = np.searchsorted(blanks, start[1:]) - np.searchsorted(blanks, end[:-1])
    joined = np.concatenate([[False], (start[1:] - end[:-1] == between) & (doc[1:] == doc[:-1])])
    first = np.flatnonzero(~joined)
    return start[first], end[np.concatenate([first[1:] - 1, [len(start) - 1]])]


def _regions_of(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, text, text before) of a text's regions, in characters."""
    raw = np.frombuffer(text.encode(), np.uint8)
    a, b = regions(raw, np.array([0, len(raw)]))
    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(upto[i]), int(upto[j]), text[upto[i] : upto[j]], text[max(0, upto[i] - 40) : upto[i]]) for i, j in zip(a, b)]


def train(sentences: int = SENTENCES, epochs: int = 6, rate: float = 0.4, decay: float = 2e-4, seed: int = 1) -> Field:
    """A field fitted to generated text; the same for the same arguments."""
    made, model = Generator(seed), Field()
    data = []
    for _ in range(sentences):
        text, found = made.sentence()
        for s, e, body, before in _regions_of(text):
            r = Region(body, before)
            at = {x: k for k, x in enumerate(r.start)}
            gold = {}
            for i, j, kind in found:
                if s <= i and j <= e and i - s in at and j - s in at:
                    gold[at[i - s], at[j - s]] = TYPES.index(kind)
            spans = _spans(r)
            if all(g in set(spans) for g in gold):
                data.append((r, gold, spans, [_features(r.key(i, j)) for i, j in spans]))
    names = sorted({f for x in data for fs in x[3] for f in fs})
    index = {f: k for k, f in enumerate(names)}
    data = [(r, g, s, [np.array([index[f] for f in fs]) for fs in feats]) for r, g, s, feats in data]
    w, sw = np.zeros((len(names), len(TYPES))), np.full((len(names), len(TYPES)), 1e-2)
    m, sm = model.moves, np.full_like(model.moves, 1e-2)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for r, gold, spans, feats in data:
            size = np.array([len(f) for f in feats], int)
            flat = np.concatenate(feats) if feats else np.zeros(0, int)
            score = np.add.reduceat(w[flat], np.cumsum(size) - size, axis=0) if feats else np.zeros((0, len(TYPES)))
            _, g, d = _likelihood(r, gold, score, spans, m)
            if feats:
                rows, back = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(rows), len(TYPES)))
                np.add.at(grad, back, np.repeat(g, size, axis=0))
                grad -= decay * w[rows]
                sw[rows] += grad * grad
                w[rows] += rate * grad / np.sqrt(sw[rows])
            sm += d * d
            m += rate * d / np.sqrt(sm)
    model.weights = {f: w[k] for f, k in index.items()}
    return model


def find(model: Field, texts: pa.Array, cache: dict) -> list[tuple[int, int, int, str]]:
    """(row, start, end, type) of the entities of all texts, in characters."""
    data, offsets = T.utf8(texts)
    out = []
    for first, last in T.blocks(data, offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        a, b = regions(part, at)
        if not len(a):
            continue
        row = np.searchsorted(at, a, "right") - 1
        upto = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        for i, j, k in zip(a.tolist(), b.tolist(), row.tolist()):
            body = part[i:j].tobytes().decode("utf-8", "replace")
            before = part[max(int(at[k]), i - 40) : i].tobytes().decode("utf-8", "ignore")
            base = int(upto[i] - upto[at[k]])
            out += [(first + k, base + s, base + e, TYPES[t]) for s, e, t in decode(model, Region(body, before), cache)]
            if len(cache) > 200_000:
                cache.clear()
    return out


def personal_data(df: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", model: Field | None = None) -> DataFrame:
    """(key, start, end, kind) of every entity, characters start..end-1 of the text.

    Texts without an entity, null and empty ones give no row. Rows without key give rows with a
    null key; repeated rows give repeated results. A tie between segmentations goes to the
    earlier type and the longer span. Texts are searched whole; other columns aren't read. An
    empty table gives an empty one. One scan without a shuffle.
    """
    shared = spark.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            found = find(shared.value, b.column(1), cache)
            rows = pa.array([x[0] for x in found], pa.int64())
            yield pa.record_batch([b.column(0).take(rows), *[pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]], ["k", "s", "e", "t"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(mapped, run, f"k {kind}, s bigint, e bigint, t string")
    return out.select(F.col("k").alias(key), F.col("s").alias("start"), F.col("e").alias("end"), F.col("t").alias("kind"))
