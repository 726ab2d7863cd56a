"""Operator 9: personal data by high-recall span generators and gradient-boosted candidate selection.

Base kinds (email, ip, card, phone) are found by their definitions and always stay. Further generators propose overlapping
candidates: disguised emails, national phone numbers, card-like and identity numbers, IBANs, secrets. Boosted trees score
each candidate from its format (length, classes, checksums, grouping, entropy) and its context (cue words, neighbouring
characters); scores are calibrated, and each kind has the threshold that reaches PRECISION on held-out examples. Of
overlapping selected candidates the likeliest stays; those that touch a base span are dropped.

The tables hold no labels for personal data, so trees are fitted on the driver on EXAMPLES seeded synthetic candidates in
context (a documented, fixed bound), and shipped to the executors. In these, true and false candidates share formats and
contexts; held_out_quality() measures on templates and cue words that training never saw. Finding is one pass over all rows without a shuffle.

Local parts and host labels of disguised addresses are at most 64 and 63 long, as mail and name standards have it; secrets
and texts have no bound.

Defined results: a null or empty text has no spans; repeated rows have equal spans; an empty table gives no rows; other
columns are ignored by the query and kept by redact(), which puts <KIND> in place of every span.
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

from .common import table
from .gbdt import Isotonic, Trees, fit, isotonic
from .words import lean

BASE = ("email", "ip", "card", "phone")
MORE = ("email_alt", "phone_alt", "id", "iban", "secret")
EXAMPLES, PRECISION, SEED = 8000, 0.97, 3

#: The definitions of the base kinds; a digit that follows a digit starts no match the run's first didn't.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

#: Disguises of the at sign and of dots; the first look at a text follows from them as the pattern does.
AT, DOT = ("(at)", "[at]", "{at}", " at ", "@"), ("(dot)", "[dot]", "{dot}", " dot ")
ANY_AT, ANY_DOT = ("|".join(map(re.escape, forms)) for forms in (AT, DOT))

GENERATORS = {
    "email_alt": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+-]{{0,63}} ?(?:{ANY_AT}) ?[A-Za-z0-9-]{{2,63}}(?: ?(?:{ANY_DOT}) ?[A-Za-z]{{2,10}})+", re.I),
    "phone_alt": re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
    "id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?:(?<=[=:] )|(?<=[=:])|(?<=[\"']))[\"']?[A-Za-z0-9_/+-]{16,}={0,2}(?![A-Za-z0-9_/+])"),
}
CUES = {
    "email": ("mail", "contact", "write", "reach"), "phone": ("phone", "tel", "call", "fax", "mobile", "cell"), "id": ("ssn", "social", "security", "passport", "identity"),
    "iban": ("iban", "bank", "account", "transfer"), "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "bearer"), "other": ("order", "invoice", "version", "isbn", "date", "page", "price", "total", "sha", "commit", "checksum"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    digits, low = DIGIT.search(text), text.lower()
    for kind, pattern in GENERATORS.items():
        if kind in ("phone_alt", "id", "iban") and not digits:
            continue
        if kind == "email_alt" and not (any(x in low for x in DOT) and any(x in low for x in AT)):
            continue
        if kind == "secret" and "=" not in text and ":" not in text and '"' not in text and "'" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 if s.isalnum() and s.isascii() else False


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context features of a candidate."""
    s, before, after = text[a:b], text[max(0, a - 32) : a].lower(), text[b : b + 8]
    n = len(s)
    digits = NOT_DIGIT.sub("", s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    count = [s.count(c) / n for c in set(s)]
    groups = [len(g) for g in re.split(r"[ ./()-]+", s) if g]
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    return [
        *(float(kind == k) for k in MORE), n, len(digits) / n, letters / n, upper / n, -sum(p * math.log2(p) for p in count), len(groups), max(groups, default=0), min(groups, default=0), changes / n,
        float(kind == "iban" and mod97(s)), float(bool(digits) and luhn(digits)), float(len(digits)), float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:19|20)[0-9]{2}", s))),
        float(kind == "id" and (s[:3] in ("000", "666") or s[:1] == "9")), float(kind == "email_alt" and re.split(r"[^a-z]+", s.lower().rstrip(")]} "))[-1] in ENDINGS), float(any(c in s for c in "([{@_")),
        float(sum(len(x) > 2 and x.isalpha() and (x.islower() or x.istitle()) for x in re.split(r"[-_/+ ]", s)) >= 3), float(max((len(x) for x in re.findall("[a-z]+|[A-Z]+|[0-9]+", s)), default=0)),
        *(float(any(c in before for c in cues)) for cues in CUES.values()), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in "$€£"), float(after.lstrip()[:1] in "%€$"), float(before.rstrip()[-1:] in "=:"),
    ]


WORDS = "account after again always another answer around because before behind between business camera chapter children city company country course culture damage decision design different direction doctor during early effect energy evening example family father figure final forest friend future garden general ground history house idea image island issue journey kitchen language letter library little market matter meeting method minute moment morning mother mountain music nature never number office open order other paper parent people person picture place player point policy power present problem process program project public question reason record region report result river road room school science season second section service side simple small social society source south space special spring station story street student subject summer support surface system table teacher team theory thing travel value village voice water week window winter woman world writer year".split()
ENDINGS = ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk", "info")


def synthetic(rng: random.Random, held: bool = False) -> tuple[str, str, int, int, int]:
    """A candidate in context and whether it is personal data or a secret: text, kind, start, end, label.

    Formats are shared by both labels, and so are contexts: what decides is a checksum, an impossible number, or the cue
    where the format fits. With held, templates and cue words are others than those of training.
    """
    pick = lambda seen, unseen: rng.choice(unseen if held else seen)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: rng.choice(WORDS)
    kind, good = rng.choice(MORE), rng.random() < 0.5
    other = pick(["order ", "invoice ", "part no. ", "version ", "total: ", "", f"{w()} "], ["batch ", "ticket ", "build ", "price ", f"see {w()} ", "row "])
    if kind == "email_alt":
        name = rng.choice([f"{w()}.{w()}", f"{w()}{d(2)}", w(), f"{w()[0]}_{w()}", f"{w()}-{w()}"])
        if good:
            at, dot = pick([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", " dot ")], [("(at)", " dot "), (" [at] ", "[dot]"), ("{at}", "{dot}"), (" at ", "(dot)")])
            s = f"{name}{at}{w()}{dot}{rng.choice(ENDINGS)}"
            cue = pick(["contact ", "mail me: ", "", "write to ", f"{w()} "], ["reach me via ", "e-mail: ", f"by {w()}, "])
        else:  # the words, not the address
            s = f"{w()} at {rng.choice(['the', 'a', 'one', 'that', w()])} dot {rng.choice([w(), 'on', 'in', 'and', 'marks'])}"
            cue = pick(["look ", "met ", "", "write ", f"{w()} "], ["draw ", "contact ", f"the {w()} "])
    elif kind == "phone_alt":
        sep = rng.choice(" -./")
        if good or rng.random() < 0.5:  # a number's format: the cue decides
            s = pick([f"({d(3)}) {d(3)}-{d(4)}", sep.join([d(3), d(3), d(4)]), sep.join(["0" + d(1), d(2), d(2), d(2), d(2)])], [sep.join(["0" + d(2), d(3), d(4)]), f"({'0' + d(3)}) {d(4)} {d(3)}", sep.join([d(3), d(4), d(4)])])
        else:
            s = pick([f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(4)}/{d(2)}/{d(3)}", sep.join([d(2), d(3), d(2)])], [f"1{rng.randint(1, 9)}/0{rng.randint(1, 9)}/20{d(2)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)}/{d(2)}.{d(2)}"])
        cue = pick(["tel ", "call ", "phone: ", "my mobile is "], ["telephone ", "cell: ", "fax ", "called me on my phone "]) if good else other
    elif kind == "id":
        area = d(3) if good or rng.random() < 0.6 else rng.choice(["000", "666", "9" + d(2)])
        s = f"{area}-{d(2)}-{d(4)}"
        cue = pick(["ssn ", "social security: ", "ssn: "], ["his identity number ", "security no. ", "passport "]) if good or area[0] in "09" and rng.random() < 0.3 else other
        good = good and not (area in ("000", "666") or area[0] == "9")
    elif kind == "iban":
        body = rng.choice(["DE", "FR", "ES"]), d(rng.choice([18, 20, 22]) // 4 * 4)
        check = 98 - int(body[1] + "".join(str(int(c, 36)) for c in body[0]) + "00") % 97
        wrong = (check + rng.randint(1, 96)) % 97
        s = f"{body[0]}{check if good else wrong:02d}{body[1]}"
        good = good or mod97(s)
        cue = pick(["iban ", "account: ", "", "order "], ["bank: ", "transfer to ", "batch "])
    else:
        size = round(16 * 2 ** rng.uniform(0.1, 3 if rng.random() < 0.8 else 8))
        marks = pick(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"], ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"])
        random_run = "".join(rng.choice(marks) for _ in range(size))
        secret = pick(["token=", 'api_key = "', "password: ", "secret=", 'token = "', "key: "], ["auth_token=", 'passwd="', "Bearer: ", "client_secret: "])
        plain = pick(["commit: ", "checksum: ", 'sha="', "isbn: "], ["sha256=", "page: ", 'version="', "checksum="])
        if good:
            s, cue = random_run, secret
        elif rng.random() < 0.5:  # the same format behind another word
            s, cue = random_run, plain
        else:  # words behind a secret's word, or a number
            s = rng.choice(["-".join(w() for _ in range(4)), "/".join(w() for _ in range(5)), "_".join(w() for _ in range(4)), w() * 4]).ljust(17, "x")
            cue = rng.choice([secret, plain, "path: ", "see: "])
    text = " ".join(w() for _ in range(3)) + " " + cue
    return text + s + rng.choice([" ", ".", ",", '"' if cue.endswith('"') else " "]) + w(), kind, len(text), len(text) + len(s), int(good)


class Selector:
    def __init__(self, trees: Trees, scale: Isotonic, limits: dict[str, float]):
        self.trees, self.scale, self.limits = trees, scale, limits

    def __call__(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The selected candidates, none of which touch another or a base span."""
        found = candidates(text)
        if not found:
            return []
        taken: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, a, b in base):  # base spans of several kinds may overlap
            if taken and a <= taken[-1][1]:
                taken[-1] = taken[-1][0], max(b, taken[-1][1])
            else:
                taken.append((a, b))
        p = self.scale(self.trees.raw(np.array([describe(text, *c) for c in found])))
        good = sorted((-x, -(c[2] - c[1]), c[1], c) for x, c in zip(p.tolist(), found, strict=True) if x >= self.limits[c[0]])
        out: list[tuple[str, int, int]] = []
        for *_, c in good:
            k = np.searchsorted([a for a, _ in taken], c[2]) if taken else 0
            if all(b <= c[1] for _, b in taken[max(0, int(k) - 1) : int(k)]):
                out.append(c)
                taken = sorted([*taken, (c[1], c[2])])
        return sorted(out, key=lambda c: (MORE.index(c[0]), c[1]))


@lru_cache(2)
def train(examples: int = EXAMPLES, precision: float = PRECISION, seed: int = SEED) -> Selector:
    """Trees on half of the examples, calibration on a quarter, and limits on a quarter: for each kind the least limit from
    which on the share of true spans among the selected is `precision` at least. One label in 50 is turned over, so that
    scores stay short of certainty."""
    rng = random.Random(seed)
    rows = [synthetic(rng) for _ in range(examples)]
    x, y = np.array([describe(t, k, a, b) for t, k, a, b, _ in rows]), np.array([r[4] ^ (rng.random() < 0.02) for r in rows], float)
    cut, half = examples // 2, examples * 3 // 4
    trees = fit(x[:cut], y[:cut])
    raw = trees.raw(x[cut:])
    scale = isotonic(raw[: half - cut], y[cut:half])
    p, truth, kinds = scale(raw[half - cut :]), np.array([r[4] for r in rows[half:]]), np.array([r[1] for r in rows[half:]])
    limits = {}
    for kind in MORE:
        mine = kinds == kind
        reached = [t for t in np.linspace(0.02, 0.98, 97) if (hit := mine & (p >= t)).any() and truth[hit].mean() >= precision]
        limits[kind] = float(min(reached)) if reached else 0.99
    return Selector(trees, scale, limits)


def held_out_quality(select: Selector, examples: int = 3000, seed: int = 101) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on examples whose templates and cue words training never saw."""
    rng = random.Random(seed)
    rows = [synthetic(rng, held=True) for _ in range(examples)]
    p = select.scale(select.trees.raw(np.array([describe(t, k, a, b) for t, k, a, b, _ in rows])))
    out = {}
    for kind in MORE:
        mine = [(x >= select.limits[kind], r[4]) for x, r in zip(p.tolist(), rows, strict=True) if r[1] == kind]
        hit = sum(g for s, g in mine if s)
        out[kind] = hit / max(1, sum(s for s, _ in mine)), hit / max(1, sum(g for _, g in mine))
    return out


def spans(text: str, select: Selector) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, base + select(text, base)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of docs (doc_id, text)."""
    select = train()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = [], [], []
            for t in batch.column(1):
                base, every = spans(t.as_py() or "", select)
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(every))
            c = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(lists, pa.string())], [f.split()[0] for f in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), schema)


def redacted(text: str, select: Selector) -> str:
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans(text, select)[1]):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with spans in text replaced, and n_chars, where there is one, counted anew; null texts stay null."""
    select = train()
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (x := t.as_py()) is None else redacted(x, select) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if size is not None:
                columns[size] = pa.array([o if t is None else len(t) for t, o in zip(texts, columns[size].to_pylist(), strict=True)], batch.schema.types[size])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
