"""Operator 4, personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) are found by their patterns and always stay. Generators with high
recall propose further, overlapping spans: national phone numbers, spelled-out addresses, identity
and account numbers, long ip addresses. Boosted trees score each proposal from its format (groups,
digits, separators, checksums) and its context (cue words, neighbouring characters). They are fitted
here, on EXAMPLES generated examples of personal data and of look-alikes (dates, versions, amounts, order
numbers, book and part numbers); a proposal is right if it covers the data and is of its kind. A threshold per kind is calibrated on other generated examples so that at most FALSE_SHARE
of what it selects is a look-alike. Of overlapping selections the best score stays.

Text without a digit, an @ or a spelled-out at or dot cannot hold a span and is not searched further. Every
pattern runs in time linear in the text (for e-mails: from each @ outwards).

Defined results: a null or empty text has no spans; repeated rows are searched row by row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import Trees
from tessera.llm.common import read, workers_import
from tessera.llm.spans import Span, apart, digest, in_order, joined, redact

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
EXAMPLES = 8000
FALSE_SHARE = 0.01

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SOME = re.compile(r"[0-9@]|[\[(] ?(?:at|AT|At) ?[\])]| dot | DOT ")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail its condition are dropped."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        free = m.end() if m else at
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return in_order(out, KINDS)


GENERATORS: tuple[tuple[str, re.Pattern], ...] = (
    ("phone", re.compile(r"(?<![0-9.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])0[0-9]{8,11}(?![0-9])")),
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?i:at) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?i:dot) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: (?i:dot) [A-Za-z0-9]{1,32}){0,3} (?i:at) [A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,3}(?: (?i:dot) [A-Za-z0-9-]{2,63}){1,4}")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){2}[\x20./_-]{1,2}[0-9]{1,7}(?![0-9])")),
)
CUES = (
    ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono"),
    ("ssn", "social", "security", "identity", "passport", "national", "insurance", "citizen"),
    ("iban", "account", "bank", "konto", "compte", "cuenta"),
    ("mail", "email", "e-mail", "contact", "write"),
    ("card", "visa", "credit", "payment"),
    ("version", "v", "release", "order", "no", "nr", "page", "pages", "isbn", "date", "on", "since", "between", "invoice", "build", "figure", "section", "$", "€"),
)


def iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Endings of addresses that are common enough to tell.
_DOMAIN = re.compile(r"(?:\.|dot[\])]? ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu)$")


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    before = re.findall(r"[^\W_]+(?:-[^\W_]+)*|[$€]", text[max(0, start - 48) : start].lower())[-4:]
    near, after = text[start - 1 : start], text[end : end + 1]
    year = [g for g in groups if len(g) == 4 and g[:2] in ("19", "20")]
    return [
        generator, len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        len(groups[0]) if groups else 0, span.count("-"), span.count("."), span.count(" "), span.count("/"), "(" in span, digits[:1] == "0", len(year), len(set(digits)),
        bool(digits) and luhn(digits), generator == 4 and iban_valid(span), near.isalnum(), after.isalnum(), near in "$€#" and near != "", after in "%€" and after != "",
        *(sum(c in cue for c in before) for cue in CUES), len({len(g) for g in groups}) == 1, [len(g) for g in groups] == [3, 2, 4], bool(re.search(r"[\[( ]dot[\]) ]", span.lower())), bool(_DOMAIN.search(span.lower())), span.count(":"), sum(c in "abcdefABCDEF" for c in span),
        max((len(x) for x in re.split("[^0-9A-Za-z]+", span)), default=0), span.count("[") + span.count("("), digits[:3] in ("978", "979"), len(groups) > 1 and groups[0][:2] in ("19", "20") and len(groups[0]) == 4,
    ]


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of every generator, overlapping."""
    return [(m.start(), m.end(), k) for k, (_, pattern) in enumerate(GENERATORS) for m in pattern.finditer(text)]


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, bool]]:
    """Generated (text, start, end, generator, is personal data of the generator's kind)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda most=4: "".join(rng.choice(("er", "on", "the", "la", "ch", "en", "os", "in", "re", "ma", "jo", "ti")) for _ in range(rng.randint(1, most)))
    domain = lambda: rng.choice(("com", "org", "net", "de", "fr", "es", "io", "co.uk", "info"))
    local = lambda: rng.choice((word(3), f"{word(2)}.{word(3)}", f"{word(3)}{d(2)}", f"{word(2)}.{d(2)}", f"{word(1)}_{word(2)}"))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        s = d(15)
        return next(s + x for x in "0123456789" if luhn(s + x))

    def iban() -> str:
        country, body = rng.choice(("DE", "FR", "GB", "ES", "NL")), d(rng.choice((16, 18, 20)))
        return next(x for x in (f"{country}{k:02d}{body}" for k in range(2, 99)) if iban_valid(x))

    def spelled() -> str:
        at, dot = rng.choice(((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" at ", " dot "), (" AT ", " DOT ")))
        return local() + at + "".join(f"{word(3)}{dot}" for _ in range(rng.choice((1, 1, 2)))) + rng.choice(("com", "org", "net", "de", "io"))

    # maker, kind, places in CUES
    personal = (
        (lambda: f"({d(3)}) {d(3)}-{d(4)}", "phone", 0), (lambda: f"{d(3)}-{d(3)}-{d(4)}", "phone", 0), (lambda: f"{d(3)}.{d(3)}.{d(4)}", "phone", 0), (lambda: f"0{d(3)} {d(3)} {d(4)}", "phone", 0), (lambda: f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", "phone", 0), (lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", "phone", 0), (lambda: f"0{d(9)}", "phone", 0), (lambda: f"0{d(3)}/{d(4)} {d(3)}", "phone", 0), (lambda: f"00{d(2)} {d(2)} {d(4)} {d(4)}", "phone", 0),
        (spelled, "email", 3), (spelled, "email", 3), (spelled, "email", 3),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", "national_id", 1), (lambda: f"{d(3)} {d(2)} {d(4)}", "national_id", 1), (iban, "iban", 2), (lambda: " ".join(re.findall(".{1,4}", iban())), "iban", 2), (lambda: ":".join(hexa(rng.randint(1, 4)) for _ in range(8)), "ip", 5), (lambda: ":".join(hexa(4) for _ in range(8)), "ip", 5),
        (lambda: rng.choice((".", "/", "_")).join(re.findall("....", card())), "card", 4),
    )
    alike = (
        lambda: f"{rng.choice(('19', '20'))}{d(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/20{d(2)}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.choice(('19', '20'))}{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(2)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{rng.choice(('19', '20'))}{d(2)}-{rng.choice(('19', '20'))}{d(2)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"{d(1)}.{d(3)}.{d(3)},{d(2)}", lambda: f"{d(5)} {d(2)}", lambda: f"{d(2)} {d(2)}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(4)}/{d(2)}", lambda: f"{d(2)} {d(3)} {d(2)}",
        lambda: f"AB{d(2)} {d(4)} {d(4)} {d(4)}", lambda: ":".join(d(2) for _ in range(4)), lambda: ":".join(hexa(2).upper() for _ in range(6)), lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(3)}.{d(4)} {d(2)}", lambda: f"{word()} (at) {word()} . {word()}", lambda: f"{word()} at {word()} dot {word(2)} {word()}", lambda: f"look at {word()} dot {word()}", lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"{d(2)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
    )
    out = []
    while len(out) < n:
        context = [word() for _ in range(8)]
        kind = None
        if rng.random() < 0.5:
            make, kind, cue = rng.choice(personal)
            sure = kind in ("email", "iban", "ip", "card")
            if rng.random() < (0.3 if sure else 0.8):  # digits alone tell little without a word before them
                context[3] = rng.choice(CUES[cue][:8]) + rng.choice((":", "", ":")) if cue < 5 else context[3]
        else:
            make = rng.choice(alike)
            if rng.random() < 0.4:
                context[3] = rng.choice(CUES[5])
        text = " ".join([*context[:4], body := make(), *context[4:]])
        at = text.index(body, len(" ".join(context[:4])))
        for a, b, k in proposals(text):
            if a < at + len(body) and at < b:
                out.append((text, a, b, k, GENERATORS[k][0] == kind and a == at and b >= at + len(body) - 1 and b <= at + len(body)))
    return out


@functools.cache
def model(n: int = EXAMPLES, false_share: float = FALSE_SHARE) -> tuple[Trees, tuple[float, ...]]:
    """Trees, and the threshold of each generator: the lowest, from a half up, at which at most false_share of what is selected is wrong."""
    train, held = examples(n, 1), examples(n, 2)
    x = np.array([features(*e[:4]) for e in train], float)
    trees = Trees.fit(x, np.array([e[4] for e in train], float))
    score = trees.predict(np.array([features(*e[:4]) for e in held], float))
    label, generator = np.array([e[4] for e in held]), np.array([e[3] for e in held])
    cuts = []
    for k in range(len(GENERATORS)):
        of = np.flatnonzero(generator == k)
        of = of[np.argsort(-score[of], kind="stable")]
        wrong = np.cumsum(~label[of]) / np.arange(1, len(of) + 1)
        good = np.flatnonzero(wrong <= false_share)
        cuts.append(max(0.5, float(score[of][good[-1]])) if len(good) else 2.0)
    return trees, tuple(cuts)


def find(text: str | None, trees: Trees, cuts: tuple[float, ...]) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and selected spans together."""
    if not text or not _SOME.search(text):
        return [], []
    base = base_spans(text)
    proposed = proposals(text)
    if not proposed:
        return base, base
    score = trees.predict(np.array([features(text, *p) for p in proposed], float))
    best = sorted(((-s, p) for s, p in zip(score.tolist(), proposed, strict=True) if s >= cuts[p[2]]), key=lambda x: (x[0], x[1]))
    added = apart([(a, b, GENERATORS[k][0]) for _, (a, b, k) in best], base)
    return base, in_order(base + added, KINDS)


def scan(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if asked for, the redacted text of each row of docs."""
    workers_import(docs.sparkSession)
    fitted = model()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find(t, *fitted) for t in texts]
            columns = [b.column(0), *(pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4])]
            columns += [pa.array([digest(base) for base, _ in found]), pa.array([joined(spans) for _, spans in found])]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            if redacted:
                columns.append(pa.array([None if t is None else redact(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema + ", text string" * redacted)


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
