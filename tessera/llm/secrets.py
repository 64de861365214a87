"""Operator 7, secrets by a linear-chain conditional random field.

Base spans (assign, access, hex) are found by their patterns and always stay. The field tags every
token of a text as begin, inside or outside, from the shape of a token, its neighbours, the run of
glued tokens (no white space between them) that it stands in, and features of the whole file; Viterbi
decoding gives the best tagging, and its spans that overlap no base span are added with kind
``secret``. It is fitted here by stochastic gradients on EXAMPLES generated sequences of secrets and
look-alikes (digests named as such, versions, identifiers, addresses, numbers, words with marks, plain words).

Many texts are scored together, from a table of tokens (Scores), as if they stood apart. A token is outside in every
best tagging if no stretch around it can gain as much by any tags as by outside alone; Viterbi decoding runs
over the other tokens, with the same result as over the whole text. Texts of more than SEGMENT tokens are
decoded in segments that begin at white space, so that memory stays bounded.

Defined results: a null or empty text has no spans; repeated rows are searched row by row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, read, workers_import
from tessera.llm.spans import Span, apart, digest, in_order, joined, redact

KINDS = ("assign", "access", "hex", "secret")
EXAMPLES = 4000
EPOCHS = 4
#: Tokens of a text that are decoded at a time, and characters of texts that are scored together.
SEGMENT = 200_000
TOGETHER = 400_000
O, B, I = 0, 1, 2  # noqa: E741

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: A token with the white space before it; together they cover a text but for white space at its end.
_TOKEN = re.compile(r"\s*+(?:[^\W_]++|_|[^\w\s])")
#: Hexadecimal digits to h; a text without a run of them has no hex span.
_IS_HEX = bytes(104 if 48 <= i <= 57 or 97 <= i <= 102 else 32 for i in range(256))
KEYS = frozenset("password passwd passphrase pwd pw pass secret token apikey api key auth bearer credential credentials private access client login".split())
PLAIN = frozenset("sha sha1 sha256 md5 digest checksum commit hash uuid id version build file order invoice isbn etag revision tag ref".split())


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail its condition are dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if text.encode("utf-8", "replace").translate(_IS_HEX).find(b"h" * 16) >= 0:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(out, KINDS)


STARTS = ("AKIA", "ghp", "gho", "sk", "pk", "xox", "eyJ", "AIza", "glpat", "npm")


def _class(c: str) -> str:
    return "0" if c.isdigit() else c if not c.isalpha() else ("a" if c <= "z" else "é") if c.islower() else ("A" if c <= "Z" else "É") if c.isupper() else "ª"


#: Letters and digits below 256 to one of their sort.
_CLASSES = "".join(map(_class, map(chr, range(256))))


def outline(token: str) -> tuple[str, int, bool, str, str]:
    """All that features take from a token: its letters and digits by sort, how many different ones it has, if all are hexadecimal, a known beginning, its kind."""
    low = token.lower()
    kind = "key" if low in KEYS else "plain" if low in PLAIN else f"mark={token}" if len(token) == 1 and not token.isalnum() else "other"
    start = next(x for x in STARTS if token.startswith(x)) if token.startswith(STARTS) else ""
    return token.translate(_CLASSES), min(len(set(token)), 20), len(token) >= 8 and not token.strip("0123456789abcdefABCDEF"), start, kind


def shape(classes: str, different: int, hexadecimal: bool, start: str) -> tuple[str, ...]:
    n = len(classes)
    digits, upper, lower = sum(c.isdigit() for c in classes), classes.count("A"), classes.count("a")
    if n == 1 and not classes.isalnum():
        return (f"mark={classes}",)
    out = [f"long={min(n // 4, 10)}", f"mix={bool(digits)}{bool(upper)}{bool(lower)}", f"different={different // 2}", f"share={int(4 * digits / n)}"]
    if digits == n:
        out.append("number")
    elif hexadecimal:
        out.append("hexlike")
    if upper and lower and digits and n >= 16 and different >= 10:
        out.append("random")
    if classes[:1].isupper() and classes[1:].islower() or classes.islower() and not digits:
        out.append("word")
    out.append(f"turns={min(turns(classes), 6)}")
    return (*out, f"start={start}") if start else tuple(out)


def turns(classes: str) -> int:
    """Changes between letters and digits, and from lower to upper case."""
    return sum(a.isdigit() != b.isdigit() or a.islower() and b.isupper() for a, b in zip(classes, classes[1:], strict=False))


def sorts(classes: str) -> int:
    """Which sorts of characters there are: 1 digits, 2 lower case, 4 upper case, 8 a mark, 16 something else than a mark."""
    return sum(bit for bit, f in ((1, str.isdigit), (2, str.islower), (4, str.isupper)) if any(map(f, classes))) + (8 if len(classes) == 1 and not classes.isalnum() else 16)


def file_features(text: str) -> tuple[str, ...]:
    marks = sum(text.count(c) for c in "={};")
    return (f"code={min(3, int(200 * marks / max(1, len(text))))}", f"short={len(text) < 400}")


BIG = ("random", "hexlike", "word", "number", "none")
#: Upper ends of the classes of a run's length, changes and number of tokens.
LENGTHS, CHANGES, TOKENS = (3, 5, 7, 9, 11, 13, 15, 19, 23, 31, 39, 63), (0, 1, 2, 3, 5, 8, 12), (1, 2, 3, 5, 8)


def own(of: tuple[str, int, bool, str, str]) -> tuple[tuple[str, ...], str, str]:
    """Shape, kind and the largest shape of an outline."""
    shapes = shape(*of[:4])
    return shapes, of[4], next((x for x in BIG[:-1] if x in shapes), "none")


def run_features(run: list[str], key: bool, plain: bool) -> list[str]:
    """Of a run of glued tokens; key, plain: such a word is in it or among the RECENT tokens before it."""
    bits, length = 0, 0
    changes = len(run) - 1
    for x in run:
        x = outline(x.lstrip())[0]
        bits |= sorts(x)
        length += len(x)
        changes += turns(x)
    n, c, t = bisect_left(LENGTHS, length), bisect_left(CHANGES, changes), bisect_left(TOKENS, len(run))
    return [f"run={bits}:{n}", f"changes={bits}:{c}:{n // 2}", f"runkey={key}:{bits}:{n}", f"runplain={plain}:{n}", f"tokens={t}:{bits}", f"changes={c}:{n}"]


RECENT = 3


def token_features(tokens: list[str], whole: tuple[str, ...]) -> list[list[str]]:
    """Names of the features of each token; Scores takes their weights from tables."""
    cues = [own(outline(t.lstrip())) for t in tokens]
    gaps = [t[:1].isspace() for t in tokens]
    out: list[list[str]] = []
    at = 0
    while at < len(tokens):
        end = next((k for k in range(at + 1, len(tokens)) if gaps[k]), len(tokens))
        near = {x[1] for x in cues[max(0, at - RECENT) : end]}
        of_run = run_features(tokens[at:end], "key" in near, "plain" in near)
        for k in range(at, end):
            shapes, kind, big = cues[k]
            f = [*shapes, f"kind={kind}", f"gap={gaps[k]}", f"{big}&gap={gaps[k]}", f"last={k + 1 == end}", *of_run]
            f += [f"-{back}:{cues[k - back][1]}" if k >= back else f"-{back}:start" for back in (1, 2, 3, 4)]
            f.append(f"+1:{cues[k + 1][1]}" if k + 1 < len(tokens) else "+1:end")
            recent = {x[1] for x in cues[max(0, k - 5) : k]}
            f += [f"near={x}" for x in ("key", "plain") if x in recent]
            f += [f"{w}&{big}" for w in whole] + [f"key={'key' in recent}&{big}", f"plain={'plain' in recent}&{big}"]
            if k:
                f += [f"before:{s}" for s in cues[k - 1][0] if s.startswith(("long", "start", "mix"))]
            out.append(f)
        at = end
    return out


class Field:
    """Weights by feature (3 tags) and transition weights; begin and outside may follow anything, inside only begin and inside."""

    allowed = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.where(self.allowed, 0.0, -1e9)
        self.first = np.array([0.0, 0.0, -1e9])

    def scores(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(3)
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in features])

    def viterbi(self, features: list[list[str]]) -> list[int]:
        s = self.scores(features)
        best, back = self.first + s[0], []
        for row in s[1:]:
            total = best[:, None] + self.moves
            back.append(total.argmax(0))
            best = total.max(0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of tags by token, and of pairs of tags over the sequence; probabilities are scaled token by token."""
        n = len(s)
        e, m = np.exp(s - s.max(1, keepdims=True)), np.exp(self.moves)
        fore, aft = np.empty((n, 3)), np.ones((n, 3))
        fore[0] = np.exp(self.first) * e[0]
        fore[0] /= fore[0].sum()
        for k in range(1, n):
            x = fore[k - 1] @ m * e[k]
            fore[k] = x / x.sum()
        for k in range(n - 2, -1, -1):
            x = m @ (e[k + 1] * aft[k + 1])
            aft[k] = x / x.sum()
        p = fore * aft
        pairs = fore[:-1, :, None] * m[None] * (e[1:] * aft[1:])[:, None]
        return p / p.sum(1, keepdims=True), (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)

    def fit(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4, seed: int = 3) -> Field:
        rng = random.Random(seed)
        names: dict[str, int] = {}
        ids = [([names.setdefault(f, len(names)) for fs in features for f in fs], np.repeat(np.arange(len(features)), [len(fs) for fs in features])) for features, _ in data]
        weights, squares = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-6)
        move_squares = np.full((3, 3), 1e-6)
        at = [np.unique(x, return_inverse=True) + (k,) for x, k in ids]
        order = list(range(len(data)))
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                features, tags = data[i]
                touched, inverse, token = at[i]
                w = weights[touched]
                s = np.zeros((len(features), 3))
                np.add.at(s, token, w[inverse])
                p, pairs = self.marginals(s)
                g = -p
                g[np.arange(len(tags)), tags] += 1
                grad = np.zeros_like(w)
                np.add.at(grad, inverse, g[token])
                grad -= ridge * w
                squares[touched] += grad * grad
                weights[touched] = w + rate * grad / np.sqrt(squares[touched])
                g = -pairs
                np.add.at(g, (tags[:-1], tags[1:]), 1)
                move_squares += g * g
                self.moves = np.where(self.allowed, self.moves + rate * g / np.sqrt(move_squares), -1e9)
        self.weights = {f: weights[k] for f, k in names.items()}
        return self


LOWER = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LOWER + LOWER.upper() + "0123456789"


def examples(n: int, seed: int) -> list[tuple[str, int, int]]:
    """Generated (text, start, end) of a secret; start = end where there is none."""
    rng = random.Random(seed)
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    d = lambda k: of("0123456789", k)
    hexa = "0123456789abcdef"
    parts = ("er", "on", "the", "la", "ch", "en", "os", "in", "re", "tion", "é", "ña", "ü", "ss")
    word = lambda most=6: "".join(rng.choice(parts) for _ in range(rng.randint(1, most)))
    key = lambda: rng.choice(("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "client_secret", "private_key", "bearer", "pwd", "pw", "pass", "access_key", "Password", "SECRET", "API key"))
    cased = lambda x: rng.choice((str, str, str.upper, str.title))(x)
    marked = lambda: rng.choice("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~") * rng.randint(1, 3)

    def prose(k: int) -> str:
        """Words, in some texts all of them capitals or with marks behind them, some numbers among them."""
        loud, noisy = rng.random() < 0.1, rng.random() < 0.3
        out = [d(rng.randint(1, 6)) if rng.random() < 0.03 else word(4) for _ in range(k)]
        out = [x.upper() if loud else x.title() if rng.random() < 0.1 else x for x in out]
        return " ".join(x + (marked() if noisy and rng.random() < 0.6 else rng.choice((",", ".", ";")) if rng.random() < 0.1 else "") for x in out)

    def strong(k: int) -> str:
        """Letters of both cases, digits and marks."""
        out = [rng.choice(LOWER), rng.choice(LOWER.upper()), rng.choice("0123456789"), rng.choice("!#$%&*@^?+")] + [rng.choice(ALNUM + "!#$%&*@^") for _ in range(k - 4)]
        rng.shuffle(out)
        return "".join(out)

    assign = lambda: f"{key()}{rng.choice((' = ', '=', ': ', ' : ', '=\"', ': \"', ' '))}"
    told = lambda: f"{key()}{rng.choice((' = ', '=', ': ', ' : '))}"
    secrets = (
        lambda: (assign(), of(ALNUM, rng.randint(16, 44))), lambda: (assign(), of(hexa, rng.choice((18, 32, 40, 64)))), lambda: ("", "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        lambda: ("", rng.choice(("ghp_", "gho_", "npm_", "glpat-")) + of(rng.choice((ALNUM, ALNUM[:52])), 36)), lambda: ("", "sk-" + of(ALNUM, rng.choice((32, 48)))), lambda: ("", f"xoxb-{d(11)}-{of(ALNUM, 24)}"), lambda: ("", f"eyJ{of(ALNUM, 20)}.eyJ{of(ALNUM, 40)}.{of(ALNUM, 43)}"),
        lambda: ("Bearer ", of(ALNUM, 40)), lambda: ("", of(ALNUM, 38) + rng.choice(("/", "+")) + of(ALNUM, 20)), lambda: ("", "AIza" + of(ALNUM, 35)), lambda: (assign(), of(LOWER, 6) + d(4) + rng.choice("!#$") + of(ALNUM, 4)),
        lambda: (rng.choice((assign(), "Bearer ")), of(ALNUM[:52], rng.randint(20, 44))), lambda: ("", of(ALNUM[:52], rng.randint(32, 60))),
        lambda: (assign(), strong(rng.randint(8, 20))), lambda: ("", strong(rng.randint(11, 24))), lambda: (told(), of(LOWER, rng.randint(6, 8)) + d(rng.randint(1, 4)) + of(LOWER, rng.choice((0, 6))) + d(rng.randint(1, 3))),
        lambda: (told(), "".join(rng.choice(("correct", "horse", "battery", "staple", "river", "stone", "cloud", "tiger", "window", "paper", "silver", "garden")) for _ in range(3))),
        lambda: (rng.choice(("-----BEGIN PRIVATE KEY-----\n", "-----BEGIN RSA PRIVATE KEY-----\n")), of(ALNUM + "+/", 64)),
    )
    alike = (
        lambda: f"{rng.choice(('sha256', 'md5', 'commit', 'digest', 'checksum'))}{rng.choice((': ', ' ', '='))}{of(ALNUM, rng.choice((32, 40)))}", lambda: f"{of(hexa, 8)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 12)}", lambda: f"{word()}_{word()}_{rng.randint(1, 99)}",
        lambda: f"{word()}.{d(2)}@mail{rng.randint(0, 9)}.example.com", lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-rc{rng.randint(1, 4)}", lambda: d(rng.randint(4, 19)), lambda: f"http{rng.choice(('', 's'))}://{word()}.example.com/{word()}/{word()}{rng.choice(('', '?page=', '#'))}{d(rng.randint(1, 5))}",
        lambda: f"{word()}{word()}{word()}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T{of('12', 2)}:{of('0123', 2)}:00Z", lambda: f"the {key()} of {word()} and {word()}", lambda: f"{key()}: {word(3)}", lambda: f"{key()} {word(4)}",
        lambda: f"{d(2)}.{d(3)}.{d(3)}.{d(2)}", lambda: f"{word().upper()}-{d(6)}-{word()}", lambda: " ".join(d(4) for _ in range(4)), lambda: f"{d(rng.randint(1, 3))}{rng.choice('.,')}{d(3)} {rng.choice(('EUR', '€', '%'))}", lambda: f"[{word()}]({word()}/{word()}.html)",
        lambda: "".join(x.title() for x in (word(2), word(2), word(2))), lambda: f"{word(3)}{''.join(word(3).title() for _ in range(rng.randint(1, 3)))}()", lambda: f"<{word(2)} {word(2)}=\"{word(3)}-{d(2)}\">", lambda: "|".join(f" {word(2)} " for _ in range(4)), lambda: rng.choice("-=*#_~") * rng.randint(3, 40),
        lambda: word(20), lambda: prose(6), lambda: prose(8), lambda: f"[{rng.choice(('SECRET', 'ASSIGN', 'ACCESS', 'HEX'))}]",
    )
    out = []
    for _ in range(n):
        before, after = prose(rng.randint(0, 12)), prose(rng.randint(0, 12))
        before += rng.choice((" ", "\n", " ")) if before else ""
        tail = rng.choice((" ", " ", '" ', ", ", "\n", f"{marked()} "))
        if rng.random() < 0.4:
            cue, body = rng.choice(secrets)()
            if cue[-1:] not in ('"', "") and tail[0] == '"' or any(c in "!#$%&*@^+?" for c in body):
                tail = rng.choice((" ", "\n"))
            at = len(before) + len(cue)
            out.append((before + cue + body + tail + after, at, at + len(body)))
        else:
            out.append((before + cased(rng.choice(alike)()) + tail + after, 0, 0))
    return out


def tagged(text: str, start: int, end: int) -> tuple[list[list[str]], list[int]]:
    tokens = list(_TOKEN.finditer(text.rstrip()))
    begin = [m.end() - len(m[0].lstrip()) for m in tokens]
    tags = [O if m.end() <= start or b >= end else I if b > start else B for m, b in zip(tokens, begin, strict=True)]
    return token_features([m[0] for m in tokens], file_features(text)), tags


@functools.cache
def model(n: int = EXAMPLES, seed: int = 11) -> Field:
    return Field().fit([x for x in (tagged(*e) for e in examples(n, seed)) if x[0]])


class Scores(dict):
    """Token to the row of its outline in tables of weights, for scoring as Field.scores does; remembered for at most LIMIT tokens or CHARS characters."""

    LIMIT, CHARS = 300_000, 20_000_000
    APART = 5  # separating tokens between texts: an end and four starts

    def __init__(self, field: Field) -> None:
        self.weights, self.moves, self.first = field.weights, field.moves, field.first
        cues = [f.split(":", 1) for f in self.weights if re.match(r"(-[1-4]|\+1):", f)]
        self.kinds = {k: i for i, k in enumerate(dict.fromkeys(["start", "end", "unseen", *(k for _, k in cues)]))}
        self.beside = {w: np.array([self.sum([f"{w}:{k}"]) for k in self.kinds]) for w in ("-1", "-2", "-3", "-4", "+1")}
        self.files: dict[tuple[str, ...], int] = {}
        self.of_files = np.zeros((0, 20, 3))
        lengths, changes, tokens = len(LENGTHS) + 1, len(CHANGES) + 1, len(TOKENS) + 1
        self.run = np.array([[self.sum([f"run={b}:{n}"]) for n in range(lengths)] for b in range(32)])
        self.run_changes = np.array([[[self.sum([f"changes={b}:{c}:{n // 2}", f"changes={c}:{n}"]) for n in range(lengths)] for c in range(changes)] for b in range(32)])
        self.run_key = np.array([[[self.sum([f"runkey={k}:{b}:{n}"]) for n in range(lengths)] for b in range(32)] for k in (False, True)])
        self.run_plain = np.array([[self.sum([f"runplain={p}:{n}"]) for n in range(lengths)] for p in (False, True)])
        self.run_tokens = np.array([[self.sum([f"tokens={t}:{b}"]) for b in range(32)] for t in range(tokens)])
        self.last = np.array([self.sum([f"last={x}"]) for x in (False, True)])
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = 0
        self.rows: dict[tuple, int] = {}
        # own weights, those for the next token; kind, place in BIG, key, plain, gap, sorts, length, turns
        self.own, self.after, self.facts = np.zeros((1024, 3)), np.zeros((1024, 3)), np.zeros((1024, 8), np.int64)
        # rows 0 and 1 are the start and the end between texts, outside whatever stands beside them
        for i, name in enumerate(("start", "end")):
            self.rows[name,] = i
            self.own[i] = 0.0, -1e6, -1e6
            self.facts[i] = self.kinds[name], BIG.index("none"), 0, 0, 1, 0, 0, 0

    def sum(self, features: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in features if f in self.weights), np.zeros(3))

    def __missing__(self, token: str) -> int:
        bare = token.lstrip()
        gap = len(bare) < len(token)
        of = outline(bare)
        i = self.rows.get((gap, of))
        if i is None:
            i = self.rows[gap, of] = len(self.rows)
            if i == len(self.own):
                self.own, self.after, self.facts = (np.concatenate((x, np.zeros_like(x))) for x in (self.own, self.after, self.facts))
            shapes, kind, big = own(of)
            self.own[i] = self.sum([*shapes, f"kind={kind}", f"gap={gap}", f"{big}&gap={gap}"])
            self.after[i] = self.sum([f"before:{x}" for x in shapes if x.startswith(("long", "start", "mix"))])
            self.facts[i] = self.kinds.get(kind, self.kinds["unseen"]), BIG.index(big), kind == "key", kind == "plain", gap, sorts(of[0]), len(bare), turns(of[0])
        self.chars += len(token)
        self[token] = i
        return i

    def of_file(self, whole: tuple[str, ...]) -> int:
        """Place of a file's weights in of_files: by key near (0, 1), plain near and place in BIG, one after another."""
        if whole not in self.files:
            rows = [self.sum([*["near=key"] * k, *["near=plain"] * p, *(f"{w}&{b}" for w in whole), f"key={bool(k)}&{b}", f"plain={bool(p)}&{b}"]) for k in (0, 1) for p in (0, 1) for b in BIG]
            self.files[whole] = len(self.of_files)
            self.of_files = np.concatenate((self.of_files, [rows]))
        return self.files[whole]

    def score(self, texts: list[list[str]], wholes: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens of texts, APART separators before the first, between them and after the last; and the place of each text's first token."""
        if len(self) > self.LIMIT or self.chars > self.CHARS:
            self.reset()
        n = np.array([len(t) for t in texts])
        first = np.cumsum(n) - n + self.APART * np.arange(1, len(n) + 1)
        at = np.zeros(int(n.sum()) + self.APART * (len(n) + 1), np.int64)
        inside = np.ones(len(at), bool)
        stops = np.append(first - self.APART, len(at) - self.APART)
        inside[(stops[:, None] + np.arange(self.APART)).ravel()] = False
        at[stops] = 1
        at[inside] = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        kind, big, key, plain, gap, bits, length, changes = self.facts[at].T
        s = self.own[at]
        s[1:] += self.after[at[:-1]]
        ends = np.append(gap[1:] > 0, True)  # gap is 1 at the start of a text only if white space is there
        ends[first - 1] = True
        ends[stops - 1] = True
        starts = np.concatenate(([True], ends[:-1]))
        run = np.flatnonzero(starts)
        size = np.diff(np.append(run, len(at)))
        run_bits, run_length = np.bitwise_or.reduceat(bits, run), np.add.reduceat(length, run)
        near = []
        recent = []
        for x in (key, plain):
            upto = np.concatenate(([0], np.cumsum(x)))
            near.append(upto[:-1] > upto[np.maximum(np.arange(len(at)) - 5, 0)])
            recent.append((upto[run + size] > upto[np.maximum(run - RECENT, 0)]).astype(np.int64))
        ln = np.searchsorted(LENGTHS, run_length)
        ch = np.searchsorted(CHANGES, np.add.reduceat(changes, run) + size - 1)
        of_run = self.run[run_bits, ln] + self.run_changes[run_bits, ch, ln] + self.run_key[recent[0], run_bits, ln] + self.run_plain[recent[1], ln] + self.run_tokens[np.searchsorted(TOKENS, size), run_bits]
        s += np.repeat(of_run, size, axis=0) + self.last[ends.astype(np.int64)]
        for back in (1, 2, 3, 4):
            s[back:] += self.beside[f"-{back}"][kind[:-back]]
        s[:-1] += self.beside["+1"][kind[1:]]
        file = np.repeat([self.of_file(w) for w in wholes], n)
        s[inside] += self.of_files[file, (near[0] * 10 + near[1] * 5 + big)[inside]]
        s[~inside] = 0.0, -1e6, -1e6
        return s, first

    def outside(self, s: np.ndarray) -> np.ndarray:
        """Which tokens every best tagging has outside: those in no stretch of begin and inside that could score as much as outside there."""
        m = self.moves - self.moves[O, O]
        opens = s[:, B] - s[:, O] + m[O, B]
        goes_on = np.maximum(s[:, B] + max(m[B, B], m[I, B]), s[:, I] + max(m[B, I], m[I, I])) - s[:, O]
        # the first and the last token of a text may stand without a move from or to outside
        closes = min(0.0, -m[O, B]) + max(0.0, m[B, O], m[I, O])
        upto = np.cumsum(goes_on)
        return np.maximum.accumulate(opens - upto) + np.maximum.accumulate((upto + closes)[::-1])[::-1] < -1e-6 - max(0.0, -m[O, B])

    def best(self, s: np.ndarray, starts: bool, ends: bool) -> list[int]:
        """Viterbi tags of a stretch; it starts or ends a text, or has a token outside there."""
        m = self.moves.tolist()
        rows = s.tolist()
        now = [a + b for a, b in zip(self.first.tolist() if starts else m[O], rows[0], strict=True)]
        back = []
        for row in rows[1:]:
            step, new = [], []
            for t in (O, B, I):
                x, y, z = now[0] + m[0][t], now[1] + m[1][t], now[2] + m[2][t]
                p = 0 if x >= y and x >= z else 1 if y >= z else 2
                step.append(p)
                new.append((x, y, z)[p] + row[t])
            back.append(step)
            now = new
        if not ends:
            now = [v + m[t][O] for t, v in enumerate(now)]
        tags = [max((O, B, I), key=now.__getitem__)]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]


@functools.lru_cache(2)
def table(field: Field) -> Scores:
    return Scores(field)


def tag(texts: list[list[str]], wholes: list[tuple[str, ...]], field: Field) -> list[dict[int, int]]:
    """Of the tokens of each text (none empty) those with another best tag than outside: place to tag."""
    scores = table(field)
    s, first = scores.score(texts, wholes)
    found: list[dict[int, int]] = [{} for _ in texts]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], scores.outside(s), [True]))))
    for a, b in edges.reshape(-1, 2).tolist():
        k = bisect_right(first, a) - 1
        if k < 0:
            continue
        lo, hi = int(first[k]), int(first[k]) + len(texts[k])
        a, b = max(a, lo), min(b, hi)
        if a < b:
            found[k] |= {a - lo + i: t for i, t in enumerate(scores.best(s[a:b], a == lo, b == hi)) if t != O}
    return found


def _segments(tokens: list[str]) -> Iterator[list[str]]:
    """tokens in parts of about SEGMENT, each but the first beginning at white space if there is any."""
    lo = 0
    while len(tokens) - lo > SEGMENT:
        hi = next((k for k in range(lo + SEGMENT, lo + SEGMENT // 2, -1) if tokens[k][:1].isspace()), lo + SEGMENT)
        yield tokens[lo:hi]
        lo = hi
    yield tokens[lo:]


def decode(texts: list[str | None], field: Field) -> list[list[Span]]:
    """Spans that the field tags in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, int, list[str], tuple[str, ...]]] = []
    size = 0

    def flush() -> None:
        for (k, offset, tokens, _), tags in zip(held, tag([h[2] for h in held], [h[3] for h in held], field), strict=True):
            if not tags:
                continue
            ends = list(accumulate(map(len, tokens)))
            start = 0
            for i in sorted(tags):
                if tags[i] == B:
                    start = offset + ends[i] - len(tokens[i].lstrip())
                if tags.get(i + 1) != I:
                    out[k].append((start, offset + ends[i], "secret"))

    for k, text in enumerate(texts):
        tokens = _TOKEN.findall(text.rstrip()) if text else []
        if not tokens:
            continue
        whole, offset = file_features(text), 0
        for part in [tokens] if len(tokens) <= SEGMENT else _segments(tokens):
            held.append((k, offset, part, whole))
            size += len(part) * 4
            offset += sum(map(len, part)) if len(part) < len(tokens) else 0
            if size > TOGETHER:
                flush()
                held, size = [], 0
    if held:
        flush()
    return out


def find(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Of each text its base spans, and base and decoded spans together."""
    out = []
    for text, added in zip(texts, decode(texts, field), strict=True):
        base = base_spans(text) if text else []
        out.append((base, in_order(base + apart(added, base), KINDS) if added else base))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs."""
    workers_import(docs.sparkSession)
    fitted = model()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(b.column(1).to_pylist(), fitted)
            columns = [b.column(0), *(pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3])]
            columns += [pa.array([digest(base) for base, _ in found], pa.string()), pa.array([joined(spans) for _, spans in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret in its text replaced by [KIND]; all columns stay."""
    workers_import(docs.sparkSession)
    fitted = model()
    place = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            columns = list(b.columns)
            columns[place] = pa.array([t and redact(t, spans) for t, (_, spans) in zip(texts, find(texts, fitted), strict=True)], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        table.cache_clear()  # the next task has a field of its own

    return docs.mapInArrow(lean(clean), docs.schema)


def op7_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the text, n_chars follows; no document goes."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
