"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds further spans."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from math import exp, log, log1p
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.llm.common import arrow_schema, pick

#: Base kinds in their listed order, and the kinds that the field adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("hidden_email", "local_phone", "national_id", "iban", "secret")
RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

# The base patterns: fixed values. A look-behind where a run begins finds the same matches without trying each place in it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            yield s, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive. No match is tried again after a failed check."""
    found = [(s, e, "email") for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


# The field. Tokens are runs of letters and digits, or single other marks; segments are runs of tokens.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
BRACKETED = re.compile(r"[\[({<](?:at|AT|At)[\])}>]")
#: Every candidate holds one of these: digits, a bracketed `at`, a run of marks of secrets. Text without them needs no reading.
TRIGGER = re.compile(f"[0-9]+|{BRACKETED.pattern}|{SECRET.pattern}")
#: Tokens and characters of a segment at most, by kind, so that the dynamic program is linear in the text. A secret has any number of characters.
BOUNDS = {"hidden_email": (16, 80), "local_phone": (9, 20), "national_id": (5, 11), "iban": (9, 42), "secret": (9, None)}
#: Characters that a candidate reaches to either side of its trigger at most (secrets lie within theirs), and that words before it are read from.
REACH, BEFORE = 80, 100
SHAPE = {
    "hidden_email": re.compile(r"[A-Za-z0-9._%+-]+\s?[\[({<](?:at|AT|At)[\])}>]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<](?:dot|DOT|Dot)[\])}>]\s?)[A-Za-z0-9-]+)+"),
    "local_phone": re.compile(r"\(?[0-9][0-9()./ -]*[0-9]"),
    "national_id": re.compile(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
}
#: Words before a span that tell of its kind: fixed values of the model's features.
CUES = {
    "secret": "token secret key apikey password passwd pwd bearer credential auth authorization access private".split(),
    "phone": "tel telephone phone call fax mobile cell dial ring".split(),
    "id": "ssn social security sin nino passport identity tax".split(),
    "bank": "iban bank account transfer konto compte cuenta bic swift".split(),
    "mail": "mail email contact write reach address".split(),
    "other": "order invoice page version isbn issn ref item no number date sku commit sha md5 hash build id price total".split(),
}
CUE = {w: k for k, ws in CUES.items() for w in ws}


def _iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and t.isascii() and t.isalnum() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def span_features(kind: str, text: str, s: int, e: int, before: list[str], known: bool) -> list[str]:
    """Features of a whole candidate segment: shape, digits, checks, entropy, what it touches, and cue words before it."""
    span = text[s:e]
    digits = sum("0" <= c <= "9" for c in span)
    out = ["bias", f"digits={min(digits, 17)}"]
    left, right = text[s - 1 : s], text[e : e + 1]
    out.append("left=" + ("edge" if not left else "space" if left.isspace() else "quote" if left in "\"'`" else "word" if left.isalnum() else "mark"))
    out.append("right=" + ("edge" if not right else "space" if right.isspace() else "quote" if right in "\"'`" else "word" if right.isalnum() else "mark"))
    if left and left in ".,-/+" or right and right in "-/" and text[e + 1 : e + 2].isalnum():
        out.append("glued")
    cues = {CUE[w] for w in before if w in CUE}
    out += [f"cue={c}" for c in sorted(cues)] or ["no cue"]
    if kind in ("local_phone", "national_id"):
        out.append("shape=" + re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), span))
    if kind == "iban":
        out.append(f"mod97={_iban(span)}")
    if kind == "secret":
        n = len(span)
        rate = -sum(span.count(c) / n * log(span.count(c) / n) for c in set(span))
        out += [f"entropy={int(rate * 2)}", f"length={min(int(log1p(n) * 3), 15)}", f"hex={bool(re.fullmatch(r'[0-9a-f]+|[0-9A-F]+', span))}", f"mixed={0 < digits < n}", "assigned=" + str(bool(re.search(r"[=:]\s*[\"'`]?$", text[max(0, s - 4) : s])))]
    if known:
        out.append("touches base")
    return [f"{kind}|{x}" for x in out]


def _regions(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Stretches of text that hold all candidates, and the runs of marks of secrets in them."""
    start = end = -1
    runs: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if m.start() - REACH > end and end >= 0:
            yield start, end, runs
            start, runs = -1, []
        if start < 0:
            start = max(0, m.start() - REACH)
        end = max(end, min(len(text), m.end() + REACH))
        if run := SECRET.match(text, _run_start(text, m.start(), max(start, runs[-1][1] if runs else start))):
            if not runs or run.start() >= runs[-1][1]:
                runs.append(run.span())
                end = max(end, min(len(text), run.end() + REACH))
    if end >= 0:
        yield start, end, runs


def _run_start(text: str, at: int, least: int) -> int:
    """Where the run of marks of secrets around `at` begins, not before `least`."""
    while at > least and text[at - 1] in SECRET_MARKS:
        at -= 1
    return at


SECRET_MARKS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-")


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, as ranges that don't overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, fixed: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of all segments of a text within bounds whose text has the kind's permissive shape and that cross nothing fixed."""
    out: list[tuple[int, int, str, list[str]]] = []
    blocked = _union(fixed)
    edges = {x for span in fixed for x in span}

    def add(kind: str, s: int, e: int) -> None:
        k = bisect_left(blocked[1], s + 1)
        if k < len(blocked[0]) and blocked[0][k] < e:
            return
        digits = sum("0" <= c <= "9" for c in text[s:e]) if kind == "local_phone" else 7
        if 7 <= digits <= 12:
            before = [m[0].lower() for m in TOKEN.finditer(text, max(0, s - BEFORE), s)][-5:]
            out.append((s, e, kind, span_features(kind, text, s, e, before, s in edges or e in edges)))

    for lo, hi, runs in _regions(text):
        tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        if tokens and lo and tokens[0][0] == lo and text[lo - 1].isalnum() and text[lo].isalnum():
            tokens.pop(0)  # begins before the region
        if tokens and hi < len(text) and tokens[-1][1] == hi and text[hi].isalnum() and text[hi - 1].isalnum():
            tokens.pop()
        ends = [e for _, e in tokens]
        at = BRACKETED.search(text, lo, hi)
        for i, (s, e) in enumerate(tokens):
            c = text[s]
            kinds = [k for k, yes in (("hidden_email", at and c in LOCAL), ("local_phone", c in "(0123456789"), ("national_id", c in "0123456789"), ("iban", "A" <= c <= "Z")) if yes]
            for kind in kinds:
                most_tokens, most_chars = BOUNDS[kind]
                m = SHAPE[kind].match(text, s, min(hi, s + most_chars))
                if m:
                    for x in ends[i : min(len(ends), i + most_tokens)]:
                        if x > m.end():
                            break
                        if SHAPE[kind].fullmatch(text, s, x):
                            add(kind, s, x)
        for a, b in runs:
            first, last = bisect_left(tokens, (a, a)), bisect_left(ends, b + 1) - 1
            for i in range(first, last + 1):
                for j in range(i, min(last + 1, i + BOUNDS["secret"][0])):
                    if ends[j] - tokens[i][0] >= 16:
                        add("secret", tokens[i][0], ends[j])
            if last - first >= BOUNDS["secret"][0]:  # a run of more tokens is a candidate as a whole
                add("secret", tokens[first][0], ends[last])
    return out


def _score(weights: dict[str, float], features: list[str]) -> float:
    return sum(weights.get(f, 0.0) for f in features)


def decode(weights: dict[str, float], lo: int, hi: int, found: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
    """The best segmentation of the places lo to hi: boundaries and kinds jointly, over tokens outside (score 0) and candidates.

    A candidate (i, j) takes the places from i to j; one that begins where the last one ends also scores "pair", whatever its sign.
    So the best score that ends with each candidate follows from the best up to before i, and from the best candidate that ends at i.
    """
    pair = weights.get("pair", 0.0)
    ends: list[int] = []  # places where a best score rises, that score, and the candidate that it ends with
    tops: list[float] = []
    whose: list[int] = []
    last_at: dict[int, int] = {}
    order = sorted(range(len(found)), key=lambda k: (found[k][1], found[k][0]))
    score = [0.0] * len(found)
    before = [-1] * len(found)
    for k in order:
        i, j, _, features = found[k]
        at = bisect_left(ends, i) - 1  # ends before i: a token lies between
        top, who = (tops[at], whose[at]) if at >= 0 else (0.0, -1)
        if (n := last_at.get(i)) is not None and score[n] + pair > top:
            top, who = score[n] + pair, n
        score[k], before[k] = top + _score(weights, features), who
        if (n := last_at.get(j)) is None or score[k] > score[n]:
            last_at[j] = k
        if score[k] > (tops[-1] if tops else 0.0):
            if ends and ends[-1] == j:
                tops[-1], whose[-1] = score[k], k
            else:
                ends.append(j)
                tops.append(score[k])
                whose.append(k)
    out, k = [], whose[-1] if whose else -1
    while k >= 0:
        out.append(found[k][:3])
        k = before[k]
    return out[::-1]


def _gradient(weights: dict[str, float], n: int, found: list, gold: set[tuple[int, int, str]]) -> dict[str, float]:
    """Gradient of the log likelihood by forward and backward sums over all segmentations of n tokens."""
    arcs = [(i, j, k, f, exp(min(30.0, _score(weights, f)))) for i, j, k, f in found]
    into: dict[int, list] = {}
    outof: dict[int, list] = {}
    for a in arcs:
        into.setdefault(a[1], []).append(a)
        outof.setdefault(a[0], []).append(a)
    pair = exp(weights.get("pair", 0.0))
    forward = [[1.0, 0.0]]
    for j in range(1, n + 1):
        forward.append([sum(forward[j - 1]), sum((forward[i][0] + pair * forward[i][1]) * w for i, _, _, _, w in into.get(j, ()))])
    backward = [[0.0, 0.0] for _ in range(n)] + [[1.0, 1.0]]
    for i in range(n - 1, -1, -1):
        stay = backward[i + 1][0]
        go = sum(w * backward[j][1] for _, j, _, _, w in outof.get(i, ()))
        backward[i] = [stay + go, stay + pair * go]
    z = sum(forward[n])
    out: dict[str, float] = {}
    for i, j, k, f, w in arcs:
        p = (forward[i][0] + pair * forward[i][1]) * w * backward[j][1] / z
        g = ((i, j, k) in gold) - p
        for x in f:
            out[x] = out.get(x, 0.0) + g
        out["pair"] = out.get("pair", 0.0) - forward[i][1] * pair * w * backward[j][1] / z
    return out


def _training(rng: Random) -> tuple[str, list[tuple[int, int, str]]]:
    """An invented sentence with labelled spans, or with decoys that look like them."""
    syllable = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    random = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def iban() -> str:
        country, body = random(2, upper), number(rng.choice([14, 16, 18, 20]))
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        plain = f"{country}{98 - rest:02d}{body}"
        return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if rng.random() < 0.5 else plain

    def secret() -> str:
        n = rng.choice([20, 24, 32, 40, 40, 64, 160])
        kinds = ["0123456789abcdef", upper + upper.lower() + "0123456789", upper + upper.lower() + "0123456789_-", upper.lower()]
        return random(1, upper.lower()) + random(n - 2, rng.choice(kinds)) + random(1, upper.lower())

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"{b}-{c}"])

    def hidden() -> str:
        at, dot = rng.choice(["[at]", "(at)", " [at] ", " (at) ", "{at}", " <at> "]), rng.choice([".", "[dot]", " [dot] ", "(dot)", " (dot) "])
        return f"{word()}{rng.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net'])}"

    made = {
        "hidden_email": lambda: (rng.choice(["", "mail ", "contact ", "write to "]), hidden()),
        "local_phone": lambda: (rng.choice(["", "", "call ", "tel ", "phone: ", "Fax ", "mobile "]), phone()),
        "national_id": lambda: (rng.choice(["", "SSN ", "ssn: ", "social security number "]), f"{number(3)}-{number(2)}-{number(4)}"),
        "iban": lambda: (rng.choice(["", "IBAN ", "IBAN: ", "bank account "]), iban()),
        "secret": lambda: (rng.choice(["token = ", "api_key: ", "secret=", "password: ", "Bearer ", "access key = ", "token=", "auth: "]), secret()),
    }
    decoys = [
        lambda: number(rng.choice([4, 5, 8, 9, 10, 12, 14, 16, 16, 17, 20])),
        lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1990, 2030)}",
        lambda: f"{number(2)}.{number(3)}.{number(3)}",
        lambda: f"order {number(3)}-{number(7)}-{number(7)}",
        lambda: f"ISBN {number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: f"{random(2, upper)}{number(2)}{number(14)}",
        lambda: f"commit {random(40, '0123456789abcdef')}",
        lambda: f"version {number(1)}.{number(2)}.{number(3)}",
        lambda: f"{number(3)} {number(3)} {number(3)}",
        lambda: f"${number(3)},{number(3)}",
        lambda: "".join(word() for _ in range(6)) + number(2),
        lambda: f"{word()}.{word()}.{word()}.{word()}.{word()}{number(1)}",
        lambda: f"sha {random(64, '0123456789abcdef')}",
        lambda: f"{number(7)}",
        lambda: "".join(word() for _ in range(5)) + "".join(word() for _ in range(4)),
        lambda: "-".join(word() for _ in range(6)),
        lambda: f"token {''.join(word() for _ in range(9))}",
        lambda: "=" * 24,
        lambda: "/".join(word() for _ in range(7)),
    ]
    text, spans = " ".join(word() for _ in range(rng.randint(2, 5))) + " ", []
    for _ in range(rng.randint(1, 2)):
        if rng.random() < 0.55:
            kind = rng.choice(ADDED)
            cue, value = made[kind]()
            mark = rng.choice(["", "", '"']) if kind == "secret" else ""
            text += cue + mark
            spans.append((len(text), len(text) + len(value), kind))
            text += value + mark
        else:
            text += rng.choice(decoys)()
        text += rng.choice([" ", ". ", ", ", "### ", " | "]) + " ".join(word() for _ in range(rng.randint(1, 4))) + " "
    return text, spans


@cache
def weights(sentences: int = 700, epochs: int = 4, rate: float = 0.4, decay: float = 1e-3, seed: int = 29) -> dict[str, float]:
    """The field's weights, learnt by Adagrad on invented sentences."""
    rng, w, seen, data = Random(seed), {}, {}, []
    for _ in range(sentences):
        text, spans = _training(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        at, to = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        gold = {(at[s], to[e], k) for s, e, k in spans if s in at and e in to}
        data.append((len(tokens), [(at[s], to[e], k, f) for s, e, k, f in candidates(text, [])], gold))
    for _ in range(epochs):
        rng.shuffle(data)
        for n, found, gold in data:
            for f, g in _gradient(w, n, found, gold).items():
                g -= decay * w.get(f, 0.0)
                seen[f] = seen.get(f, 1e-4) + g * g
                w[f] = w.get(f, 0.0) + rate * g / seen[f] ** 0.5
    return w


def added_spans(text: str, base: list[tuple[int, int, str]], w: dict[str, float]) -> list[tuple[int, int, str]]:
    """Spans that the field adds: the best segmentation of the whole text. Base spans stay and are not crossed."""
    found = candidates(text, [(s, e) for s, e, _ in base])
    if not found:
        return []
    starts, placed = {}, []
    for s, e, kind, features in found:
        at = s
        while at and text[at - 1].isspace() and s - at < BEFORE:
            at -= 1
        starts[at, e, kind] = s
        placed.append((at, e, kind, features))  # two candidates are neighbours if only white space lies between
    return [(starts[at, e, kind], e, kind) for at, e, kind in decode(w, 0, len(text), placed)]


def join(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]])))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end, code points, end exclusive) of every whole text.

    The base kinds are found by their patterns and checks. The field adds hidden e-mail addresses, phone numbers without a country
    code, national ids, bank accounts and secrets: it scores whole candidate spans and decodes boundaries and kinds jointly over the
    whole text, with spans of bounded length (secrets: up to 9 tokens of any length, or a whole run). Added spans don't overlap base ones,
    which all stay.

    Null and empty texts have no spans (the digest is that of the empty string). Texts of any length are read whole. Repeated rows and null ids
    stay rows of their own. An empty table gives an empty result. Columns beyond id and text are not read.
    """
    shared, schema = df.sparkSession.sparkContext.broadcast(weights()), arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, out = b.slice(i, 500), []
                for x in part.column(1):
                    text = x.as_py() or ""
                    base = base_spans(text)
                    counts = [sum(k == kind for _, _, k in base) for kind in BASE]
                    out.append((*counts, hashlib.sha256(join(base).encode()).hexdigest(), join(base + added_spans(text, base, w))))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    rows = pick(df, id_col, text_col).toDF("doc_id", "text")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
