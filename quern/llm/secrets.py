"""Secret scans: three base patterns, and a battery of randomness tests for strings that no pattern names.

Candidates are long runs of key characters, cut at inner '=' and, if need be, at signs. The encoding is inferred from the
characters a run uses, and three tests look at it as draws from that encoding: chi-squared uniformity over the alphabet (in
cells wide enough for the run's length), runs, and the serial correlation of neighbours. Each test answers twice. Its
p-value under random draws refuses a run that isn't random. Its likelihood ratio, of written text over random draws, for
what the test looks at (symbol counts, how kinds of characters follow in runs, neighbours) is the evidence that the run
isn't text. The ratios are factors of one likelihood, so their product bounds the run's chance under text: that is its
p-value. Benjamini and Hochberg's step-up over all candidates of the document, with weights that favour long runs, keeps
those whose chance is low. So the three tests refuse, and what they look at, as ratios, decides. Candidates of fewer than
MIN_LENGTH characters are not tested.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans and the digest of
empty input; equal texts give equal spans; an added span that overlaps a base span is left out; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import map_batches, table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What lies between inner '='; padding stays with what ends a run.
_FIELD = re.compile(r"[^=]+(?:=+\Z)?")
#: Runs without the signs that one of the two alphabets of 64 lacks, and without any sign.
_PARTS = tuple(map(re.compile, (r"[^+/]+", r"[^_-]+", r"[^+/_-]+")))
#: A number of 32 hexadecimal digits in groups; its dashes are no draws, and go before it is tested.
_GROUPED = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
#: Characters that a run, its padding not counted, has at least: under that, three tests tell little.
MIN_LENGTH = 20
PASS = 0.001
FDR = 0.01
REFERENCE_LENGTH = 40

HEX_LOWER = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALNUM_UPPER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM_LOWER = "0123456789abcdefghijklmnopqrstuvwxyz"
ALNUM = ALNUM_UPPER + "abcdefghijklmnopqrstuvwxyz"
BASE64 = ALNUM + "+/"
BASE64_URL = ALNUM + "-_"
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX_MIXED = DIGITS + "ABCDEFabcdef"
ENCODINGS = (("digits", DIGITS), ("hex", HEX_LOWER), ("hex", HEX_LOWER.upper()), ("hex", HEX_MIXED), ("letters", LOWER), ("letters", LOWER.upper()), ("base32", BASE32), ("alnum", ALNUM_UPPER), ("alnum", ALNUM_LOWER), ("letters", LOWER.upper() + LOWER), ("alnum", ALNUM), ("base64", BASE64), ("base64url", BASE64_URL))
_SETS = tuple((name, alphabet, frozenset(alphabet)) for name, alphabet in ENCODINGS)


def infer(run: str) -> str | None:
    """The smallest alphabet that holds all characters of a run, without its padding."""
    used = set(run.rstrip("="))
    for _, alphabet, held in _SETS:
        if used <= held:
            return alphabet
    return None


def chi_squared_sf(x: float, k: int) -> float:
    """Chance of at least x under chi-squared with k degrees of freedom (Wilson and Hilferty)."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(codes: list[int], size: int) -> tuple[float, float, int]:
    """p, the statistic, and the cells: the alphabet in its order, cut so that each expects 4 or more symbols."""
    cells = max(2, min(size, len(codes) // 4))
    counts = [0] * cells
    for c in codes:
        counts[c * cells // size] += 1
    n = len(codes)
    shares = [0] * cells
    for c in range(size):
        shares[c * cells // size] += 1
    x = sum((o - n * s / size) ** 2 / (n * s / size) for o, s in zip(counts, shares, strict=True))
    return chi_squared_sf(x, cells - 1), x, cells


def runs(codes: list[int], size: int) -> float:
    """Wald and Wolfowitz's test around the middle of the alphabet."""
    high = [2 * c >= size for c in codes]
    n1 = sum(high)
    n2 = len(high) - n1
    if not n1 or not n2:
        return 2.0 ** (1 - len(high))
    n = n1 + n2
    seen = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((seen - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(codes: list[int]) -> float:
    """Correlation of neighbours at lag 1, near normal with mean -1/n and variance 1/n for random draws."""
    n = len(codes)
    mean = sum(codes) / n
    var = sum((c - mean) ** 2 for c in codes)
    if not var:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / var
    return two_sided((r + 1 / n) * math.sqrt(n))


#: Letters in a thousand of written English, German, French and Spanish, about.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (85, 17, 30, 42, 140, 16, 20, 40, 72, 4, 9, 45, 28, 78, 65, 25, 6, 66, 70, 72, 45, 11, 12, 3, 10, 7), strict=True))
VOWELS = "aeiouy"
#: Chance that text goes on with a character of another kind (lower, upper, digit, sign).
CHANGE = 0.125
_TOTAL = sum(LETTERS.values())
_VOWEL = sum(LETTERS[c] for c in VOWELS) / _TOTAL
#: Chance of a vowel after a vowel and after a consonant.
_AFTER = {"v": 0.25, "c": 0.6}
#: Numbers that people write: round, with digits that repeat or go up and down by one.
_DIGITS = {c: {"0": 0.25, "1": 0.15}.get(c, 0.075) for c in DIGITS}
SAME, STEP = 0.3, 0.25


def _kind(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"


def _digit_ratios(run: str) -> tuple[float, float, float]:
    symbols = sum(math.log(10 * _DIGITS[c]) for c in run)
    pairs = 0.0
    for a, b in zip(run, run[1:], strict=False):
        ways = 1 if a in "09" else 2
        pairs += math.log(1 - SAME - STEP + (SAME * (a == b) + STEP / ways * (abs(int(a) - int(b)) == 1)) / _DIGITS[b])
    return symbols, 0.0, pairs


def text_ratios(run: str, alphabet: str) -> tuple[float, float, float]:
    """Logarithms of the likelihood as written text over that as uniform draws, for what each of the tests looks at.

    Uniformity: letters come with their frequencies within their kind; other characters are uniform in text too. Runs: text
    changes the kind of character with a chance of an eighth, and which other kind comes, the first character and staying
    within a kind are free, which favours text. Serial correlation: vowels and consonants take turns, also from a capital
    to a small letter. Runs of digits alone have a model of their own.
    """
    if alphabet == DIGITS:
        return _digit_ratios(run)
    sizes: dict[str, int] = {}
    for c in alphabet:
        sizes[_kind(c)] = sizes.get(_kind(c), 0) + 1
    symbols = kinds = pairs = 0.0
    before = last = None
    for c in run:
        own = _kind(c)
        kinds -= math.log(sizes[own] / len(alphabet))
        if last not in (None, own):
            kinds += math.log(CHANGE)
            if {own, last} != {"u", "l"}:
                before = None
        last = own
        if own in "ul":
            low = c.lower()
            vowel = low in VOWELS
            symbols += math.log(LETTERS[low] / _TOTAL * sizes[own])
            if before:
                pairs += math.log(_AFTER[before] / _VOWEL if vowel else (1 - _AFTER[before]) / (1 - _VOWEL))
            before = "v" if vowel else "c"
        else:
            symbols += math.log(sizes[own] / (10 if own == "d" else 2))
    return symbols, kinds, pairs


def battery(run: str) -> float | None:
    """The p-value under text of a run that passes as random: a bound of the chance that text is so much likelier as random
    draws (Markov's inequality for the product of the tests' ratios), at any length. None if a test refuses the run."""
    alphabet = infer(run)
    if alphabet is None:
        return None
    body = run.rstrip("=")
    if len(body) < MIN_LENGTH:
        return None
    place = {c: k for k, c in enumerate(alphabet)}
    codes = [place[c] for c in body]
    if min(uniformity(codes, len(alphabet))[0], runs(codes, len(alphabet)), serial(codes)) < PASS:
        return None
    return math.exp(min(0.0, sum(text_ratios(body, alphabet))))


def tested(run: str) -> list[tuple[int, int, float | None]]:
    """(start, end, chance or None) of what is tested in a run of key characters: each field between inner '='.

    A field that no encoding holds, or that a test refuses, is cut at the signs of either alphabet of 64, and at both: a key
    may stand in a path or after a name. Parts that overlap are tests of their own; a part as long as the field isn't. Hexadecimal digits
    in groups, as the whole field or in it, are tested without their dashes."""
    out: list[tuple[int, int, float | None]] = []
    for m in _FIELD.finditer(run):
        if len(m[0]) < MIN_LENGTH:
            continue
        grouped = [(m.start() + x.start(), m.start() + x.end()) for x in _GROUPED.finditer(m[0])] if m[0].count("-") >= 4 else []
        chance = None if grouped else battery(m[0])
        if chance is None:
            parts = {(m.start() + x.start(), m.start() + x.end()) for p in _PARTS for x in p.finditer(m[0]) if MIN_LENGTH <= len(x[0]) < len(m[0])}
            parts -= {(a, b) for a, b in parts if any(a < d and c < b for c, d in grouped)}
            if grouped or parts:
                out += sorted([(a, b, battery(run[a:b].replace("-", ""))) for a, b in grouped] + [(a, b, battery(run[a:b])) for a, b in parts])
                continue
        out.append((m.start(), m.end(), chance))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def accepted(candidates: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Step-up over (start, end, chance): weights grow with length and have mean 1."""
    if not candidates:
        return []
    raw = [math.sqrt((e - s) / REFERENCE_LENGTH) for s, e, _ in candidates]
    mean = sum(raw) / len(raw)
    ranked = sorted((p / (w / mean), s, e) for (s, e, p), w in zip(candidates, raw, strict=True))
    last = max((k for k, (q, _, _) in enumerate(ranked, 1) if q <= FDR * k / len(ranked)), default=0)
    return sorted((s, e) for _, s, e in ranked[:last])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with what the battery adds."""
    base = base_spans(text) if text else []
    if not text or max(map(len, text.split()), default=0) < MIN_LENGTH:
        return base, base
    passed = []
    refused = 0
    for m in _CANDIDATE.finditer(text):
        if m.end() - m.start() >= MIN_LENGTH:
            for a, b, p in tested(m[0]):
                if p is None:
                    refused += 1
                else:
                    passed.append((m.start() + a, m.start() + b, p))
    # Refused candidates count among the tests, at a chance of 1.
    found = merged(accepted(passed + [(0, MIN_LENGTH, 1.0)] * refused))
    added, k, reach = [], 0, 0
    for s, e in found:
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            added.append((s, 3, e))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind of the base, the base's digest and all spans, of every whole text."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column("text").to_pylist():
            base, spans = all_spans(text or "")
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        yield {"doc_id": batch.column("doc_id"), **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` masked and ``n_chars`` counted anew; all rows and columns stay."""

    def run(batch):
        cols = {name: batch.column(name) for name in batch.schema.names}
        texts = batch.column("text").to_pylist()
        cols["text"] = new = [t and mask(t, all_spans(t)[1]) for t in texts]
        if "n_chars" in cols:
            cols["n_chars"] = [n if a is b or a == b else len(b) for n, a, b in zip(cols["n_chars"].to_pylist(), texts, new, strict=True)]
        yield cols

    return map_batches(docs, run, docs.schema)


def op8_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
