"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered
from .shared import Scratch, bounded_batches, text_or_empty
from .trees import Boosted, boost, sigmoid

# The base kinds in the order that breaks ties, and the kinds that only the model adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_spelled", "card_spaced", "phone_local", "ssn", "iban")
KINDS = BASE_KINDS + MORE_KINDS
#: Rows the fit sees at most, about: documents with digits or an at sign; and made-up examples of each kind.
FIT_TEXTS, FIT_MADE = 2_000, 400
#: Precision that a kind's threshold must reach on examples the trees have not seen.
PRECISION = 0.98

# The base patterns. Possessive digits and the look-behinds only save time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z0-9-]{1,63})+", re.I)
_SPACED = re.compile(r"(?<![0-9])[0-9]{4}([./_ ])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,5}[\x20./-][0-9]{2,6}(?:[\x20./-][0-9]{2,6})?(?![\w-])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")

# Words near a span that speak for or against personal data.
FOR = ("mail", "contact", "write", "tel", "phone", "call", "mobile", "fax", "card", "visa", "credit", "pay", "ssn", "social", "security", "iban", "account", "bank", "ip", "address", "host", "reach")
AGAINST = ("version", "release", "isbn", "issn", "page", "section", "figure", "table", "order", "part", "invoice", "ratio", "chapter", "date", "year", "total", "id", "build", "serial", "score")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each at sign has one candidate, its whole run of local characters."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _AT.match(text, at) if begin < at else None
        floor = found.end() if found else at + 1
        if found:
            out.append((begin, floor))
        at = text.find("@", floor)
    return out


def base_candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Matches of the base patterns, and whether each passes its check."""
    out = [("email", b, e, True) for b, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        out.append(("card", m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        out += [("phone", m.start(), m.end(), 10 <= len(_digits(m.group())) <= 15) for m in _PHONE.finditer(text)]
    return out


def more_candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """High-recall proposals beyond the base; they may overlap each other and the base."""
    out = []
    if "at" in text and ("[" in text or "(" in text):
        out += [("email_spelled", m.start(), m.end(), True) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern, check in (("card_spaced", _SPACED, lambda s: luhn(_digits(s))), ("phone_local", _LOCAL_PHONE, lambda s: 9 <= len(_digits(s)) <= 12), ("ssn", _SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9"), ("iban", _IBAN, _mod97)):
            out += [(kind, m.start(), m.end(), check(m.group())) for m in pattern.finditer(text)]
    return out


NAMES = ("kind", "length", "digits", "letters", "groups", "separators", "longest", "check", "open", "word_before", "word_after", "for", "against", "own_line", "zeros")


def features(text: str, kind: str, begin: int, end: int, check: bool) -> list[float]:
    """Format of the span and words around it."""
    span = text[begin:end]
    before, after = text[max(0, begin - 32) : begin].lower(), text[end : end + 24].lower()
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    around = set(re.findall(r"[a-z]+", before + " " + after))
    return [
        KINDS.index(kind), len(span), sum(groups), sum(c.isalpha() for c in span), len(groups),
        len(set(re.findall(r"[^0-9A-Za-z]", span))), max(groups, default=0), float(check), float(span[0] in "+("),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), len(around.intersection(FOR)), len(around.intersection(AGAINST)),
        float("\n" in before[-2:]), span.count("0") / len(span),
    ]


def made_examples(count: int, seed: int = 5) -> list[tuple[str, str, int, int, bool, int]]:
    """Examples of each further kind in telling contexts, and look-alikes in others: (text, kind, begin, end, check, label)."""
    rng = np.random.default_rng(seed)

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(2, 9)))

    def good(kind: str) -> str:
        if kind == "email_spelled":
            return f"{word()}.{word()} [at] {word()} [dot] com" if rng.random() < 0.5 else f"{word()}(at){word()}(dot)org"
        if kind == "card_spaced":
            digits = number(15)
            return re.sub(r"(.{4})(?=.)", r"\1.", digits + next(c for c in "0123456789" if luhn(digits + c)))
        if kind == "phone_local":
            return f"({number(3)}) {number(3)}-{number(4)}" if rng.random() < 0.5 else f"0{number(2)} {number(3)} {number(4)}"
        if kind == "ssn":
            return f"{rng.integers(1, 600):03d}-{number(2)}-{number(4)}"
        tail = number(18)
        return f"DE{98 - int(tail + '131400') % 97:02d}{tail}"

    def bad(kind: str) -> str:
        if kind == "email_spelled":
            return f"{word()} (at) {word()} (dot) {word()}"
        if kind == "card_spaced":
            return re.sub(r"(.{4})(?=.)", r"\1.", number(16))
        if kind == "phone_local":
            return rng.choice([f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(3)} {number(3)} {number(3)}", f"{number(2)}-{number(4)}-{number(4)}"])
        if kind == "ssn":
            return f"{number(3)}-{number(2)}-{number(4)}"
        return f"{rng.choice(['AB', 'XK', 'QR'])}{number(2)}{number(12)}"

    out = []
    for kind in MORE_KINDS:
        for i in range(count):
            label = int(i % 2)
            context = rng.choice(FOR if label else AGAINST)
            span = str(good(kind) if label else bad(kind))
            text = f"{word()} {word()} {context} {span} {word()}"
            for k, b, e, check in more_candidates(text):
                if k == kind:
                    out.append((text, k, b, e, check, label))
    return out


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn decisions into probabilities, by logistic regression towards smoothed labels."""
    yes, no = y.sum(), len(y) - y.sum()
    if not yes or not no:
        return 1.0, 0.0
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    a = np.stack([z, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(a @ w)
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - target) + 1e-3 * w)
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


class SpanModel:
    """The trees, and for each kind its calibration and threshold; a kind that cannot reach the precision is never added."""

    def __init__(self, trees: Boosted, thresholds: dict[str, float], scales: dict[str, tuple[float, float]]):
        self.trees, self.thresholds, self.scales = trees, thresholds, scales

    @classmethod
    def fit(cls, texts: list[str], made: int = FIT_MADE) -> SpanModel:
        rows, labels = [], []
        for text in texts:
            for kind, b, e, check in base_candidates(text):
                rows.append((text, kind, b, e, check))
                labels.append(int(check))
            # running text has none of these on record: what fails its own check is none, the rest is not known
            failed = [(text, *c) for c in more_candidates(text) if not c[3]]
            rows += failed
            labels += [0] * len(failed)
        for text, kind, b, e, check, label in made_examples(made):
            rows.append((text, kind, b, e, check))
            labels.append(label)
        x, y = np.array([features(*r) for r in rows]), np.array(labels, float)
        back = np.random.default_rng(11).random(len(y)) < 0.3
        trees = boost(x[~back], y[~back], trees=40, depth=4)
        z, thresholds, scales = trees.decision(x[back]), {}, {}
        for k, kind in enumerate(KINDS):  # on rows that the trees have not seen
            mine = x[back][:, 0] == k
            slope, shift = scales[kind] = calibrated(z[mine], y[back][mine])
            p = sigmoid(slope * z[mine] + shift)
            order = np.argsort(-p, kind="stable")
            hits, p = y[back][mine][order], p[order]
            precise = np.flatnonzero((np.cumsum(hits) / np.arange(1, len(hits) + 1) >= PRECISION) & np.append(p[:-1] > p[1:], True)[: len(p)])
            if len(precise):  # half way to the next one that is left out
                last = precise[-1]
                thresholds[kind] = float(p[last] + (p[last + 1] if last + 1 < len(p) else 0.0)) / 2
            else:
                thresholds[kind] = 2.0
        return cls(trees, thresholds, scales)

    def chances(self, text: str, offered: list[tuple[str, int, int, bool]]) -> np.ndarray:
        """Calibrated probability of each candidate."""
        scale = np.array([self.scales[c[0]] for c in offered])
        return sigmoid(scale[:, 0] * self.trees.decision(np.array([features(text, *c) for c in offered])) + scale[:, 1])

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans as (start, kind number, end), sorted. Added spans do not overlap chosen ones."""
        base = sorted((b, KINDS.index(k), e) for k, b, e, ok in base_candidates(text) if ok)
        offered = more_candidates(text)
        if not offered:
            return base, base
        p = self.chances(text, offered)
        chosen = list(base)
        for i in sorted(range(len(p)), key=lambda i: (offered[i][0] == "phone_local", -p[i], i)):  # the loosest pattern last
            kind, b, e, _ = offered[i]
            if p[i] >= self.thresholds[kind] and all(e <= s or b >= t for s, _, t in chosen):
                chosen.append((b, KINDS.index(kind), e))
        return base, sorted(chosen)


def fit_spans(docs: DataFrame, text_col: str = "text", texts: int = FIT_TEXTS, made: int = FIT_MADE, part: int = 4096) -> SpanModel:
    """Fits on a sample of about ``texts`` stretches of ``part`` characters, each around the first digit or at sign
    from a hashed place in its text on, or around the text's first if none follows.

    The rows are those whose hash of text and number falls under a cut-off set by their number, so no task sends
    more than its share of the sample and copies are drawn one by one.
    """
    rows = numbered(docs.select(F.col(text_col).alias("t")), Scratch(docs.sparkSession, "personal")).withColumnRenamed("rid", "r").where(F.col("t").rlike("[0-9@]"))
    some = rows.withColumn("h", F.xxhash64("t", "r"))
    share = min(1.0, texts / max(1, some.count()))
    place = F.pmod(F.xxhash64("r", "t"), F.length("t")).cast("int")
    later = F.regexp_instr(F.substring(F.col("t"), F.col("o") + 1, F.length("t")), F.lit("[0-9@]"))
    at = F.when(F.col("l") > 0, F.col("o") + F.col("l")).otherwise(F.regexp_instr("t", F.lit("[0-9@]")))
    drawn = some.where(F.shiftrightunsigned("h", 11) < F.lit(int(share * 2**53))).withColumn("o", place).withColumn("l", later)
    chosen = drawn.select("h", F.substring(F.col("t"), F.greatest(F.lit(1), at - 200), F.lit(part)).alias("t"))
    return SpanModel.fit([r["t"] for r in sorted(chosen.collect(), key=lambda r: (r["h"], r["t"]))], made)


def find_personal(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds personal data in every whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per input row. The counts
    and the digest are of the base matches, ``spans`` has the model's additions too. A null text counts as
    empty and has none; null ids and repeated rows are ordinary; an empty table gives an empty result; further
    columns are not returned.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            counts, digests, listed = [], [], []
            for value in batch.column(1):
                base, spans = model.spans(value.as_py())
                n = [0] * len(BASE_KINDS)
                for _, k, _ in base:
                    n[k] += 1
                counts.append(n)
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in base).encode()).hexdigest())
                listed.append(",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans))
            columns = [pa.array([n[k] for n in counts], pa.int64()) for k in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(listed, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str, mark: str = "[{kind}]") -> str:
    """A text with its listed spans replaced."""
    out, at = [], 0
    for kind, begin, end in (s.split(":") for s in spans.split(",") if s):
        if int(begin) >= at:
            out += [text[at : int(begin)], mark.format(kind=kind)]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal(docs, fit_spans(docs))
