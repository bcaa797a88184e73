"""Personal data by weak supervision.

Rule spans are found exactly; wider patterns add candidates. Four labelers (regex, gazetteer,
context, surroundings) vote on every candidate. Expectation-maximisation over the counts of
all vote patterns estimates how reliable each labeler is; its posteriors train a logistic span
classifier on the candidates' features, which decides on the candidates beyond the rules.
"""

from __future__ import annotations

import dataclasses
import hashlib
import ipaddress
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import append_result, flat, pick, position_of, positions
from skuloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "surroundings")
# a candidate beyond the rules needs this probability
ACCEPT = 0.95
# characters before a span in which context words are sought
CONTEXT_CHARS = 40

# the look-behind only skips starts inside a run of digits, where the whole run failed already
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")

_WIDE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}"
        r"(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]{1,63}){1,4}"
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone": re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,4}\)|0[0-9]{1,4}[\x20/-])[\x20().0-9-]{5,16}[0-9](?![0-9])"),
}
_TOP_DOMAINS = set("com org net edu gov info io de fr es uk it nl eu us ca au jp cn in br ru ch at be se pl".split())
_CUES = {
    "email": "mail email e-mail contact write correo courriel kontakt",
    "ip": "ip address host server client from adresse servidor",
    "card": "card visa mastercard amex credit karte carte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax telefon teléfono téléphone móvil",
}
_CUES = {kind: set(words.split()) for kind, words in _CUES.items()}
_COUNTER_CUES = set("version isbn issn id no nr page order invoice token sha md5 doi section".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("rule", T.BooleanType()),
        T.StructField("votes", T.StringType()),
        T.StructField("features", T.StringType()),
    ]
)
SPANS = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


# ---- rules -------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ signs so that a
    long run without one costs nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and not _LOCAL_END.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _digits(text: str, start: int, end: int) -> str:
    return "".join(c for c in text[start:end] if "0" <= c <= "9")


def _well_formed(kind: str, text: str, start: int, end: int) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text[start:end].split("."))
    digits = _digits(text, start, end)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def rule_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans by the rules, matches of the same patterns that fail their test)."""
    good = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    bad = []
    if re.search("[0-9]", text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            for match in pattern.finditer(text):
                span = (kind, *match.span())
                (good if _well_formed(*((kind, text) + match.span())) else bad).append(span)
    return good, bad


# ---- candidates, votes, features ---------------------------------------------------------


def candidates(text: str | None) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, by rule, vote of the regex labeler). Wide ones overlap no other."""
    if not text:
        return []
    good, bad = rule_spans(text)
    out = [(*s, True, 1) for s in good]
    taken = sorted((s, e) for _, s, e in good)
    failed = [s for s in bad if s[0] != "card" or 13 <= len(_digits(text, s[1], s[2])) <= 19]
    wide = []
    lowered = text.lower() if "at" in text or "AT" in text else ""
    if any(m in lowered for m in ("[at]", "(at)", "{at}")):
        wide += [("email", *m.span(), 0) for m in _WIDE["email"].finditer(text)]
    if text.count(":") > 6:
        wide += [("ip", *m.span(), 0) for m in _WIDE["ip"].finditer(text)]
    if good or bad or re.search("[0-9]", text):
        wide += [("phone", *m.span(), 0) for m in _WIDE["phone"].finditer(text)]
    wide += [(*s, -1 if s[0] != "card" or len(_digits(text, s[1], s[2])) > 15 else 0) for s in failed]
    for kind, start, end, vote in wide:
        if not any(s < end and start < e for s, e in taken):
            out.append((kind, start, end, False, vote))
            taken.append((start, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda c: (order[c[0]], c[1]))


def _gazetteer(kind: str, text: str) -> int:
    digits = _digits(text, 0, len(text))
    if kind == "email":
        return 1 if re.split(r"[.\x20)\]}]+", text.lower())[-1] in _TOP_DOMAINS else 0
    if kind == "card":
        issuer = digits[0] in "45" or digits[:2] in ("34", "37", "60", "62", "65")
        return (1 if issuer else 0) if luhn(digits) else -1
    if kind == "phone":
        return 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return -1 if ":" not in text else 0
    return 0 if address.is_multicast or address.is_unspecified else 1


def _context(kind: str, before: str) -> int:
    near = [w.lower() for w in _WORD.findall(before)][-4:]
    if any(w in _CUES[kind] for w in near):
        return 1
    return -1 if any(w in _COUNTER_CUES for w in near[-2:]) else 0


def _surroundings(text: str, start: int, end: int) -> int:
    edges = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    return -1 if any(c.isalnum() or c in "=_@" for c in edges) else 1


def describe(text: str, kind: str, start: int, end: int, rule: bool, regex: int) -> tuple:
    """A candidate with its votes and its features, a short code from a small set."""
    inner = text[start:end]
    context = _context(kind, text[max(0, start - CONTEXT_CHARS) : start])
    votes = (regex, _gazetteer(kind, inner), context, _surroundings(text, start, end))
    n_digits = sum("0" <= c <= "9" for c in inner)
    features = (
        kind,
        "d0" if not n_digits else f"d{min(n_digits // 4, 5)}",
        "sep" if any(c in " -()[]{}" for c in inner) else "run",
        f"c{votes[2]}",
        f"s{votes[3]}",
        "ok" if rule or (kind != "ip" and luhn(_digits(inner, 0, len(inner)) or "1")) else "no",
    )
    return kind, start, end, rule, ",".join(map(str, votes)), " ".join(features)


def _find():
    def spans(texts):
        return {"spans": [[dict(zip(SPAN.names, describe(t, *c))) for c in candidates(t)] for t in texts]}

    return spans


# ---- reliabilities and classifier --------------------------------------------------------


def estimate(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict]:
    """Posterior of each vote pattern of one kind, and the labelers' rates.

    Two classes; a labeler votes 1, 0 (no opinion) or -1 with class-dependent rates. The start
    trusts votes; pseudo-counts keep a labeler from turning around on few data.
    """
    names = list(patterns)
    votes = np.array([[int(v) for v in n.split(",")] for n in names])
    weight = np.array([patterns[n] for n in names], dtype=float)
    score = votes.sum(axis=1)
    posterior = 1 / (1 + np.exp(-2.0 * score))
    rates = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for y, p in ((1, posterior), (0, 1 - posterior)):
            for v in (-1, 0, 1):
                prior = 4.0 if v == (1 if y else -1) else 1.0
                rates[y, :, v + 1] = ((p * weight)[:, None] * (votes == v)).sum(axis=0) + prior
        rates /= rates.sum(axis=2, keepdims=True)
        share = ((posterior * weight).sum() + 1) / (weight.sum() + 2)
        log = {y: np.log(share if y else 1 - share) * np.ones(len(names)) for y in (0, 1)}
        for y in (0, 1):
            for j in range(votes.shape[1]):
                log[y] += np.log(rates[y, j, votes[:, j] + 1])
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return dict(zip(names, posterior)), {"prior": share, "rates": rates}


@dataclasses.dataclass(frozen=True)
class Classifier:
    """Logistic regression over the words of a feature code."""

    weights: dict[str, float]

    def probability(self, features: str) -> float:
        z = self.weights.get("", 0.0) + sum(self.weights.get(f, 0.0) for f in features.split(" "))
        return 1 / (1 + float(np.exp(-np.clip(z, -60, 60))))


def fit(groups: list[tuple[str, float, float]], rounds: int = 30, ridge: float = 0.1) -> Classifier:
    """Newton steps on (features, posterior, count) groups."""
    if not groups:
        return Classifier({})
    names = sorted({f for g in groups for f in g[0].split(" ")})
    place = {n: i + 1 for i, n in enumerate(names)}
    x = np.zeros((len(groups), len(names) + 1))
    x[:, 0] = 1
    for row, (features, _, _) in enumerate(groups):
        for f in features.split(" "):
            x[row, place[f]] = 1
    y = np.array([g[1] for g in groups])
    n = np.array([g[2] for g in groups], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return Classifier(dict(zip(["", *names], map(float, w))))


def train(spans: DataFrame) -> Classifier:
    """The classifier from all candidates in ``spans`` (an array column of that name).

    Only counts of (kind, votes, features) come to the driver; there are at most a few thousand
    such codes, whatever the number of documents.
    """
    counts = (
        spans.select(F.explode("spans").alias("s"))
        .groupBy("s.kind", "s.votes", "s.features")
        .count()
        .orderBy("kind", "votes", "features")
        .collect()
    )
    groups = []
    for kind in KINDS:
        own = [r for r in counts if r["kind"] == kind]
        if own:
            patterns: dict[str, int] = {}
            for r in own:
                patterns[r["votes"]] = patterns.get(r["votes"], 0) + r["count"]
            posterior, _ = estimate(patterns)
            groups += [(r["features"], posterior[r["votes"]], r["count"]) for r in own]
    return fit(groups)


def chosen(spans: list[dict], classifier: Classifier, accept: float = ACCEPT) -> list[dict]:
    """Rule spans, and the others that the classifier accepts; in their order."""
    return [
        s
        for s in spans
        if s["rule"]
        or (s["votes"].split(",")[0] != "-1" and classifier.probability(s["features"]) >= accept)
    ]


DETECTED = T.StructType(
    [
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_added", T.LongType()),
    ]
)


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def detect(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", accept: float = ACCEPT
) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (rule spans), base_sha256 of
    them, spans (all, as kind:start:end in code points) and n_added.

    Null and empty texts have no spans. Null ids and repeated rows keep a row each. Spans of one
    kind do not overlap; added ones overlap none. Every pattern is linear in the text's length.
    Further columns are ignored.
    """
    rows = pick(documents, id_column, text_column).withColumnRenamed(text_column, "_text_")
    found = append_result(rows, ["_text_"], _find, SPANS, "_result_").drop("_text_")
    # the texts are read once; what follows needs the candidates only
    found = materialize(flat(found, "_result_").withColumnRenamed("spans", "_spans_"), "pii-candidates")
    classifier = train(found.select(F.col("_spans_").alias("spans")))

    def make():
        def one(spans):
            rule = [s for s in spans if s["rule"]]
            every = chosen(spans, classifier, accept)
            return (
                *[sum(s["kind"] == k for s in rule) for k in KINDS],
                hashlib.sha256(_joined(rule).encode()).hexdigest(),
                _joined(every),
                len(every) - len(rule),
            )

        names = DETECTED.names
        return lambda column: dict(zip(names, zip(*map(one, column)))) if column else {n: [] for n in names}

    return flat(append_result(found, ["_spans_"], make, DETECTED, "_result_").drop("_spans_"), "_result_")


def masked(text: str | None, classifier: Classifier, accept: float = ACCEPT) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans as one."""
    spans = chosen([dict(zip(SPAN.names, describe(text, *c))) for c in candidates(text)], classifier, accept)
    if not spans:
        return text
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["end"])
    return "".join([*out, text[end:]])


def redact(
    documents: DataFrame, text_column: str = "text", length_column: str | None = None, accept: float = ACCEPT
) -> DataFrame:
    """``documents`` (all columns) with personal data in the text replaced.

    ``length_column`` names a column that holds the text's length, to be kept right. Null
    texts stay null; other columns are untouched.
    """
    names, plain = documents.columns, positions(documents)
    text = f"c{position_of(documents, text_column)}"
    spans = flat(append_result(plain.select(text), [text], _find, SPANS, "_result_").drop(text), "_result_")
    classifier = train(spans)

    def make():
        return lambda texts: {"text": [masked(t, classifier, accept) for t in texts]}

    schema = T.StructType([T.StructField("text", T.StringType())])
    found = append_result(plain, [text], make, schema, "_result_").withColumn(text, F.col("_result_.text"))
    if length_column is not None:
        at = f"c{position_of(documents, length_column)}"
        found = found.withColumn(at, F.char_length(text).cast(plain.schema[at].dataType))
    return found.drop("_result_").toDF(*names)
