"""Operator 7: personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation
estimates each labeler's reliability from all votes, and a logistic span classifier
trained on the posteriors decides which spans are added to those of the base patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored, texts, tuned

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE = KINDS[:4]

# Base patterns. A lookbehind or a reversed scan only keeps them linear on long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of candidates that the votes decide on.
_MORE = (
    ("phone", re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])00[1-9][0-9 ().-]{7,16}[0-9](?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA|ghp_|xox[bp]-|sk-)[A-Za-z0-9_-]{12,60}(?!\w)")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[\x20\"']{0,3}[=:][\x20\"']{0,3}([A-Za-z0-9+/_.-]{8,120})")),
)
_OBFUSCATED = re.compile(r"(?i)(?<![\w.])[a-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[a-z0-9-]{1,64}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[a-z0-9-]{1,64}){1,4}")
_DIGIT_OR_AT = re.compile("[0-9@]")
_ASSIGNED = re.compile(r"[=:]")

#: Words near a span that speak for or against its kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "pay", "account"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "credential"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "account", "konto"),
}
AGAINST = ("version", "license", "isbn", "chapter", "figure", "page", "commit", "doi")
#: Endings, prefixes and country codes that are known.
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "de", "fr", "es", "io", "uk", "eu", "info"),
    "secret": ("AKIA", "ASIA", "ghp_", "xoxb", "xoxp", "sk-"),
    "iban": ("AT", "BE", "CH", "DE", "ES", "FR", "GB", "IE", "IT", "LU", "NL", "PL", "PT", "SE"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base patterns, in order of start, then kind."""
    if not _DIGIT_OR_AT.search(text):
        return []
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            start = at
            while start > done and _LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def more_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further candidates; those that overlap a base span or an earlier candidate are left out."""
    found = []
    digits = _DIGIT_OR_AT.search(text) is not None
    for kind, pattern in _MORE:
        if digits or kind == "secret" and _ASSIGNED.search(text):
            found += [(*m.span(m.lastindex or 0), kind) for m in pattern.finditer(text)]
    if "dot" in text or "DOT" in text or "Dot" in text:
        found += [(*m.span(), "email") for m in _OBFUSCATED.finditer(text)]
    if not found:
        return []
    taken, out = sorted((s, e) for s, e, _ in base), []
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if all(e <= a or s >= b for a, b in taken):
            out.append((s, e, k))
            taken.append((s, e))
    return out


def votes(text: str, start: int, end: int, kind: str) -> str:
    """One of 1 (personal), 0 (not) and - (abstains) from each labeler."""
    span, before = text[start:end], text[max(0, start - 30) : start].lower()
    after = text[end : end + 20].lower()
    digits = "".join(c for c in span if c in "0123456789")
    shape = {
        "email": "@" in span or "dot" in span.lower(),
        "ip": span.count(".") == 3,
        "card": luhn(digits),
        "phone": 7 <= len(digits) <= 15,
        "secret": len(span) >= 12,
        "ssn": not span.startswith(("000", "666", "9")) and span[4:6] != "00",
        "iban": 15 <= len(span.replace(" ", "")) <= 34,
    }[kind]
    known = GAZETTEER.get(kind)
    if known is None:
        listed = "-"
    elif kind == "email":
        listed = "1" if re.split(r"[^a-z]+", span.lower().rstrip(")]"))[-1] in known else "-"
    else:
        listed = "1" if span.startswith(known) else "-"
    near = any(w in before for w in CONTEXT[kind])
    against = any(w in before or w in after for w in AGAINST)
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    varied = len(set(digits or span)) >= 4
    return "".join(("1" if shape else "0", listed, "1" if near else "-", "0" if against else "-", "1" if edge else "0", "-" if varied else "0", "1" if kind == "secret" and re.search("[0-9]", span) and re.search("[A-Za-z]", span) else "-"))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, reliabilities (labeler, true class, vote) and prior.

    patterns holds -1 for abstaining; counts weigh them, so all spans take part.
    """
    n, m = patterns.shape
    seen = patterns >= 0
    share = np.where(seen, patterns, 0).sum(1) / np.maximum(1, seen.sum(1))
    post = np.clip(share, 0.1, 0.9)
    p = np.full((m, 2, 2), 0.5)
    prior = 0.5
    for _ in range(rounds):
        for j in range(m):
            for c, w in ((0, (1 - post) * counts), (1, post * counts)):
                ones, alls = (w * (patterns[:, j] == 1)).sum(), (w * seen[:, j]).sum()
                # a few pseudo-votes that a labeler is right rather than wrong
                p[j, c, 1] = (ones + (4 if c else 1)) / (alls + 5)
                p[j, c, 0] = 1 - p[j, c, 1]
        prior = float(np.clip((post * counts).sum() / max(1, counts.sum()), 0.02, 0.98))
        logit = np.full(n, np.log(prior / (1 - prior)))
        for j in range(m):
            v = np.maximum(patterns[:, j], 0)
            logit += np.where(seen[:, j], np.log(p[j, 1, v] / p[j, 0, v]), 0)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, p, prior


def features(pattern: str) -> np.ndarray:
    kind, vote = pattern.split("|")
    x = [1.0, *(float(kind == k) for k in KINDS)]
    for v in vote:
        x += [float(v == "1"), float(v == "0")]
    return np.array(x)


def fit(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each pattern (kind|votes) under the trained span classifier."""
    if not counts:
        return {}
    names = sorted(counts)
    n = np.array([counts[k] for k in names], float)
    v = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in k.split("|")[1]] for k in names])
    post, _, _ = em(v, n)
    x = np.stack([features(k) for k in names])
    w = np.zeros(x.shape[1])
    weight = n / n.sum()
    for _ in range(60):  # Newton steps of ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - post)) + 1e-3 * w
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


_SPAN = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("pattern", pa.string())])


def candidates(docs: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """_id (if asked for) and _spans: all base and candidate spans with their votes."""
    tuned(docs.sparkSession)
    src = docs.select(*([F.col(id_col).alias("_id")] if id_col else []), F.col(text_col).cast("string").alias("_text"))
    kind = "array<struct<start:long,kind_no:int,end:long,kind:string,base:boolean,pattern:string>>"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in texts(b.column(b.num_columns - 1)):
                base = base_spans(text)
                own = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in more_spans(text, base)]
                rows.append([{"start": s, "kind_no": KINDS.index(k), "end": e, "kind": k, "base": is_base, "pattern": f"{k}|{votes(text, s, e, k)}"} for s, e, k, is_base in own])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(_SPAN))], [*b.schema.names[:-1], "_spans"])

    ddl = f"_id {src.schema['_id'].dataType.simpleString()}, " if id_col else ""
    return src.mapInArrow(run, f"{ddl}_spans {kind}")


def judged(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keeps of _spans the base spans and those that the trained classifier takes, in order.

    Vote patterns number at most kinds * 3**labelers whatever the input, so their
    counts over all spans are what the driver fits on.
    """
    rows = found.select(F.explode("_spans").alias("s")).groupBy("s.pattern").count().collect()
    scores = fit({r["pattern"]: r["count"] for r in rows})
    taken = [k for k, p in scores.items() if p >= threshold]
    keep = F.filter("_spans", lambda s: s["base"] | s["pattern"].isin(taken) if taken else s["base"])
    return found.withColumn("_spans", F.array_sort(keep))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _joined(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base and spans
    (comma-joined kind:start:end, code points, by start, then kind).

    Null and empty texts have no spans (counts 0, empty strings), long ones are read
    whole, an empty table gives no rows. Spans that begin at one place are told apart by
    kind in the order of KINDS. Repeated rows, ties of ids and null ids stay; extra columns
    are left out whatever their names. Texts are read once; spans go to the shared folder
    and votes are counted from there.
    """
    found = stored(candidates(docs, text_col, id_col), "pii")
    out = judged(found, threshold)
    base = F.filter("_spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(F.col("_id").alias(id_col), *counts, _joined(base).alias("base"), _joined(F.col("_spans")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with each found span replaced by its kind in angle brackets; overlapping spans are replaced together.

    All columns of any name and all rows stay, repeated ones and those without an id too;
    n_chars, if there, is counted anew. Null stays null, empty stays empty, long texts are
    masked whole, an empty table stays empty.
    """
    # candidates are found again for the second pass rather than all texts stored
    found = candidates(docs, text_col)
    pattern_rows = found.select(F.explode("_spans").alias("s")).groupBy("s.pattern").count().collect()
    scores = fit({r["pattern"]: r["count"] for r in pattern_rows})
    taken = {k for k, p in scores.items() if p >= threshold}

    @F.pandas_udf("string")
    def masked(text):
        def one(t):
            if not t:
                return t
            base = base_spans(t)
            spans = base + [s for s in more_spans(t, base) if f"{s[2]}|{votes(t, *s)}" in taken]
            out, at = [], 0
            for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
                if s >= at:
                    out += [t[at:s], f"<{k.upper()}>"]
                at = max(at, e)
            return "".join(out) + t[at:] if out else t

        return text.map(one, na_action="ignore")

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    out = find(docs)
    return out.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans")
