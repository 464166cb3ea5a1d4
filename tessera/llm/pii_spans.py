"""Personal data in whole texts: fixed patterns, and weak supervision beyond them.

Candidate spans (what holds an at sign, dotted or grouped digits, a plus sign
with digits, or a long token of hexadecimal or mixed characters) get votes of
labelers: patterns with their checks, gazetteers (top-level domains, cue words
of several languages) and context (what stands beside the span). Votes are
counted over all documents as patterns of votes, a table whose size depends on
the labelers only. Expectation-maximisation on it estimates how often each
labeler is right, and a logistic span classifier is trained on the posteriors
with the same evidence as features. Its spans join those of the fixed patterns,
which always stay.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, map_texts, read

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match of the plain pattern starts at the first digit of its run, and takes
# runs whole; the possessive forms say so and never step back.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S++")
LONG_TOKEN = re.compile(r"[A-Za-z0-9_\-/+=]{20,}+")

#: Gazetteers.
DOMAINS = frozenset("com org net edu gov io info biz eu de fr es uk us ch at it nl".split())
CUES = {
    "email": "mail email e-mail contact kontakt correo courriel write".split(),
    "ip": "ip host server address adresse client from login".split(),
    "card": "card visa mastercard credit karte carte tarjeta payment account iban".split(),
    "phone": "phone tel call mobile fax telefon téléphone teléfono whatsapp".split(),
    "secret": "token key secret password passwd pwd api auth bearer credential apikey".split(),
}
CUES = {k: frozenset(v) for k, v in CUES.items()}
WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
#: Votes of a labeler: for, against, none.
FOR, AGAINST, NONE = 1, -1, 0
LABELERS = ("pattern", "check", "gazetteer", "context", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += (x * 2 - 9 if x > 4 else x * 2) if i % 2 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
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


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each base kind in code points: leftmost, not overlapping, checked afterwards."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = _emails(text)
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))] if "." in text else []
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def _near(text: str, start: int, kind: str) -> bool:
    return any(w.lower() in CUES[kind] for w in WORD.findall(text[max(0, start - 40) : start])[-4:])


class _Free:
    """Whether spans, asked for by rising start, overlap none of some others: each is passed over once."""

    def __init__(self, taken: list[tuple[int, int]]):
        # Base spans of different kinds may overlap: merged, their ends rise as well.
        self.spans: list[list[int]] = []
        for s, e in sorted(taken):
            if self.spans and s <= self.spans[-1][1]:
                self.spans[-1][1] = max(self.spans[-1][1], e)
            else:
                self.spans.append([s, e])
        self.at = 0

    def __call__(self, s: int, e: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][1] <= s:
            self.at += 1
        return self.at == len(self.spans) or self.spans[self.at][0] >= e


def _around(text: str, at: int, low: int) -> tuple[int, int]:
    """What stands around a place up to white space, from low on."""
    m = TOKEN.match(text, at)
    s = at
    while s > low and not text[s - 1].isspace():
        s -= 1
    return s, m.end()


def candidates(text: str, base: dict[str, list[tuple[int, int]]]):
    """(kind, start, end, votes) of candidates beyond the base spans, and of these themselves. Linear in the text."""
    taken = []
    for kind, spans in base.items():
        for s, e in spans:
            taken.append((s, e))
            yield kind, s, e, _votes(kind, text, s, e, True)
    if "@" in text:
        at, e, free = text.find("@"), 0, _Free(taken)
        while at >= 0:
            s, e = _around(text, at, e)
            if free(s, e):
                yield "email", s, e, _votes("email", text, s, e, False)
            at = text.find("@", e)
    if DIGIT.search(text):
        free = _Free(taken)
        for m in CARD.finditer(text):
            s, e = m.span()
            if e - s >= 8 and free(s, e):
                digits = m[0].replace(" ", "").replace("-", "")
                if len(digits) >= 8:
                    kind = "card" if len(digits) >= 13 else "phone"
                    yield kind, s, e, _votes(kind, text, s, e, False)
        free = _Free(taken)
        for m in LONG_TOKEN.finditer(text):
            if free(*m.span()) and DIGIT.search(m[0]) and not m[0].isdigit():
                yield "secret", *m.span(), _votes("secret", text, *m.span(), False)


def _votes(kind: str, text: str, start: int, end: int, pattern: bool) -> tuple[int, ...]:
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before, after = text[max(0, start - 3) : start].rstrip(" "), text[end : end + 1]
    if kind == "secret":
        named = re.fullmatch(r"[0-9a-fA-F]+", span) is not None and len(span) in (32, 40, 48, 56, 64)
        pattern = named or re.match(r"(?:sk|pk|ghp|AKIA|eyJ)[-_A-Za-z0-9]", span) is not None
        check = FOR if _entropy(span) >= 3.0 else AGAINST
        shape = FOR if len(digits) >= 4 and any(c.isalpha() for c in span) else AGAINST
    elif kind == "card":
        check = FOR if 13 <= len(digits) <= 19 and luhn(digits) else AGAINST
        shape = FOR if len(set(digits)) > 3 and len(digits) <= 19 else AGAINST
    elif kind == "phone":
        check = FOR if 8 <= len(digits) <= 15 else AGAINST
        shape = FOR if len(set(span) & set(" ().-")) else NONE if span[:1] == "+" else AGAINST
    elif kind == "ip":
        check = FOR if not re.search(r"\b0[0-9]", span) else AGAINST
        shape = FOR if not span.startswith("0.") else AGAINST
    else:
        check = FOR if DOMAIN.fullmatch(span.rpartition("@")[2]) and span[:1] != "@" else AGAINST
        shape = FOR if span.count("@") == 1 and ".." not in span else AGAINST
    gazetteer = FOR if _near(text, start, kind) or kind == "email" and span.rpartition(".")[2].lower() in DOMAINS else NONE
    joined = start > 0 and text[start - 1].isalnum() or after.isalnum()
    context = AGAINST if joined else FOR if before[-1:] in ("=", ":", '"', "'", "<") and before[-1:] else NONE
    return (FOR if pattern else AGAINST), check, gazetteer, context, shape


def fit(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[str, list[float]]:
    """Weights of each kind's span classifier from counts of vote patterns.

    EM with two classes: a labeler that votes is right with a probability of
    its own in each class; abstaining says nothing. Then logistic regression on
    (for, against) of each labeler, weighted by the posteriors.
    """
    model = {}
    for kind in KINDS:
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        if not rows:
            continue
        votes, n = np.array([v for v, _ in rows], float), np.array([c for _, c in rows], float)
        post = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
        for _ in range(rounds):
            prior = np.clip((post @ n + 1) / (n.sum() + 2), 0.01, 0.99)
            logit = np.full(len(rows), math.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                for value in (FOR, AGAINST):
                    hit, said = votes[:, j] == value, votes[:, j] != NONE
                    # One vote of a labeler that is right in 4 of 5 cases as a prior.
                    mine = 0.8 if value == FOR else 0.2
                    yes = ((post * n)[hit].sum() + 5 * mine) / ((post * n)[said].sum() + 5)
                    no = (((1 - post) * n)[hit].sum() + 5 * (1 - mine)) / (((1 - post) * n)[said].sum() + 5)
                    logit[hit] += math.log(yes / no)
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        x = np.hstack([votes == FOR, votes == AGAINST, np.ones((len(rows), 1))]).astype(float)
        w, share = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(25):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ ((post - p) * share) - 1e-3 * w
            w += np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
        model[kind] = w.tolist()
    return model


def accepts(model: dict[str, list[float]], kind: str, votes: tuple[int, ...]) -> bool:
    w = model.get(kind)
    return w is not None and w[-1] + sum(w[j] if v == FOR else w[len(votes) + j] if v == AGAINST else 0.0 for j, v in enumerate(votes)) >= 0


def vote_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(kind, votes, n) over all candidates of all texts."""

    def make():
        def run(rows):
            found: dict[tuple[str, tuple[int, ...]], int] = {}
            for t in rows["text"]:
                if t:
                    for kind, _, _, votes in candidates(t, base_spans(t)):
                        found[kind, votes] = found.get((kind, votes), 0) + 1
            return {"kind": [k for k, _ in found], "votes": [list(v) for _, v in found], "n": list(found.values())}

        return run

    parts = map_rows(docs.select(F.col(text_col).alias("text")), make, "kind string, votes array<int>, n long", "text")
    return parts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, text_col: str = "text") -> dict[str, list[float]]:
    """The span classifier of docs. At most kinds x 3^labelers rows reach the driver."""
    return fit({(r.kind, tuple(r.votes)): r.n for r in vote_counts(docs, text_col=text_col).collect()})


def find_spans(text: str, model: dict[str, list[float]]):
    """All spans (kind, start, end) of a text: base ones, and those the classifier accepts."""
    base = base_spans(text)
    spans = {(k, s, e) for k, xs in base.items() for s, e in xs}
    for kind, s, e, votes in candidates(text, base):
        if (kind, s, e) not in spans and accepts(model, kind, votes):
            spans.add((kind, s, e))
    return base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: dict[str, list[float]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, base counts, base_sha256, spans, n_spans.

    A null text is empty and has no spans; ids may be null or repeat, rows stay
    apart; other columns are ignored. Time is linear in a text's length.
    """
    model = train(docs, text_col=text_col) if model is None else model

    def make():
        def run(rows):
            out = {k: [] for k in ("id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans")}
            for key, text in zip(rows["id"], rows["text"]):
                base, spans = find_spans(text or "", model)
                fixed = _joined((k, s, e) for k in BASE for s, e in base[k])
                row = (key, *(len(base[k]) for k in BASE), hashlib.sha256(fixed.encode()).hexdigest(), _joined(spans), len(spans))
                for name, x in zip(out, row):
                    out[name].append(x)
            return out

        return run

    schema = "id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string, n_spans long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, schema, "text").withColumnRenamed("id", id_col)


def mask_text(text: str, model: dict[str, list[float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for kind, s, e in sorted(find_spans(text, model)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: dict[str, list[float]] | None = None, *, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs with masked texts, all columns kept; size_col, if docs has it, is set to the new number of characters.

    Null and empty texts stay, repeated rows and ids stay apart. Without rows the
    model has no kinds.
    """
    import pyarrow as pa

    model = train(docs, text_col=text_col) if model is None else model

    def run(batch):
        i = batch.schema.get_field_index(text_col)
        texts = [None if t is None else mask_text(t, model) for t in batch.column(i).to_pylist()]
        columns = [pa.array(texts, batch.schema.field(i).type) if j == i else c for j, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = map_texts(docs, run, docs.schema, text_col)
    return out if size_col not in docs.columns else out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
