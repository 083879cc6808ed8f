"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay.  Wider patterns give candidates, such as a card number that a
base pattern lost because it ran into its neighbour.  Three labelers (shape, gazetteer, context) vote on each
candidate; expectation-maximisation estimates how reliable each labeler is for each kind, without labels; the
estimated truth trains a logistic span classifier on the spans' form, which decides on the candidates.
Spark counts how often each combination of votes and features occurs; only those counts, whose number is bounded by
the combinations there are, reach the driver.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, per_worker, texts, written

KINDS = ("email", "ip", "card", "phone")

#: The base patterns of the contract.  An address can only start where a run of digits does, which is said
#: here so that a long run is read once; emails are found from their @ in emails(), for the same reason.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Wider forms, each bounded so that it can't run into its neighbours.
WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9-])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9-])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
}
_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

#: What the gazetteer and context labelers know.
TOP_DOMAINS = "com org net edu gov info io de fr es uk eu us ca au ch nl it".split()
CARD_PREFIXES = "4 34 37 51 52 53 54 55 6011 65 35 36 38".split()
COUNTRY_CODES = "1 33 34 39 41 44 49 61 81 86 91 972".split()
CUES = {
    "email": "mail email e-mail contact write address".split(),
    "ip": "ip host server address login from".split(),
    "card": "card visa mastercard amex credit payment pay".split(),
    "phone": "phone tel call mobile fax telephone number".split(),
}
COUNTER_CUES = "version isbn issn order invoice sku part serial section chapter example test".split()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(s)) <= 15
    return True


def emails(text: str):
    """(start, end) of the leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ that don't overlap.

    The part before an @ holds none, so it is the whole run of its characters between the last @, or the last match,
    and this one; each character of the text is looked at a bounded number of times.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        run = _LOCAL.match(text[free:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if run else None
        if domain:
            yield at - run, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that don't overlap; matches that fail their test are dropped, not tried again."""
    out = []
    has_digit = _DIGIT.search(text) is not None
    for kind in KINDS:
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text) or (kind != "email" and not has_digit):
            continue
        if kind == "email":
            out += [(kind, a, b) for a, b in emails(text)]
        else:
            out += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if valid(kind, m[0])]
    return out


def votes(kind: str, s: str, text: str, start: int, end: int) -> tuple[int, int, int]:
    """Of the shape, gazetteer and context labelers: 1 for, -1 against, 0 for no opinion."""
    shape = 1 if valid(kind, s) and (kind != "phone" or s.startswith(("+", "("))) else -1 if not valid(kind, s) else 0
    d = digits_of(s)
    if kind == "email":
        known = s.rsplit(".", 1)[-1].strip("()[] ").lower() in TOP_DOMAINS
    elif kind == "ip":
        known = 1 <= int(s.split(".")[0][:4]) <= 223 and not s.startswith(("127.", "0."))
    elif kind == "card":
        known = d.startswith(tuple(CARD_PREFIXES)) and len(set(d)) > 3
    else:
        known = s.startswith("+") and d.startswith(tuple(COUNTRY_CODES)) or len(d) == 10
    near = set(re.findall(r"[a-z-]+", (text[max(0, start - 40) : start] + " " + text[end : end + 25]).lower()))
    context = 1 if near & set(CUES[kind]) else -1 if near & set(COUNTER_CUES) else 0
    return shape, 1 if known else -1, context


#: What the classifier sees of a span, apart from its kind.
FEATURES = ("free_left", "free_right", "plus", "bracket", "separated", "long", "many_digits", "valid", "lost_by_base")


def features(kind: str, s: str, text: str, start: int, end: int, lost: bool) -> int:
    left, right = text[start - 1 : start], text[end : end + 1]
    seen = (
        not left.isalnum(),
        not right.isalnum(),
        s.startswith("+"),
        "(" in s or "[" in s,
        any(c in s for c in " -"),
        len(s) > 16,
        len(digits_of(s)) > 11,
        valid(kind, s),
        lost,
    )
    return sum(1 << i for i, x in enumerate(seen) if x)


class Taken:
    """The parts of a text that spans take, as sorted intervals that don't meet."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add_if_free(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.starts, a)
        if (k and self.ends[k - 1] > a) or (k < len(self.starts) and self.starts[k] < b):
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int, bool]]:
    """(kind, start, end, votes as a number 0..26, features, in base) for base spans and for wider matches beside them."""
    found = [(kind, a, b, True) for kind, a, b in base]
    taken = Taken([(a, b) for _, a, b in base])
    low = text.lower() if "(" in text or "[" in text else ""
    has_digit = _DIGIT.search(text) is not None
    for kind in KINDS:
        if (kind == "email" and "(at)" not in low and "[at]" not in low) or (kind != "email" and not has_digit):
            continue
        for m in WIDE[kind].finditer(text):
            if taken.add_if_free(*m.span()):
                found.append((kind, m.start(), m.end(), False))
    out = []
    for kind, a, b, is_base in found:
        s = text[a:b]
        v = votes(kind, s, text, a, b)
        out.append((kind, a, b, sum((x + 1) * 3**i for i, x in enumerate(v)), features(kind, s, text, a, b, not is_base), is_base))
    return out


# ----------------------------------------------------------------------------- the models, from counts (driver)


def labeler_reliability(counts: dict[int, float], rounds: int = 60) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over vote patterns (0..26) with counts.

    Returns the share of true spans, P(vote | truth) as [labeler, truth, vote], and P(true | pattern).
    """
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    vote = np.stack([patterns // 3**i % 3 for i in range(3)], axis=1)
    true = np.clip(0.5 + 0.15 * (vote - 1).sum(1), 0.05, 0.95)
    table = np.zeros((3, 2, 3))
    share = 0.5
    for _ in range(rounds):
        share = float((weight * true).sum() + 1) / float(weight.sum() + 2)
        for i in range(3):
            for v in range(3):
                at = vote[:, i] == v
                table[i, 1, v] = (weight * true)[at].sum() + (1.0 if v == 2 else 0.1)
                table[i, 0, v] = (weight * (1 - true))[at].sum() + (1.0 if v == 0 else 0.1)
        table /= table.sum(2, keepdims=True)
        yes = np.log(share) + sum(np.log(table[i, 1, vote[:, i]]) for i in range(3))
        no = np.log(1 - share) + sum(np.log(table[i, 0, vote[:, i]]) for i in range(3))
        true = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
    return share, table, dict(zip(patterns.tolist(), true.tolist(), strict=True))


def feature_row(kind: str, bits: int, vote: int) -> np.ndarray:
    """Kind, form, and the labelers' votes (-1, 0, 1) for that kind."""
    votes = [float(vote // 3**i % 3) - 1.0 for i in range(3)]
    x = [1.0, *(float(kind == k) for k in KINDS), *(float(bits >> i & 1) for i in range(len(FEATURES)))]
    return np.array(x + [v * (kind == k) for k in KINDS for v in votes])


def fit_classifier(rows: list[tuple[str, int, int, float, float]], ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps on (kind, features, votes, P(true), count)."""
    if not rows:
        return np.zeros(len(feature_row(KINDS[0], 0, 0)))
    x = np.stack([feature_row(kind, bits, vote) for kind, bits, vote, _, _ in rows])
    y, w = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return beta


def train(found: DataFrame, reliable: float = 0.5) -> set[tuple[str, int, int]]:
    """The (kind, votes, features) that the span classifier accepts, from the candidates in the column `found`."""
    each = found.select(F.explode("found").alias("c"))
    each = each.groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    counts = [(r["kind"], r["votes"], r["features"], float(r["n"])) for r in each.collect()]
    by_kind: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for kind, vote, _, n in counts:
        by_kind[kind][vote] += n
    truth = {kind: labeler_reliability(dict(patterns))[2] for kind, patterns in by_kind.items()}
    beta = fit_classifier([(kind, bits, vote, truth[kind][vote], n) for kind, vote, bits, n in counts])
    return {
        (kind, vote, bits)
        for kind, vote, bits, _ in counts
        if 1 / (1 + np.exp(-feature_row(kind, bits, vote) @ beta)) >= reliable
    }


# -------------------------------------------------------------------------------------------------- Spark job


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {kind: i for i, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


_FOUND = "array<struct<kind:string,start:int,stop:int,votes:int,features:int,base:boolean>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, a row per row of docs.

    The counts and base_sha256 are of the base spans; spans holds those and the accepted candidates, as
    kind:start:end by kind, then start.  Null text is the empty text, with zero counts and an empty string; a kind
    without candidates is left out of training; repeated rows each count; an empty table gives no rows; other
    columns are ignored.  Texts are read whole and once.
    """

    @F.pandas_udf(_FOUND)
    def find(text: pd.Series) -> pd.Series:
        names = ("kind", "start", "stop", "votes", "features", "base")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in candidates(t, base_spans(t))] for t in text])

    found = written(texts(docs).select("doc_id", find("text").alias("found")), "pii-candidates")
    accepted, tag = found.sparkSession.sparkContext.broadcast(train(found)), uuid.uuid4().hex

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def decide(column: pd.Series) -> pd.DataFrame:
        good = per_worker(("pii", tag), lambda: accepted.value)
        rows = []
        for each in column:
            base = [(c["kind"], c["start"], c["stop"]) for c in each if c["base"]]
            more = [(c["kind"], c["start"], c["stop"]) for c in each if not c["base"] and (c["kind"], c["votes"], c["features"]) in good]
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    out = found.withColumn("d", decide("found")).select("doc_id", "d.*")
    result = written(out, "pii")
    dropped(found)
    return result
