"""Personal data by weak supervision, in DataFrame operations only.

Base patterns give spans that always stay.  Wider candidate patterns (e-mail addresses spelt out, telephone
numbers without a plus sign) give further candidates.  Regex, gazetteer and context labelers vote on every
candidate: for (1), against (-1) or not at all (0).  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind; the posteriors it gives train a logistic span
classifier, and candidates that it finds likely are added where they overlap no base span.

There are at most KINDS x 3**LABELERS vote patterns, so the counts are all that leaves Spark for the fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
ADD_AT = 0.9              # probability from which a candidate is added

# The base patterns, with the backtracking that cannot change a match taken out (possessive quantifiers,
# starts only where a run starts), so that runs of any length take linear time and no deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+)(.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GUARD = {"email": "@", "ip": ".", "phone": "+"}

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "au"]
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62)"
CUES = {"email": r"(?i)(?:e-?mail|contact|write|mailto|courriel|correo)\W{0,4}(?:\w+\W){0,2}$",
        "ip": r"(?i)\b(?:ip|address|adresse|host|server|from|client)\W{0,4}(?:\w+\W){0,2}$",
        "card": r"(?i)\b(?:card|visa|mastercard|credit|carte|tarjeta|karte)\W{0,4}(?:\w+\W){0,2}$",
        "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|telefon|téléphone|teléfono)\W{0,4}(?:\w+\W){0,2}$"}
AGAINST = r"(?i)\b(?:version|v|isbn|issn|doi|order|invoice|ref|id|section|chapter|build|release)\W{0,3}$"
LABELERS = ["pattern", "gazetteer", "context", "border", "variety"]


def _spans(text: Column, pattern: str, guard: str | None) -> Column:
    """Array of (s, e, v): matches in order with code-point bounds, the end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.greatest(F.size(found), F.lit(0)))
    kind = "array<struct<s:int,e:int,v:string>>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def add(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v"))).cast(kind)
        return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.zip_with(found, between, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    spans = F.aggregate(pairs, start, add, lambda acc: acc["out"])
    empty = F.expr(f"cast(array() as {kind})")
    may = text.contains(guard) if guard else text.rlike("[0-9]")
    return F.when(may, spans).otherwise(empty)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of up to 19 digits."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(
        i.alias("i"), F.substring(F.reverse(digits), i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["i"] % 2 == 1, x["d"]).otherwise(
        F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)))
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        def small(part):
            bare = F.ltrim(part, F.lit("0"))
            return F.when(F.length(bare) > 3, F.lit(False)).otherwise(F.coalesce(F.when(bare == "", F.lit(0)).otherwise(bare.cast("int")), F.lit(0)) <= 255)
        return F.forall(F.split(v, "\\."), small)
    n = F.length(_digits(v))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _votes(kind: str, wide: bool, text: Column, span: Column) -> Column:
    """The labelers' votes on one candidate: an array in the order of LABELERS."""
    v = span["v"]
    before = F.substring(text, F.greatest(span["s"] - 29, F.lit(1)), F.least(span["s"], F.lit(30)))
    edges = F.concat(F.substring(text, span["s"], F.when(span["s"] > 0, 1).otherwise(0)), F.substring(text, span["e"] + 1, F.lit(1)))
    digits = _digits(v)
    pattern = F.lit(0) if wide else F.when(_valid(kind, v), 1).otherwise(-1)
    if kind == "email":
        top = F.lower(F.regexp_extract(v, "([A-Za-z0-9-]+)$", 1))
        gazetteer = F.when(top.isin(TOP_DOMAINS), 1).when(top.rlike("^[a-z]{2,3}$"), 0).otherwise(-1)
        variety = F.when(F.length(F.regexp_extract(v, r"^[^@\[({ ]+", 0)) > 1, 1).otherwise(0)
    elif kind == "ip":
        gazetteer = F.when(v.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), -1).otherwise(0)
        variety = F.when(F.length(digits) >= 7, 1).when(F.length(digits) <= 4, -1).otherwise(0)
    elif kind == "card":
        gazetteer = F.when(digits.rlike(CARD_PREFIXES), 1).otherwise(-1)
        variety = F.when(digits.rlike(r"^(\d)\1+$"), -1).otherwise(F.when(F.size(F.array_distinct(F.split(digits, ""))) >= 5, 1).otherwise(0))
    else:
        gazetteer = F.when(digits.rlike(r"^1?[2-9][0-9]{2}[0-9]{7}$"), 1).otherwise(0)
        variety = F.when(digits.rlike(r"(\d)\1{6}"), -1).otherwise(F.when(F.size(F.array_distinct(F.split(digits, ""))) >= 4, 1).otherwise(0))
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    border = F.when(edges.rlike(r"[\p{L}\p{N}_/=]"), -1).otherwise(1)
    return F.array(pattern, gazetteer, context, border, variety)


def candidates(text: Column) -> dict[tuple[str, bool], Column]:
    """Candidate spans by (kind, from the wide pattern)."""
    out = {(k, False): _spans(text, BASE[k], GUARD.get(k)) for k in KINDS}
    out[("email", True)] = _spans(text, WIDE["email"], "at")
    out[("phone", True)] = _spans(text, WIDE["phone"], None)
    return out


@dataclass
class Classifier:
    """Logistic weights: per kind a bias and for each labeler the weights of the votes -1, 0 and 1."""
    bias: dict[str, float]
    weight: dict[str, list[list[float]]]

    def probability(self, kind: str, votes: Column) -> Column:
        z = F.lit(self.bias[kind])
        for j, row in enumerate(self.weight[kind]):
            z = z + F.element_at(F.array(*[F.lit(float(x)) for x in row]), F.element_at(votes, j + 1) + 2)
        return 1 / (1 + F.exp(-z))


def label_model(counts: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation (labelers independent given the class).

    The first guess is the majority vote.  Counts are smoothed by one vote of each kind, the prior included.
    """
    post = {p: 0.5 + 0.45 * max(-1, min(1, sum(p) / 2)) for p in counts}
    m = len(next(iter(counts), ()))
    for _ in range(rounds):
        mass = [sum(counts[p] * (post[p] if c else 1 - post[p]) for p in counts) for c in (0, 1)]
        prior = (mass[1] + 1) / (sum(mass) + 2)
        rate = [[{v: 1.0 for v in (-1, 0, 1)} for _ in range(m)] for _ in (0, 1)]
        for p, n in counts.items():
            for j, v in enumerate(p):
                rate[1][j][v] += n * post[p]
                rate[0][j][v] += n * (1 - post[p])
        # A labeler is never taken to be worse than chance: a vote for is at least as likely in the class for.
        new = {}
        for p in counts:
            logit = math.log(prior / (1 - prior))
            for j, v in enumerate(p):
                step = math.log(rate[1][j][v] / (mass[1] + 3)) - math.log(rate[0][j][v] / (mass[0] + 3))
                logit += max(step, 0.0) if v == 1 else min(step, 0.0) if v == -1 else 0.0
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
        moved = max((abs(new[p] - post[p]) for p in counts), default=0.0)
        post = new
        if moved < 1e-6:
            break
    return post


def _fit_logistic(counts: dict[tuple[int, ...], int], post: dict[tuple[int, ...], float], rounds: int = 400) -> tuple[float, list[list[float]]]:
    """Bias and vote weights by gradient ascent on the posteriors, each pattern weighing as its count's logarithm."""
    m = len(LABELERS)
    bias, weight = 0.0, [[-1.0, 0.0, 1.0] for _ in range(m)]
    total = sum(math.log1p(n) for n in counts.values()) or 1.0
    for _ in range(rounds):
        g0, g = 0.0, [[0.0] * 3 for _ in range(m)]
        for p, n in counts.items():
            z = bias + sum(weight[j][v + 1] for j, v in enumerate(p))
            err = math.log1p(n) / total * (post[p] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            g0 += err
            for j, v in enumerate(p):
                g[j][v + 1] += err
        bias += 2.0 * g0
        for j in range(m):
            for k in range(3):
                weight[j][k] += 2.0 * (g[j][k] - 1e-4 * weight[j][k])
    return bias, weight


def train(docs: DataFrame, *, text: str = "text") -> Classifier:
    """Count the vote patterns of all candidates in all texts, estimate the labelers, fit the span classifier."""
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = candidates(F.col("text"))

    def voter(kind: str, wide: bool):
        return lambda s: F.struct(F.lit(kind).alias("kind"), _votes(kind, wide, F.col("text"), s).alias("votes"))

    each = [F.transform(c, voter(k, w)) for (k, w), c in found.items()]
    rows = (body.select(F.explode(F.concat(*each)).alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
            .collect())  # at most len(KINDS) * 3 ** len(LABELERS) rows
    bias, weight = {}, {}
    for k in KINDS:
        counts = {tuple(r["votes"]): r["n"] for r in rows if r["kind"] == k}
        bias[k], weight[k] = _fit_logistic(counts, label_model(counts))
    return Classifier(bias, weight)


def _joined(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["s"].cast("string"), s["e"].cast("string")))


def find(docs: DataFrame, model: Classifier, *, key: str = "doc_id", text: str = "text", add_at: float = ADD_AT) -> DataFrame:
    """``key`` with, for each kind, the array of base spans (email, ip, card, phone) and of added spans (more_email, ...).

    A span is (s, e, v): code-point bounds, the end exclusive, and the text.  Null and empty texts have no spans;
    null keys and repeated rows each give a row; only ``key`` and ``text`` are read.
    """
    body = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    found = candidates(F.col("_t"))
    names = {(k, w): f"{'wide' if w else 'base'}_{k}" for k, w in found}
    raw = body.select("_k", "_t", *[c.alias(names[p]) for p, c in found.items()])

    def valid(kind: str):
        return lambda s: _valid(kind, s["v"])

    def likely(kind: str):
        return lambda s: ((model.probability(kind, _votes(kind, True, F.col("_t"), s)) >= add_at)
                          & ~F.exists(F.col("_all"), lambda b: (b["s"] < s["e"]) & (s["s"] < b["e"])))

    base = raw.select("_k", "_t", *[F.filter(names[(k, False)], valid(k)).alias(k) for k in KINDS],
                      *[names[p] for p in found if p[1]])
    every = F.concat(*KINDS)
    kept = []
    for k in KINDS:
        wide = F.col(names[(k, True)]) if (k, True) in names else F.slice(F.col(k), 1, 0)
        kept.append(F.filter(wide, likely(k)).alias(f"more_{k}"))
    return base.select("*", every.alias("_all")).select(F.col("_k").alias(key), *KINDS, *kept)


def digest(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text (kind:start:end, kinds as listed, then by start)."""
    base = F.concat_ws(",", F.concat(*[_joined(F.col(k), k) for k in KINDS]))
    both = [_joined(F.array_sort(F.concat(F.col(k), F.col(f"more_{k}"))), k) for k in KINDS]
    return spans.select(key, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"),
                        F.concat_ws(",", F.concat(*both)).alias("spans"))
