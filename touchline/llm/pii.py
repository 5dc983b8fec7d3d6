"""Personal data by weak supervision; DataFrame and SQL functions only.

One scan finds, in every whole text, the base matches of four kinds and looser candidates of the same kinds. Labelers vote
on each: a regex labeler (is it the strict form), a gazetteer labeler (known top-level domains, issuer digits, dialling
codes, address ranges), a context labeler (a trigger word shortly before it) and a check labeler (checksum, digit counts).
Expectation-maximisation over the counts of vote patterns, a table of fixed size, estimates each labeler's reliability by
kind; its posteriors train a logistic span classifier, again on counts of feature patterns. Candidates that it accepts are
added to the base matches, which always stay.

Matches are found with possessive patterns that start at the end of the last match or at the start of a run. They match
what the plain patterns match, without trying every start in a long run again.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9./])[0-9]{4}(?:[./][0-9]{4}){2}[./][0-9]{1,7}(?![0-9./])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])|(?<![0-9+])00[1-9][0-9]{0,2}[\x20-][0-9]{2,4}[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9])",
}
#: A text without these can't hold a match.
_GATE = {
    ("email", True): "contains(t, '@')",
    ("ip", True): r"rlike(t, r'[0-9]\.[0-9]')",
    ("card", True): r"rlike(t, r'[0-9](?:[\x20-]?[0-9]){12}')",
    ("phone", True): "contains(t, '+')",
    ("email", False): "(contains(t, '[at]') or contains(t, '(at)') or contains(t, ' at ')) and (contains(t, '[dot]') or contains(t, '(dot)') or contains(t, ' dot '))",
    ("ip", False): "contains(t, '[.]') or contains(t, '(.)')",
    ("card", False): r"rlike(t, r'[0-9]{4}[./][0-9]{4}[./]')",
    ("phone", False): r"rlike(t, r'[0-9]{3}[.\x20-][0-9]{3,4}')",
}
#: Labelers' word lists; fixed values.
_GAZETTEER = {
    "email": r"(?i)[.\s\])](?:com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|it|nl|at|ch|eu|us|ca|mx)$",
    "ip": r"^(?:[1-9]|1[0-9]|2[0-4])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6[05])",
    "phone": r"^(?:\+|00|\(?[2-9])",
}
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write|schreib|reach)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|from)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta|payment)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)\b(?:tel|phone|telephone|call|fax|mobile|cell|telefon|handy|m[oó]vil|llam\w+|appel\w*)\W*(?:\w+\W+){0,2}$",
}
FEATURES = ("strict", "known", "context", "checks", "digits", "size")
_SPAN = "array<struct<start:int,end:int,hit:string>>"


def _find(pattern: str, gate: str) -> Column:
    """Leftmost non-overlapping matches of column t as (start, end, hit), places in code points."""
    t = F.col("t")
    hits = F.zip_with(
        F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))
    )
    found = F.aggregate(
        F.filter(hits, lambda x: x["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda state, x: F.struct(
            (state["at"] + x["gap"] + F.length(x["hit"])).alias("at"),
            F.concat(
                state["out"],
                F.array(
                    F.struct((state["at"] + x["gap"]).alias("start"), (state["at"] + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"))
                ),
            ).alias("out"),
        ),
        lambda state: state["out"],
    )
    return F.when(F.expr(gate), found).otherwise(F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The check of a kind: what a base match must pass, and the check labeler's vote."""
    digits = _digits(hit)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.regexp_replace(hit, r"[\[\]()]", "").rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["hit"])


def _judged(kind: str, spans: Column, strict: bool) -> Column:
    """Spans with what the labelers and the classifier look at; every feature is a small whole number."""
    t = F.col("t")

    def look(x: Column) -> Column:
        before = t.substr(F.greatest(F.lit(1), x["start"] - 39), F.least(F.lit(40), x["start"]))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.lit(int(strict)).alias("strict"),
            x["hit"].rlike(_GAZETTEER[kind]).cast("int").alias("known"),
            before.rlike(_CONTEXT[kind]).cast("int").alias("context"),
            _valid(kind, x["hit"]).cast("int").alias("checks"),
            F.least(F.length(_digits(x["hit"])) / 3, F.lit(6)).cast("int").alias("digits"),
            F.least(F.length(x["hit"]) / 8, F.lit(5)).cast("int").alias("size"),
        )

    return F.transform(spans, look)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, loose): base matches and looser candidates of every whole text, with their features."""
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for kind in KINDS:
        base = F.filter(_find(BASE[kind], _GATE[kind, True]), _keeps(kind))
        found = found.withColumn(f"b_{kind}", base).withColumn(f"l_{kind}", _find(LOOSE[kind], _GATE[kind, False]))
    base = F.concat(*(_judged(k, F.col(f"b_{k}"), True) for k in KINDS))
    loose = F.concat(*(_judged(k, F.col(f"l_{k}"), False) for k in KINDS))
    return found.select(id_col, base.alias("base"), loose.alias("loose"))


def reliabilities(patterns: dict[tuple, int], rounds: int = 30) -> tuple[dict[tuple, float], dict[int, list[tuple[float, float]]]]:
    """Expectation-maximisation of two classes over counts of (kind, vote, vote, ...) patterns.

    Returns each pattern's posterior of being personal data and, by kind, each labeler's chance of a yes in either class.
    """
    votes = {p: p[1:] for p in patterns}
    posterior = {p: (sum(v) + 0.5) / (len(v) + 1) for p, v in votes.items()}
    chances: dict[int, list[tuple[float, float]]] = {}
    for _ in range(rounds):
        fresh = {}
        for kind in {p[0] for p in patterns}:
            mine = [p for p in patterns if p[0] == kind]
            yes, no = (sum(patterns[p] * w(posterior[p]) for p in mine) for w in (lambda q: q, lambda q: 1 - q))
            # Counts start from a mild belief that labelers are right more often than not.
            chances[kind] = [
                (
                    (sum(patterns[p] * posterior[p] * votes[p][i] for p in mine) + 7) / (yes + 10),
                    (sum(patterns[p] * (1 - posterior[p]) * votes[p][i] for p in mine) + 3) / (no + 10),
                )
                for i in range(len(mine[0]) - 1)
            ]
            for p in mine:
                odds = log((yes + 1) / (no + 1))
                for v, (a, b) in zip(votes[p], chances[kind], strict=True):
                    odds += log(a / b) if v else log((1 - a) / (1 - b))
                fresh[p] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        posterior = fresh
    return posterior, chances


def _columns(features: tuple) -> list[tuple[str, int]]:
    """The classifier's inputs that are on for (kind, strict, known, context, checks, digits, size)."""
    kind, *rest = features
    return [("kind", kind), *((f"{n}:{kind}", v) for n, v in zip(FEATURES, rest, strict=True))]


def train(rows: list[tuple[tuple, int]], rounds: int = 150, rate: float = 0.5, l2: float = 0.002) -> dict[tuple[str, int], float]:
    """Weights of the span classifier from counts of feature patterns, with posteriors of expectation-maximisation as targets."""
    patterns: dict[tuple, int] = {}
    for f, n in rows:
        patterns[f[:5]] = patterns.get(f[:5], 0) + n
    posterior, _ = reliabilities(patterns)
    total = sum(n for _, n in rows) or 1
    inputs = [(_columns(f), (n / total) ** 0.5, posterior[f[:5]]) for f, n in rows]
    mass = sum(n for _, n, _ in inputs) or 1
    weights: dict[tuple[str, int], float] = {}
    for _ in range(rounds):
        slope: dict[tuple[str, int], float] = {}
        for on, n, y in inputs:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(weights.get(c, 0.0) for c in on)))))
            for c in on:
                slope[c] = slope.get(c, 0.0) + n / mass * (p - y)
        for c, g in slope.items():
            weights[c] = weights.get(c, 0.0) * (1 - l2) - rate * g * 4
    return weights


def _score(x: Column, weights: dict[tuple[str, int], float]) -> Column:
    total = F.lit(0.0)
    for (name, value), w in sorted(weights.items()):
        name, _, kind = name.partition(":")
        on = x[name] == value if not kind else (x["kind"] == int(kind)) & (x[name] == value)
        total = total + F.when(on, F.lit(float(w))).otherwise(0.0)
    return total


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.8) -> DataFrame:
    """One row per row of docs: (id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    Null texts are empty and have no spans; ids may repeat or be null; other columns are ignored; an empty table gives an
    empty result. An added span overlaps no base span.
    """
    found = materialise(candidates(docs, id_col, text_col), "spans")
    seen = found.select(F.explode(F.concat("base", "loose")).alias("x"))
    counts = seen.groupBy(*(F.col(f"x.{c}").alias(c) for c in ("kind", *FEATURES))).agg(F.count("*").alias("n")).collect()  # at most 2,700 rows
    weights = train([(tuple(r)[:-1], r["n"]) for r in sorted(counts, key=tuple)])

    base = F.col("base")
    apart = lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    added = F.filter("loose", lambda x: apart(x) & (_score(x, weights) >= log(bar / (1 - bar)))) if weights else F.filter("loose", lambda x: F.lit(False))
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, place))
        return F.array_join(F.transform(ordered, lambda x: F.concat(names[x["kind"]], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")

    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(number, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.concat(base, added)).alias("spans"))
