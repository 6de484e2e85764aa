"""Operator 10: personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans; labelers by form, check sum, gazetteer,
context and shape vote on each. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, and a logistic span
classifier is trained on the resulting probabilities. Spans of the four base
kinds always stay; the classifier decides on the further ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.runtime import materialize

# Patterns of the base kinds. Possessive repeats match the same as greedy ones here, as what follows
# can't match what they took; a span begins where its run of characters does, or where the last span ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Patterns of the further kinds, tried in this order at each place.
MORE = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\x20]{0,2}[=:][\x20]{0,2}[\"']?[^\s\"',;]{6,200})|\b[A-Z]{4}[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "mail_text": r"\b[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,63})+",
    "local_phone": r"(?<![0-9+)\x20(.-])[\x20]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
KINDS = [*BASE, *MORE]
# Every further span has one of these, so other texts are not searched.
MORE_SIGN = r"[0-9=:\[(]|[A-Z]{20}|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}"
# Fixed word lists of the labelers.
NEAR = r"(?i)\b(?:e-?mail|mail|courriel|correo|phone|tel|telefon|teléfono|téléphone|call|mobile|fax|contact|ip|address|adresse|host|server|card|visa|iban|account|konto|compte|cuenta|ssn|password|passwd|secret|token|key|name|nombre|nom)\b"
AGAINST = r"(?i)\b(?:version|license|licensed|isbn|issn|doi|page|figure|table|chapter|section|example|sample|test|error|line|id|no|nr)\b"
NOT_PERSONAL = r"^(?:0\.|10\.|127\.|192\.168\.|169\.254\.|255\.)|^[^@]*@(?:example|test|localhost|domain)\.|(?i:changeme|placeholder|xxxx|your[_-])"
PERSONAL = r"(?i)\.(?:com|org|net|edu|gov|de|fr|es|uk|io|eu)$|^\+|^[A-Z]{2}[0-9]{2}|^AKIA"
LABELERS = ["form", "sum", "gazetteer", "context", "shape"]
LEFT, RIGHT = 40, 20
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once: as the variable of a function over one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Matches as (kind, start, end, value): lengths of what lies between them, summed up chunk by chunk."""
    regex = F.lit(pattern)
    between, values = F.split(text, pattern, -1), F.regexp_extract_all(text, regex, F.lit(0))
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), values.alias("value"))
    cut = lambda st: F.transform(F.sequence(F.lit(0), F.floor(F.size(st) / _CHUNK).cast("int")), lambda c: F.slice(st, c * _CHUNK + 1, _CHUNK))
    width = lambda s: s["gap"] + F.coalesce(F.length(s["value"]), F.lit(0))
    begins = lambda chunks: F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, c: F.struct((acc["at"] + F.aggregate(c, F.lit(0), lambda n, s: n + width(s))).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")),
    )["all"]
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def spans(chunk: Column, begin: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(begin.alias("at"), empty.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + width(s)).alias("at"),
                F.when(
                    s["value"].isNotNull(),
                    F.array_append(
                        acc["out"],
                        F.struct(F.lit(kind).alias("kind"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + width(s)).alias("end"), s["value"].alias("value")),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )["out"]

    placed = lambda chunks: F.transform(F.arrays_zip(chunks.alias("chunk"), begins(chunks).alias("begin")), lambda z: spans(z["chunk"], z["begin"]))
    return F.flatten(_let(_let(steps, cut), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.lit(2) * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda n, d: n + d) % 10 == 0


def _valid(s: Column) -> Column:
    """Do the numbers of a base span fit its kind?"""
    digits = _digits(s["value"])
    parts = F.transform(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return (
        F.when(s["kind"] == "ip", F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).try_cast("int") <= 255)))
        .when(s["kind"] == "card", F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19)))
        .when(s["kind"] == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _base(text: Column, kind: str) -> Column:
    """Valid spans of one kind; texts without its telling character are not searched."""
    sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    there = F.contains(text, F.lit(sign)) if sign else F.lit(True)
    if kind != "email":
        there = there & text.rlike("[0-9]")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(there, F.filter(_found(text, BASE[kind], kind), _valid)).otherwise(none)


def _more(text: Column) -> Column:
    """Spans of the further kinds by one pass, named by the first pattern that fits the whole span."""
    pattern = "|".join(f"(?:{p})" for p in MORE.values())

    def named(s: Column) -> Column:
        kind = F.lit("name")
        for name, own in reversed(list(MORE.items())[:-1]):
            # Look-arounds see only the span, so forms are told apart without them.
            bare = own.replace(r"(?<![0-9-])", "").replace(r"(?![0-9-])", "").replace(r"(?<![0-9+)\x20(.-])", "")
            kind = F.when(s["value"].rlike(f"^(?:{bare})$"), F.lit(name)).otherwise(kind)
        # A blank that only led up to a number is no part of it.
        lead = F.length(s["value"]) - F.length(F.ltrim(s["value"]))
        return F.struct(kind.alias("kind"), (s["start"] + lead).alias("start"), s["end"].alias("end"), F.ltrim(s["value"]).alias("value"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(MORE_SIGN), F.transform(_found(text, pattern, "more"), named)).otherwise(none)


def spans(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, plus `base` and `more`: arrays of (kind, start, end, value).

    A further span that overlaps a base span is left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_base(text, kind) for kind in BASE])
    out = docs.withColumn("base", base).withColumn("more", _more(text))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn("more", free)


def _votes(s: Column, left: Column, right: Column) -> Column:
    """Votes of the labelers on a span: 1 personal, -1 not, 0 no opinion."""
    value, kind = s["value"], s["kind"]
    around = F.concat(left, F.lit(" "), right)
    digits = _digits(value)
    core = F.regexp_replace(value, r"^.*[=:]\x20*[\"']?", "")
    mixed = core.rlike("[0-9]") & core.rlike("[A-Za-z]")
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    form = F.when(kind.isin("email", "iban", "ssn", "mail_text", "phone"), yes).when(kind.isin("name"), none).when(kind == "secret", F.when(core.rlike(r"^\S{16,}$"), yes).otherwise(none)).otherwise(yes)
    check = (
        F.when(kind.isin("card", "ip"), yes)
        .when(kind.isin("phone", "local_phone"), F.when(F.length(digits).between(8, 15), yes).otherwise(no))
        .when(kind == "iban", F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (F.length(digits) >= 8), yes).otherwise(no))
        .when(kind == "ssn", F.when(value.rlike("^(?:000|666|9)|-00-|-0000$"), no).otherwise(yes))
        .otherwise(none)
    )
    gazetteer = F.when(value.rlike(NOT_PERSONAL), no).when(value.rlike(PERSONAL), yes).otherwise(none)
    context = F.when(around.rlike(NEAR) | ((kind == "secret") & value.rlike(NEAR)), yes).when(left.rlike(AGAINST), no).otherwise(none)
    shape = (
        F.when(kind == "secret", F.when(mixed & (F.length(core) >= 12), yes).when(~mixed, no).otherwise(none))
        .when(digits.rlike(r"^([0-9])\1+$"), no)
        .when((kind == "name") & value.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}"), yes)
        .otherwise(none)
    )
    return F.struct(*[v.cast("int").alias(n) for v, n in zip((form, check, gazetteer, context, shape), LABELERS)])


def voted(found: DataFrame) -> DataFrame:
    """`found` with `marks`: every span with its votes and its length in steps."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def mark(s: Column) -> Column:
        begin = F.greatest(s["start"] - LEFT, F.lit(0))
        left = F.substring(text, begin + 1, s["start"] - begin)
        right = F.substring(text, s["end"] + 1, F.lit(RIGHT))
        size = F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(4)).cast("int")
        return F.struct(s.alias("span"), _votes(s, left, right).alias("votes"), size.alias("size"))

    return found.withColumn("marks", F.transform(F.concat("base", "more"), mark))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 30) -> tuple[list[float], dict]:
    """Expectation-maximisation over vote patterns and their counts.

    Gives the probability of each pattern to be personal, and per labeler the
    chances of its votes given the truth.
    """
    belief = [1 / (1 + math.exp(-2 * sum(v))) for v, _ in patterns]
    chances: dict = {}
    for _ in range(rounds):
        whole = sum(n for _, n in patterns)
        prior = (1 + sum(b * n for b, (_, n) in zip(belief, patterns))) / (2 + whole)
        for labeler in range(len(LABELERS)):
            for truth in (0, 1):
                weight = {-1: 0.5, 0: 0.5, 1: 0.5}
                for b, (v, n) in zip(belief, patterns):
                    weight[v[labeler]] += n * (b if truth else 1 - b)
                total = sum(weight.values())
                chances[labeler, truth] = {k: w / total for k, w in weight.items()}
        fresh = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chances[k, 1][x] / chances[k, 0][x]) for k, x in enumerate(v))
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        belief = fresh
    return belief, chances


def _inputs(kind: str, votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *[float(v == 1) for v in votes], *[float(v == -1) for v in votes], *[float(kind == k) for k in KINDS], *[float(size == s) for s in range(5)]]


def train(marked: DataFrame) -> list[float]:
    """Weights of the span classifier; only counts of vote patterns, of a fixed number, reach the driver."""
    each = marked.select(F.explode("marks").alias("m")).select("m.span.kind", "m.votes.*", "m.size")
    rows = each.groupBy("kind", *LABELERS, "size").count().collect()
    rows = [(r["kind"], tuple(r[n] for n in LABELERS), r["size"], float(r["count"])) for r in rows]
    if not rows:
        return [0.0] * len(_inputs("", (0,) * len(LABELERS), 0))
    belief, _ = reliabilities([(votes, n) for _, votes, _, n in rows])
    x = np.array([_inputs(k, v, s) for k, v, s, _ in rows])
    y, n = np.array(belief), np.array([r[3] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _logit(m: Column, weights: list[float]) -> Column:
    at = iter(weights)
    total = F.lit(next(at))
    for value in (1, -1):
        for name in LABELERS:
            total = total + F.when(m["votes"][name] == value, next(at)).otherwise(0.0)
    for kind in KINDS:
        total = total + F.when(m["span"]["kind"] == kind, next(at)).otherwise(0.0)
    for size in range(5):
        total = total + F.when(m["size"] == size, next(at)).otherwise(0.0)
    return total


def detect(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, plus `base` and `spans`: arrays of (kind, start, end, value).

    `base` holds the spans of the four base kinds by kind, then start; `spans`
    those and the further spans with a probability of at least one half.
    Places are code points, ends exclusive. Null and empty texts have none.
    Columns with the names of new ones are replaced. Texts are read once: what
    was found is stored, and the only shuffle is that of pattern counts.
    """
    kept = docs.drop("base", "more", "marks", "spans")
    marked = materialize(voted(spans(kept)), "pii-spans")
    weights = train(marked)
    chosen = F.filter("marks", lambda m: m["span"]["kind"].isin(*BASE) | (_logit(m, weights) >= 0))
    return marked.select(*kept.columns, "base", F.transform(chosen, lambda m: m["span"]).alias("spans"))


def _listed(found: Column | str) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans."""
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), s["kind"])
    by_kind = F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("at"), s.alias("span")))), lambda x: x["span"]
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detect(docs.select("doc_id", "text")).select("doc_id", *[count(k) for k in BASE], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed(by_kind).alias("spans"))
