"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Patterns propose spans. Labelers vote on each: its form, a check of its digits, a gazetteer, the words
before it, and whether it looks like a filler. Expectation-maximisation estimates how reliable each
labeler is and how likely each pattern of votes means personal data; a logistic span classifier is then
trained on these likelihoods, and its verdict decides which spans are added. Spans that pass the fixed
rules for email, ip, card and phone always stay.

Both models only need counts of spans by their votes and features, which have a fixed number of values
whatever the corpus's size; these counts are all that reaches the driver. Positions are code points. A text
takes time in proportion to its length and, but for a logarithm, to its spans.

Null and empty texts have no spans. Rows with equal ids or equal rows are judged each for itself. Spans of
different kinds may tie in start; they are listed by kind. Without any span in the table, or with an empty
table, nothing is trained and nothing added. ``redact`` keeps other columns, whatever their names, and gives
rows alike in id and text the same text.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "masked_email", "local_phone")
#: All are linear in the text's length: runs are taken whole and begin only where a run can begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{20,}+",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![+0-9(.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: Signs of which a text must hold one for a pattern to be tried.
NEEDS = {"email": "@", "masked_email": ")]", "phone": "+"}
#: Words that go with a kind, for the gazetteer labeler (in the span) and the context labeler (before it).
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|example|local)$",
    "masked_email": r"(?i)(com|org|net|edu|gov|io|info|de|fr|es|uk)$",
    "ip": r"^(10|127|172|192|[1-9][0-9]?|1[0-9][0-9]|2[0-2][0-9])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+([17]|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?[2-9][0-8][0-9]",
    "secret": r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[sp]k_.*|gh[pousr]_.*|AKIA.*|eyJ.*)$",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|address|courriel|correo)[^\n]{0,20}$",
    "masked_email": r"(?i)(mail|contact|write|address|courriel|correo)[^\n]{0,20}$",
    "ip": r"(?i)(\bip\b|host|server|address|from|client)[^\n]{0,20}$",
    "card": r"(?i)(card|visa|master|amex|pay|carte|karte|tarjeta)[^\n]{0,20}$",
    "phone": r"(?i)(phone|call|tel|mobile|fax|contact)[^\n]{0,20}$",
    "local_phone": r"(?i)(phone|call|tel|mobile|fax|contact)[^\n]{0,20}$",
    "secret": r"(?i)(token|secret|passw(or)?d|passwd|api[_-]?key|access[_-]?key|auth|bearer|credential)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$",
}
#: Before a span, what speaks against personal data.
AGAINST = r"(?i)(version|isbn|issue|page|chapter|section|sha(1|256)?|md5|commit|checksum|no\.)[^\n]{0,8}$"
FILLER = r"(?i)^(.)\1+$|0{6}|1{8}|123456789|x{4}|(.)\2{9}|lorem|placeholder|your[_-]"
LABELERS = ("form", "check", "gazetteer", "context", "filler")
EM_ROUNDS, TRAIN_ROUNDS, RIDGE = 40, 25, 1.0


def running(values: str, join: str) -> str:
    """An array's running sums or the like, by steps of doubling width. ``join``: what two numbers ``v`` and ``w`` make."""
    return f"""aggregate(sequence(0, greatest(CAST(ceil(log2(greatest(size({values}), 1))) AS INT) - 1, 0)), {values},
        (acc, k) -> transform(acc, (v, i) -> IF(i >= shiftleft(1, k), {join.format(v="v", w="acc[i - shiftleft(1, k)]")}, v)))"""


def found(kind: str, text: str = "text") -> Column:
    """All matches of a kind with their places, leftmost first, without overlap, and up to 40 signs before each,
    as far as the match before that."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    need = "(" + " OR ".join(f"contains({text}, '{sign}')" for sign in NEEDS[kind]) + ")" if kind in NEEDS else f"{text} rlike '[0-9]'"
    lengths = "transform(x.spans, (s, i) -> length(x.gaps[i]) + length(s))"
    shaped = f"""transform(array(struct(split({text}, '{pattern}', -1) AS gaps, regexp_extract_all({text}, '{pattern}', 0) AS spans)), x ->
        transform(array({lengths}), sizes -> transform(array({running("sizes", "{v} + {w}")}), ends ->
            transform(x.spans, (s, i) -> struct('{kind}' AS kind, ends[i] - length(s) AS start, ends[i] AS end, s AS span,
                right(concat(IF(i > 0, x.spans[i - 1], ''), x.gaps[i]), 40) AS before)))[0])[0])[0]"""
    return F.expr(f"IF({need}, {shaped}, array())")


def digits(span: str) -> str:
    return f"regexp_replace({span}, '[^0-9]', '')"


LUHN = f"""(aggregate(transform(sequence(1, length({digits('span')})), i -> CAST(substring(reverse({digits('span')}), i, 1) AS INT) * (2 - i % 2)),
    0, (s, d) -> s + IF(d > 9, d - 9, d)) % 10 = 0)"""
#: Whether a span of each kind passes the fixed rule, or for the others a check of its signs.
PASSES = {
    "email": "true",
    "ip": "forall(split(span, '[.]'), p -> regexp_replace(p, '^0+', '') rlike '^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": f"CASE WHEN length({digits('span')}) BETWEEN 16 AND 19 THEN {LUHN} ELSE false END",
    "phone": f"length({digits('span')}) BETWEEN 8 AND 15",
    "secret": "span rlike '[0-9].*[0-9].*[0-9]' AND span rlike '[A-Za-z].*[A-Za-z]' AND size(array_distinct(split(span, ''))) >= 8",
    "masked_email": "true",
    "local_phone": f"{digits('span')} rlike '^[2-9][0-9]{{2}}[2-9]'",
}


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_``, a hash of the text and all proposed ``spans`` of every document, base rules applied."""
    spans = F.concat(*[found(k) for k in KINDS])
    rows = common.with_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), spans.alias("spans"))
    return rows.withColumn("row_", F.monotonically_increasing_id())


def by_kind(rules: dict[str, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.items()) + " END"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def voted(spans: DataFrame) -> DataFrame:
    """Votes 1, 0, -1 of each labeler, and the classifier's other features."""
    passes = F.expr(by_kind(PASSES))
    in_list = F.expr(by_kind({k: f"span rlike {quoted(v)}" for k, v in GAZETTEER.items()}))
    told = F.expr(by_kind({k: f"before rlike {quoted(v)}" for k, v in CONTEXT.items()}))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    share = F.length(F.expr(digits("span"))) / F.length("span")
    loose = F.col("kind").isin("secret", "card", "local_phone")
    return spans.withColumns({
        "passes": passes,
        "form": vote(~loose, (F.col("kind") == "card") & (F.length(F.expr(digits("span"))) < 12)),
        "check": vote(passes & (F.col("kind") != "email"), ~passes),
        "gazetteer": vote(in_list, ~in_list),
        "context": vote(told, F.col("before").rlike(AGAINST)),
        "filler": vote(F.lit(False), F.col("span").rlike(FILLER)),
        "size": F.when(F.length("span") < 8, 0).when(F.length("span") < 16, 1).when(F.length("span") < 32, 2).otherwise(3),
        "share": F.when(share < 0.3, 0).when(share < 0.7, 1).otherwise(2),
    })


FEATURES = ("kind", *LABELERS, "size", "share")


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over vote patterns: share of personal data, and for each labeler how
    often it casts a vote on what is, and on what isn't."""
    share = 0.5
    rates = [{1: (0.6, 0.2), 0: (0.3, 0.4), -1: (0.1, 0.4)} for _ in LABELERS]
    for _ in range(rounds):
        sums = [{v: [1.0 * a, 1.0 * b] for v, (a, b) in r.items()} for r in rates]  # a prior of one vote each
        yes = no = 1.0
        for votes, n in counts:
            p = likelihood(votes, share, rates)
            yes, no = yes + n * p, no + n * (1 - p)
            for s, v in zip(sums, votes):
                s[v][0] += n * p
                s[v][1] += n * (1 - p)
        share = yes / (yes + no)
        rates = [{v: (s[v][0] / sum(x[0] for x in s.values()), s[v][1] / sum(x[1] for x in s.values())) for v in s} for s in sums]
    return share, rates


def likelihood(votes: tuple[int, ...], share: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    a, b = math.log(share), math.log(1 - share)
    for r, v in zip(rates, votes):
        a, b = a + math.log(r[v][0]), b + math.log(r[v][1])
    return 1 / (1 + math.exp(max(-60.0, min(60.0, b - a))))


def indicators(x: tuple) -> list[int]:
    """The classifier's inputs that are on for a span with these features."""
    return [0, *(i for i, f in enumerate(ALL, 1) if x[FEATURES.index(f[0])] == f[1])]


ALL = [("kind", k) for k in KINDS] + list(product(LABELERS, (1, -1))) + [("size", v) for v in range(4)] + [("share", v) for v in range(3)]


def trained(rows: list[tuple[tuple, float, float]], rounds: int = TRAIN_ROUNDS) -> list[float]:
    """Weights of a logistic regression with soft labels, by Newton's method with a ridge."""
    size = len(ALL) + 1
    w = [0.0] * size
    data = [(indicators(x), p, n) for x, p, n in rows]
    for _ in range(rounds):
        grad = [-RIDGE * v for v in w]
        hess = [[RIDGE if i == j else 0.0 for j in range(size)] for i in range(size)]
        for on, p, n in data:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on)))))
            for i in on:
                grad[i] += n * (p - q)
                for j in on:
                    hess[i][j] += n * q * (1 - q)
        step = solved(hess, grad)
        w = [a + b for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-6:
            break
    return w


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """The solution of a positive definite system, by elimination."""
    a = [row[:] + [x] for row, x in zip(a, b)]
    n = len(b)
    for i in range(n):
        for k in range(i + 1, n):
            if f := a[k][i] / a[i][i]:
                for j in range(i, n + 1):
                    a[k][j] -= f * a[i][j]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (a[i][n] - sum(a[i][j] * out[j] for j in range(i + 1, n))) / a[i][i]
    return out


def probability(weights: list[float]) -> Column:
    total = F.lit(weights[0])
    for (name, value), w in zip(ALL, weights[1:]):
        total = total + F.when(F.col(name) == F.lit(value), F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def label(docs: DataFrame) -> DataFrame:
    """For every document its kept spans, ``spans``, in order of kind and start, as structs of kind, start,
    end and ``base`` (whether a fixed rule found it). What is written for it holds votes, but no text."""
    rows = candidates(docs).select("doc_id", "text_hash", "row_", F.explode_outer("spans").alias("x"))
    each = common.materialize(voted(rows.select("doc_id", "text_hash", "row_", "x.*")).drop("before", "span"), "votes")
    counts = each.where(F.col("kind").isNotNull()).groupBy(*FEATURES).count().collect()  # a fixed number of combinations
    base, score = F.col("kind").isin(*BASE) & F.col("passes"), F.lit(0.0)
    if counts:
        votes: dict[tuple[int, ...], float] = {}
        for r in counts:
            key = tuple(r[k] for k in LABELERS)
            votes[key] = votes.get(key, 0) + r["count"]
        share, rates = reliabilities(sorted(votes.items()))
        total = sum(votes.values())
        weights = trained([(tuple(r[k] for k in FEATURES), likelihood(tuple(r[k] for k in LABELERS), share, rates), 1000.0 * r["count"] / total) for r in sorted(counts, key=lambda r: tuple(map(str, r)))])
        score = probability(weights)
    each = each.withColumns({"base": F.coalesce(base, F.lit(False)), "score": F.when(base, 1.0).when(~F.col("kind").isin(*BASE) & F.col("passes"), score).otherwise(0.0)})
    # An added span that touches one found by a fixed rule says nothing new.
    text = Window.partitionBy("row_")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(text.orderBy("start"))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(text.orderBy(F.desc("start")))
    each = each.withColumns({"left_": before, "right_": after})
    keep = F.col("base") | ((F.col("score") >= 0.5) & F.coalesce(F.col("left_") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("right_") >= F.col("end"), F.lit(True)))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("order"), "start", "end", "kind", "base", "score"))))
    return each.groupBy("row_", "doc_id", "text_hash").agg(listed.alias("spans")).drop("row_")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of each base kind, a hash of the base spans, and all spans."""
    text = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    joined = lambda x: F.concat_ws(",", F.expr(text.format(x)))
    return label(docs).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: Signs of a block that a text is cut into, so that a stretch is found without counting from the text's start.
CUT = 1024


def between(start: str, stop: str) -> str:
    """The text between two places, from its ``blocks``."""
    return f"IF({stop} <= {start}, '', substring(array_join(slice(blocks, {start} div {CUT} + 1, ({stop} - 1) div {CUT} - {start} div {CUT} + 1), ''), {start} % {CUT} + 1, {stop} - {start}))"


def masked(text: str, spans: str) -> str:
    """A text with its spans replaced; where they overlap, by the kind of the first."""
    last = "IF(i = 0, 0, reach[i - 1])"
    return f"""transform(array(array_sort(transform({spans}, s -> struct(s.start, s.end, s.kind)))), sorted ->
        transform(array(transform(sorted, s -> s.end)), ends -> transform(array({running("ends", "greatest({v}, {w})")}), reach ->
            transform(array(regexp_extract_all({text}, '(?s).{{1,{CUT}}}', 0)), blocks -> concat(
                array_join(transform(sorted, (s, i) -> IF(s.start >= {last}, concat({between(last, "s.start")}, '<', upper(s.kind), '>'), '')), ''),
                {between("reach[size(reach) - 1]", f"length({text})")}))[0])[0])[0])[0]"""


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every kept span of ``text`` replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, named after the first.
    """
    id_, hash_, spans_ = common.fresh(docs, "id_", "hash_", "spans_")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = label(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans_)).dropDuplicates([id_, hash_])
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    return rows.withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(F.expr(masked("text", f"`{spans_}`")))).select(*docs.columns)
