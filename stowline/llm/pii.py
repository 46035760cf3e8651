"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Base spans follow fixed patterns and checks, per kind. Every text is split at a pattern; the lengths of what lies
   between the matches and of the matches give the places, counted in code points.
2. Candidates are the base spans, matches of the base patterns that failed their check, and wider forms (spelled-out
   addresses, defanged and colon forms, other card lengths, national phone numbers) that meet no base span of their kind.
3. Labelers vote yes, no or nothing on each candidate: the pattern's check, a gazetteer (top-level domains, reserved
   networks, card issuers, calling codes), words before it, the characters around it, and its form.
4. Votes are counted by their pattern, 3^5 a kind at most. Expectation-maximisation on these counts estimates each
   labeler's reliability; a pattern's posterior follows from its votes.
5. A logistic regression learns the posteriors from features of the span. Features are few-valued, so the training rows are
   combined to one weighted row per feature vector; no document is left out. Its score decides on the candidates
   outside the base; base spans stay.

Only DataFrame functions run on the executors: regular expressions, arrays and JVM-side regression. The patterns never scan
a stretch of text twice: runs are possessive and start where the character before cannot belong to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from stowline.functions.staging import once
from stowline.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
# each one's own form; a match is a base span if it passes its check
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({](?i:at)[\])}] ?[A-Za-z0-9-]++(?:(?: ?[\[({](?i:dot)[\])}] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++"
    r"| (?i:at) [A-Za-z0-9-]++(?:(?: ?[\[({](?i:dot)[\])}] ?| (?i:dot) )[A-Za-z0-9-]++)++)",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+(?![0-9])"
    r"|(?=[0-9A-Fa-f])(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ .-])[0-9](?:[ .-]?[0-9]){12,18}+(?![ .-]?[0-9])",
    "phone": r"(?=[(0-9])(?<![0-9+(])(?<![0-9] )(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
# what a text must hold for a pattern to match at all; quick to test
HOLDS = {
    ("email", "own"): "@",
    ("email", "wider"): r"(?i)[\[({ ](?:at|dot)[\])} ]",
    ("ip", "own"): r"[0-9]\.[0-9]",
    ("ip", "wider"): r"[0-9][\[(]\.[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    ("card", "own"): "(?:[0-9][ -]?){16}",
    ("card", "wider"): "(?:[0-9][ .-]?){13}",
    ("phone", "own"): r"\+[0-9]",
    ("phone", "wider"): "[0-9]{3}[ .-][0-9]{3}",
}
# gazetteers
DOMAINS = "com org net edu gov mil int info biz io dev app co uk de fr es it nl eu us ca au ch at be pt br mx jp cn in ru pl se no fi dk".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 380 420".split()
YES_WORDS = {
    "email": "mail|email|e-mail|contact|write|correo|courriel|kontakt|address",
    "ip": "ip|host|server|address|login|from|client|ping",
    "card": "card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|telefono|contact",
}
NO_WORDS = "version|release|isbn|issn|order|invoice|token|sha|hash|id|serial|build|chapter|section|page|figure|doi"
CONTEXT = 24  # code points read before a span
BLOCK = 256
ROUNDS = 60
LABELERS = ("check", "gazetteer", "context", "around", "form")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each element of an array of numbers, the sum of those before it.

    Sums are carried over blocks, so the work stays near BLOCK steps an element however long the array is.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda out, one: out + one)

    def of(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        parts = F.transform(blocks, lambda block: F.slice(values, block * BLOCK + 1, F.lit(BLOCK)))
        within = lambda part, first: F.transform(part, lambda _, at: first + total(F.slice(part, F.lit(1), at)))
        carried = lambda sums: lambda part, at: within(part, total(F.slice(sums, F.lit(1), at)))
        return let(parts, lambda some: let(F.transform(some, total), lambda sums: F.flatten(F.transform(some, carried(sums)))))

    return F.when(F.size(lengths) > 0, let(lengths, of)).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, kind: str, form: str) -> Column:
    """Array of struct(begin, end, match, before, after) of all matches, left to right, without overlaps."""
    pattern = (BASE if form == "own" else WIDER)[kind]
    none = F.array().cast("array<struct<begin: bigint, end: bigint, match: string, before: string, after: string>>")

    def of(gaps: Column) -> Column:
        def placed(found: Column) -> Column:
            steps = F.transform(found, lambda one, at: F.length(F.get(gaps, at)) + F.length(one))
            return let(steps, lambda steps: let(sums_before(steps), lambda starts: F.transform(found, lambda one, at: match(one, at, steps, starts))))

        def match(one: Column, at: Column, steps: Column, starts: Column) -> Column:
            end = F.get(starts, at) + F.get(steps, at)
            return F.struct(
                (end - F.length(one)).alias("begin"),
                end.alias("end"),
                one.alias("match"),
                F.right(F.get(gaps, at), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(gaps, at + 1), F.lit(1)).alias("after"),
            )

        return F.when(F.size(gaps) > 1, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)

    return F.when(text.rlike(HOLDS[kind, form]), let(F.split(text, pattern, -1), of)).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""

    def share(at: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - at, 1).cast("int")
        twice = digit * 2
        return F.when(at % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda out, at: out + share(at)) % 10 == 0


def _small(number: Column) -> Column:
    """A run of digits that stands for at most 255, however many noughts lead it."""
    bare = F.ltrim(number, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\.", -1), _small)
    if kind == "card":
        return luhn(_digits(match))  # 16 to 19 digits by the pattern
    return F.length(_digits(match)).between(8, 15)


def _span(kind: str, row: Column, form: str) -> Column:
    """struct(kind, begin, end, base, votes, features) of a match."""
    own = form == "own"
    base = _passes(kind, row["match"]) if own else F.lit(False)

    def told(known: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            row["begin"].alias("begin"),
            row["end"].alias("end"),
            known["base"].alias("base"),
            F.array(*votes(kind, own, known)).alias("votes"),
            F.array(*features(kind, own, known)).alias("features"),
        )

    return let(_known(kind, row, base), told)


def _of_kind(text: Column, kind: str) -> Column:
    """Candidates of one kind, base spans among them, by their begin."""

    def both(found: Column) -> Column:
        # only matches of the wider pattern that meet none of the kind's own
        clear = lambda row: ~F.exists(found, lambda one: (one["begin"] < row["end"]) & (row["begin"] < one["end"]))
        own = F.transform(found, lambda row: _span(kind, row, "own"))
        wider = F.transform(F.filter(_matches(text, kind, "wider"), clear), lambda row: _span(kind, row, "wider"))
        return F.array_sort(F.concat(own, wider), _by_begin)

    return let(_matches(text, kind, "own"), both)


def _by_begin(one: Column, other: Column) -> Column:
    return F.signum(one["begin"] - other["begin"]).cast("int")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (key, spans) of every row: its candidates, by kind and begin."""
    whole = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_whole"))
    return stored(whole.select(key, F.concat(*(_of_kind(F.col("_whole"), kind) for kind in KINDS)).alias("spans")), "spans")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(0)).when(yes, F.lit(1)).otherwise(F.lit(-1))


def _known(kind: str, row: Column, base: Column) -> Column:
    """What votes and features ask of a match, each worked out once."""
    match, digits = row["match"], _digits(row["match"])
    before, never = F.lower(row["before"]), F.lit(False)
    # a letter, digit or quote beside it: part of something longer; addresses may begin after any character
    glued = row["after"].rlike(r"[\p{L}\p{N}_\"@/]")
    if kind != "email":
        glued = glued | F.right(row["before"], F.lit(1)).rlike(r"[\p{L}\p{N}_\"=/]")
    coded = match.startswith("+") | match.startswith("00")
    code = F.regexp_replace(digits, "^00", "")
    listed = {
        "email": F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS),
        "ip": match.rlike(r"^0*(?:0|255)[.\[(]"),
        "card": digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6(?:011|4[4-9]|5)|35)"),
        "phone": coded & (F.left(code, F.lit(1)).isin(CALLING) | F.left(code, F.lit(2)).isin(CALLING) | F.left(code, F.lit(3)).isin(CALLING)),
    }[kind]
    usual = {
        "email": (F.length(match) <= 100) & match.rlike("^[A-Za-z0-9]") & match.rlike("[A-Za-z]{2,}$"),
        "ip": ~match.rlike(r"(?:^|[.:\[(\])])0[0-9]") & (F.length(match) >= 7),
        "card": match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5})$"),
        "phone": F.length(digits).between(10, 13),
    }[kind]
    passes = {"card": luhn(digits), "ip": F.forall(F.split(F.regexp_replace(match, r"[\[\]()]", ""), r"\.", -1), _small)}.get(kind, F.lit(True))
    return F.struct(
        base.alias("base"),
        listed.alias("listed"),
        usual.alias("usual"),
        glued.alias("glued"),
        before.rlike(rf"(?<![a-z])(?:{YES_WORDS[kind]})[^a-z]{{0,4}}(?:[a-z]{{1,3}}[^a-z]{{0,3}})?$").alias("yes"),
        before.rlike(rf"(?<![a-z])(?:{NO_WORDS})[^a-z]{{0,6}}$").alias("no"),
        (coded if kind == "phone" else never).alias("coded"),
        match.rlike(r"[\[({]").alias("brackets"),
        passes.alias("passes"),
        F.least(F.length(digits), F.lit(20)).alias("digits"),
        F.least(F.length(match) - F.length(F.regexp_replace(match, "[ ().:-]", "")), F.lit(6)).alias("separators"),
    )


def votes(kind: str, own: bool, known: Column) -> list[Column]:
    """The labelers' votes: 1 for personal, 0 against, -1 for nothing."""
    never = F.lit(False)
    gazetteer = {
        "email": _vote(known["listed"], ~known["listed"]),
        "ip": _vote(never, known["listed"]),
        "card": _vote(known["listed"], ~known["listed"]),
        "phone": _vote(known["listed"], known["coded"] & ~known["listed"]),
    }[kind]
    return [
        _vote(known["base"], ~known["base"] if own else never),
        gazetteer,
        _vote(known["yes"], known["no"]),
        _vote(~known["glued"], known["glued"]),
        _vote(known["usual"], ~known["usual"]),
    ]


def features(kind: str, own: bool, known: Column) -> list[Column]:
    """Few-valued features; none is a labeler's vote as it stands."""
    fixed = [float(kind == other) for other in KINDS[1:]] + [float(own)]
    listed = [known["listed"] if kind == other else F.lit(False) for other in KINDS]
    flags = [*listed, *(known[name] for name in ("usual", "glued", "yes", "no", "coded", "brackets", "passes"))]
    numbers = [known["digits"] / F.lit(10.0), known["separators"] / F.lit(6.0)]
    return [*map(F.lit, fixed), *(one.cast("double") for one in flags), *numbers]


@dataclass
class Labelers:
    """Reliabilities of one kind: the share of personal spans, and P(vote | personal), P(vote | not) of every labeler."""

    prior: float = 0.5
    yes: list[dict[int, float]] = field(default_factory=list)
    no: list[dict[int, float]] = field(default_factory=list)

    def posterior(self, pattern: tuple[int, ...]) -> float:
        one = math.log(self.prior) + sum(math.log(shares[vote]) for shares, vote in zip(self.yes, pattern))
        other = math.log(1 - self.prior) + sum(math.log(shares[vote]) for shares, vote in zip(self.no, pattern))
        return 1 / (1 + math.exp(min(700.0, other - one)))


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> Labelers:
    """Expectation-maximisation over counted vote patterns, from the majority of votes; shares are smoothed by one vote."""
    width = len(next(iter(counts)))
    belief = {}
    for pattern in counts:
        given = [vote for vote in pattern if vote >= 0]
        belief[pattern] = (1 + sum(given)) / (2 + len(given))
    out = Labelers()
    for _ in range(rounds):
        total = sum(counts.values())
        held = sum(n * belief[pattern] for pattern, n in counts.items())
        out = Labelers((held + 1) / (total + 2), [], [])
        for at in range(width):
            for shares, weigh, whole in ((out.yes, lambda p: belief[p], held), (out.no, lambda p: 1 - belief[p], total - held)):
                sums = {vote: 1.0 for vote in (-1, 0, 1)}
                for pattern, n in counts.items():
                    sums[pattern[at]] += n * weigh(pattern)
                shares.append({vote: value / (whole + 3) for vote, value in sums.items()})
        belief = {pattern: out.posterior(pattern) for pattern in counts}
    return out


@dataclass
class SpanModel:
    labelers: dict[str, Labelers]
    weights: list[float]
    intercept: float

    def personal(self, threshold: float = 0.5) -> Callable[[Column], Column]:
        """Whether a span is a base span or the classifier's probability of a personal one is above the threshold."""
        odds = math.log(threshold / (1 - threshold)) - self.intercept
        weights = F.array(*map(F.lit, self.weights))
        total = lambda span: F.aggregate(F.zip_with(span["features"], weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
        return lambda span: span["base"] | (total(span) > odds) if self.weights else span["base"]


def fit(spans: DataFrame) -> SpanModel:
    """Reliabilities and classifier from all candidates of `candidates`.

    Without candidates only base spans are personal. Only counts of vote patterns and the regression's sums reach the driver.
    """
    each = spans.select(F.explode("spans").alias("span")).select("span.kind", "span.votes", "span.features")
    kinds = stored(each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "span-kinds")  # few-valued: a bounded table
    counted: dict[str, dict] = {}
    for row in kinds.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect():  # 4 * 3^5 rows at most
        counted.setdefault(row["kind"], {})[tuple(row["votes"])] = row["n"]
    model = SpanModel({kind: estimate(counts) for kind, counts in counted.items()}, [], 0.0)
    if not counted:
        return model
    known = {" ".join(map(str, (kind, *pattern))): model.labelers[kind].posterior(pattern) for kind, counts in counted.items() for pattern in counts}
    beliefs = F.create_map(*(F.lit(one) for item in known.items() for one in item))
    pattern = F.concat_ws(" ", "kind", F.col("votes").cast("array<string>"))
    held = kinds.withColumn("_yes", F.element_at(beliefs, pattern) * F.col("n"))
    sums = held.groupBy("features").agg(F.sum("_yes").alias("yes"), F.sum(F.col("n") - F.col("_yes")).alias("no"))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight"))))
    rows = sums.select("features", sides.alias("side")).select(array_to_vector("features").alias("features"), "side.*")
    learned = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60).fit(stored(rows.coalesce(1), "weighted-spans"))
    model.weights, model.intercept = learned.coefficients.toArray().tolist(), float(learned.intercept)
    return model


def _listed(spans: Column) -> Column:
    texts = F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["begin"].cast("string"), span["end"].cast("string")))
    return F.array_join(texts, ",")


def judge_spans(spans: DataFrame, model: SpanModel, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of `candidates`.

    The counts are of base spans; `spans` lists these and the candidates that score above the threshold.
    """
    base = F.filter("spans", lambda span: span["base"])
    personal = F.filter("spans", model.personal(threshold))
    count = lambda kind: F.size(F.filter("_base", lambda span: span["kind"] == kind)).cast("long")
    rows = once(spans, _base=base, _personal=personal)
    return rows.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_personal")).alias("spans"),
    )


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Null and empty texts have no spans: counts of 0, the digest of nothing, an empty list. Null and repeated keys pass
    through, a row each. An empty table gives no rows; other columns are left out.
    """
    spans = candidates(docs, key, text)
    return judge_spans(spans, fit(spans), key)


def masked_texts(docs: DataFrame, model: SpanModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, text) of every row with its personal spans replaced by `[kind]`; where spans meet, the first one stands."""
    whole = F.col("_whole")
    spans = F.concat(*(_of_kind(F.coalesce(whole, F.lit("")), kind) for kind in KINDS))
    rows = once(docs.select(F.col(key), F.col(text).alias("_whole")), _all=spans)
    found = F.array_sort(F.filter("_all", model.personal(threshold)), _by_begin)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def take(state: Column, span: Column) -> Column:
        gap = F.substring(whole, (state["at"] + 1).cast("int"), (span["begin"] - state["at"]).cast("int"))
        after = F.struct(F.concat(state["out"], gap, F.lit("["), span["kind"], F.lit("]")).alias("out"), span["end"].alias("at"))
        return F.when(span["begin"] >= state["at"], after).otherwise(state)

    end = lambda state: F.concat(state["out"], F.substring(whole, (state["at"] + 1).cast("int"), F.length(whole)))
    return rows.select(key, F.when(whole.isNotNull(), F.aggregate(found, start, take, end)).alias(text))
