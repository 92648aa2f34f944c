"""Personal data: rule spans, and further spans by weak supervision.

Base spans of four kinds (email, ip, card, phone) follow fixed patterns and checks.  Further candidates (secrets,
identity numbers, local phone numbers, spelled-out addresses) get votes from regex, gazetteer and context
labelers.  Expectation-maximisation estimates from the agreement of votes over the whole corpus how reliable each
labeler is, and how likely each vote pattern means personal data; with these as soft labels a naive Bayes classifier on
the span's own features is trained, which decides every candidate.  Votes and features have fixed, small value
sets, so the corpus is one aggregation to a table of bounded size, and the driver's work does not grow.

Offsets count code points, the end exclusive.  Patterns are written so that each character is visited a bounded
number of times, also in very long runs of digits or letters.

Cases: null texts are empty and have no spans; repeated rows get equal spans; spans of different kinds may overlap;
an empty table gives an empty result; long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.columns import let, total

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns.  A match can only begin at the start of a run or where the last match ended.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Candidate patterns of the further kinds.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "mail": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{2,}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{2,}+)++",
}
KINDS = (*BASE_KINDS, *CANDIDATES)
#: Words that announce personal data, and words that announce other numbers.
TELLING = "token|password|passwd|pwd|secret|key|apikey|api_key|auth|bearer|credential|ssn|social|tax|iban|account|phone|tel|call|mobile|fax|contact|mail|email|e-mail|write"
OTHER = "page|version|isbn|issn|figure|table|commit|sha|hash|checksum|md5|build|order|ref|doi|rev|line"
#: A gazetteer of what personal strings begin with (access keys of services, countries of bank accounts, mail
#: services) and of what other long strings are made of (files, addresses of pages, kinds of identifiers).
KEY_PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|ghu_|ghs_|glpat-|sk_live_|sk_test_|pk_live_|rk_live_|xoxb-|xoxp-|SG\\.|ya29\\.|eyJ"
ACCOUNT_COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM"
MAIL_SERVICES = "gmail|googlemail|yahoo|outlook|hotmail|icloud|proton|protonmail|gmx|aol|example"
FILE_ENDINGS = "html|htm|php|pdf|png|jpg|jpeg|gif|css|js|json|xml|csv|txt|zip|gz"
KNOWN = rf"^(?:{KEY_PREFIXES})|^(?:{ACCOUNT_COUNTRIES})[0-9]{{2}}[A-Z0-9]{{11,30}}$|(?i)[\])]\x20?(?:{MAIL_SERVICES})\b"
COMMON = rf"(?i)(?:^|[-_/+])(?:www|http|https|{FILE_ENDINGS}|isbn|issn|sha1|sha256|md5|uuid)(?:[-_/+]|$)"
ROUNDS = 100


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) of a pattern's matches; before and after are the 24 characters beside it."""

    def placed(found: Column, pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda a, i: F.struct(
            (a["at"] + F.length(F.get(pieces, i)) + F.length(F.get(found, i))).cast("int").alias("at"),
            F.array_append(a["starts"], (a["at"] + F.length(F.get(pieces, i))).cast("int")).alias("starts")
        )
        starts = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda a: a["starts"])
        return let(
            starts,
            lambda s: F.transform(
                found, lambda x,
                i: F.struct(
                    F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("found"),
                    F.right(F.get(pieces, i), F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(24)).alias("after")
                )
            )
        )

    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)))
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    )
    return total(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            F.split(found, r"\."),
            lambda p: (F.length(short(p)) <= 3) & (F.when(F.length(short(p)).between(1, 3), short(p)).otherwise("0").cast("int") <= 255)
        )
    if kind == "card":
        return let(_digits(found), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, patterns: dict[str, str]) -> Column:
    """Array of (start, rank, end, kind, found, before, after), in order of start and kind."""
    typed = "array<struct<start:int,rank:int,end:int,kind:string,found:string,before:string,after:string>>"
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "mail": text.rlike(r"[\[(](?:at|AT)[\])]")}
    digits = text.rlike("[0-9]")

    def of_kind(kind: str, pattern: str) -> Column:
        span = lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            m["found"].alias("found"), m["before"].alias("before"), m["after"].alias("after")
        )
        found = F.transform(F.filter(_matches(text, pattern), lambda m: _valid(kind, m["found"])), span)
        return F.when(needs.get(kind, digits), found.cast(typed)).otherwise(F.array().cast(typed))

    arrays = [of_kind(kind, pattern) for kind, pattern in patterns.items()]
    return F.sort_array(F.concat(*arrays))


def base_spans(text: Column) -> Column:
    return _spans(text, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE})


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans that overlap no base span."""
    return F.filter(_spans(text, CANDIDATES), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))


def votes(c: Column) -> Column:
    """Six labelers' votes as one letter each: y (personal), n (not), - (abstains); by form, gazetteer, contexts and mixture."""
    vote = lambda yes, no: F.when(yes, "y").when(no, "n").otherwise("-")
    found, before, after = c["found"], c["before"], c["after"]
    telling = rf"(?i)(?:^|[^a-z])(?:{TELLING})[^A-Za-z0-9]{{0,6}}$"
    other = rf"(?i)(?:^|[^a-z])(?:{OTHER})[^A-Za-z0-9]{{0,6}}$"
    shape = found.rlike(
        r"^(?:AKIA[0-9A-Z]{12,}|[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|gh[pous]_[A-Za-z0-9]{20,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"
    ) | (c["kind"] != "secret")
    distinct = F.size(F.array_distinct(F.split(found, ""))) / F.length(found)
    mixed = (F.length(_digits(found)) / F.length(found)).between(0.15, 0.9)
    return F.concat(
        vote(found.rlike(KNOWN), found.rlike(COMMON)),
        vote(shape, found.rlike("[-/_+]{2}|[a-z]{12}")),
        vote(before.rlike(telling), before.rlike(other)),
        vote(before.rlike(r"[=:][\x20]?[\"']?$|[\"']$"), before.rlike(r"[/\\#]$")),
        vote(after.rlike(r"^(?:[\"'\x20.,;)\n]|$)"), after.rlike(r"^[/\\@=]")),
        vote(mixed & (distinct > 0.2), ~mixed),
    )


def features(c: Column) -> Column:
    """The classifier's features, as name=value strings of small value sets."""
    found = c["found"]
    share = F.floor(4 * F.length(_digits(found)) / F.length(found)).cast("string")
    size = F.least(F.floor(F.log2(F.length(found).cast("double"))), F.lit(8)).cast("string")
    case = F.when(
        found.rlike("[a-z]") & found.rlike("[A-Z]"), "mixed"
    ).when(found.rlike("[A-Z]"), "upper").when(found.rlike("[a-z]"), "lower").otherwise("none")
    side = lambda text, pattern: F.when(text == "", "end").when(
        text.rlike(pattern % "[A-Za-z0-9]"), "word"
    ).when(text.rlike(pattern % r"\s"), "space").when(text.rlike(pattern % "[\"'=:]"), "mark").otherwise("other")
    signs = F.when(found.rlike("[+/_-]"), "yes").otherwise("no")
    return F.array(
        F.concat(F.lit("kind="), c["kind"]), F.concat(F.lit("digits="), share), F.concat(F.lit("size="), size),
        F.concat(F.lit("case="), case), F.concat(F.lit("before="), side(c["before"], "%s$")),
        F.concat(F.lit("after="), side(c["after"], "^%s")), F.concat(F.lit("signs="), signs)
    )


@dataclass(frozen=True)
class SpanModel:
    """Log odds of personal data: a base value and one for each feature; `reliability` of the labelers for reports."""

    base: float
    weights: dict[str, float]
    reliability: tuple[float, ...]

    def keeps(self, c: Column) -> Column:
        if not self.weights:
            return F.lit(False)
        names = sorted(self.weights)
        table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(self.weights[k]) for k in names)))
        return F.aggregate(features(c), F.lit(self.base), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0))) > 0


def reliabilities(patterns: dict[str, float]) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]]]:
    """From counts of vote patterns, by expectation-maximisation: each pattern's probability of personal data, and each labeler's votes given either truth."""
    labelers = len(next(iter(patterns)))
    every = sum(patterns.values())
    logistic = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    posterior = {v: logistic(1.5 * (v.count("y") - v.count("n"))) for v in patterns}
    # A vote is taken to be right more often than wrong: pseudo-counts of four to one.
    prior = {"y": (4.0, 1.0), "n": (1.0, 4.0), "-": (2.5, 2.5)}
    table: list[dict[str, tuple[float, float]]] = []
    for _ in range(ROUNDS):
        yes = sum(n * posterior[v] for v, n in patterns.items())
        table = []
        for k in range(labelers):
            seen = {
                a: [
                    sum(n * posterior[v] for v, n in patterns.items() if v[k] == a),
                    sum(n * (1 - posterior[v]) for v, n in patterns.items() if v[k] == a)
                ] for a in "yn-"
            }
            table.append({a: ((seen[a][0] + prior[a][0]) / (yes + 7.5), (seen[a][1] + prior[a][1]) / (every - yes + 7.5)) for a in "yn-"})
        prior_odds = math.log((yes + 1) / (every - yes + 1))
        posterior = {
            v: logistic(prior_odds + sum(math.log(table[k][v[k]][0] / table[k][v[k]][1]) for k in range(labelers))) for v in patterns
        }
    return posterior, table


def train(rows: Iterable[tuple[str, str | None, int]]) -> SpanModel:
    """The span classifier from counts of (votes, feature), and of votes alone where the feature is null: reliabilities first, then naive Bayes on soft labels."""
    rows = list(rows)
    patterns = {v: float(n) for v, f, n in sorted((r for r in rows if r[1] is None), key=lambda r: r[0])}
    if not patterns:
        return SpanModel(0.0, {}, ())
    posterior, table = reliabilities(patterns)
    yes = sum(n * posterior[v] for v, n in patterns.items())
    no = sum(patterns.values()) - yes
    weights: dict[str, list[float]] = {}
    for v, f, n in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1])):
        got = weights.setdefault(f, [0.0, 0.0])
        got[0] += n * posterior[v]
        got[1] += n * (1 - posterior[v])
    odds = {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, (a, b) in weights.items()}
    reliability = tuple(round(t["y"][0] / (t["y"][0] + t["y"][1]), 4) for t in table)
    return SpanModel(math.log((yes + 0.5) / (no + 0.5)), odds, reliability)


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """The model of all candidates of a corpus: one aggregation to the counts of vote patterns and of patterns with a feature's value.

    Six labelers have at most 3^6 patterns and the seven features about 40 values, so the table has at most about 30,000 rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(text.alias("t")).where(F.col("t").rlike(r"[0-9]|[\[(](?:at|AT)[\])]")).select(
        F.explode(let(F.col("t"), lambda t: let(base_spans(t), lambda b: candidates(t, b)))).alias("c")
    )
    counted = found.select(
        votes(F.col("c")).alias("v"), F.explode(F.array_append(features(F.col("c")), F.lit(None).cast("string"))).alias("f")
    )
    return train((r.v, r.f, r.n) for r in counted.groupBy("v", "f").agg(F.count(F.lit(1)).alias("n")).collect())


def _both(text: Column, model: SpanModel) -> Column:
    """Struct of `base` and `found`: arrays of (start, rank, end, kind, found, before, after); found has base and added spans in order."""
    added = lambda t, b: F.filter(candidates(t, b), model.keeps)
    return let(
        text, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, added(t, b))).alias("found")))
    )


def _plain(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def listed(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        n = F.size(a["out"])
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        last = F.get(a["out"], n - 1)
        longer = F.array_append(
            F.slice(a["out"], F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        )
        return F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            F.when((n > 0) & (s["start"] < a["end"]), longer).otherwise(F.array_append(a["out"], fresh)).alias("out")
        )

    def replaced(runs: Column) -> Column:
        parts = F.transform(
            runs, lambda s,
            i: F.concat(
                F.substring(
                    text, F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0) + 1,
                    s["start"] - F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
                ),
                F.lit("["), F.upper(s["kind"]), F.lit("]")
            )
        )
        rest = F.substring(text, F.get(runs, F.size(runs) - 1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(found) == 0, text).otherwise(let(F.aggregate(found, zero, step, lambda a: a["out"]), replaced))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the number of base spans of each kind, the SHA-256 of their list, and the list of all spans."""
    found = docs.select(F.col(id_col), _both(_plain(text_col), fit(docs, text_col)).alias("pii"))
    count = lambda kind: F.size(F.filter(F.col("pii.base"), lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col(id_col), *map(count, BASE_KINDS), F.sha2(listed(F.col("pii.base")), 256).alias("base_sha256"),
        listed(F.col("pii.found")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of the text column replaced; null texts stay null, other columns stay as they are."""
    model = fit(docs, text_col)
    clean = let(F.col(text_col).cast("string"), lambda t: let(_both(t, model), lambda p: redacted(t, p["found"])))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean))
