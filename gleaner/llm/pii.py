"""Personal data by weak supervision.

Candidate spans come from patterns. The base patterns (email, ip, card, phone) with their checks are always reported.
Looser patterns (spelled-out email addresses, national telephone numbers, social security numbers, names after a form
of address, and secrets: passwords, tokens and keys, as strings of letters and digits) give candidates that the method
decides on: labelers of four sorts vote for, against or abstain,

    form       the span's own form is that of its kind,
    gazetteer  a part of it is, or is not, in a list of domains, calling codes, issuers, forenames, beginnings of keys,
    context    the words before it name its kind, or something else that has such numbers,
    border     it stands free, or is part of a longer word or number;

expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each kind, and the
probabilities that it gives to the spans train a final naive Bayes classifier on features of the span.

Only DataFrame functions touch the documents: candidates stay arrays in their document's row, only counts of vote
patterns (at most 3 to the power 4 for each kind) and of features reach the driver, and the fitted numbers go back as
literals. Positions are code points.

The gazetteers are short fixed lists; a name or a key that none of them has is decided by the other labelers.

Defined results: null and empty texts have no spans; repeated rows are reported alike; spans of several kinds may
overlap; an added span that overlaps a base span is dropped. Other columns are kept by `redact`, whatever their names
(but `__pii_...`), and not read by `report`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "name", "secret")
LABELERS = ("form", "gazetteer", "context", "border")
THRESHOLD = 0.8
CONTEXT = 40

#: Each pattern: name, kind, a text that must occur for it to match, expression. Runs are possessive and begin where
#: they can't be entered midway, so that a scan is linear in the text; \G is where the last match ended.
PATTERNS = (
    ("email", "email", "contains(text, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", r"text rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", "card", r"text rlike '[0-9](?:[ -]?[0-9]){11}'", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "phone", "contains(text, '+')", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email2", "email", r"text rlike '[\\[(] ?at ?[\\])]'", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++| ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)++"),
    ("phone2", "phone", r"text rlike '[0-9]{3}[)]?[ .-][0-9]{3}[.-][0-9]{4}'", r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"),
    ("ssn", "ssn", r"text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("name", "name", r"text rlike '(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra|Sr)[.]? \\p{Lu}'", r"(?<![\p{L}\p{N}])(?<=(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra|Sr)\.? )\p{Lu}[\p{L}'-]++(?: \p{Lu}[\p{L}'-]++)?+"),
    ("secret", "secret", r"text rlike '[A-Za-z][0-9]|[0-9][A-Za-z]'", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+={0,2}"),
)
CANDIDATE = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"

# Top-level domains, calling codes, first digits of card issuers, forenames, beginnings of keys.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt br in jp cn ru"
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 66 81 82 86 90 91 351 352 353 358 380 420"
ISSUERS = "3 4 5 6"
FORENAMES = (
    "james mary john anna robert maria michael linda william david richard thomas charles daniel paul mark susan karen"
    " peter hans klaus juan jose carlos luis pierre jean marie claire sophie julia laura emma sarah martin stefan"
)
KEYS = "AKIA ASIA AIza ghp_ gho_ ghs_ glpat- sk- sk_ pk_ xoxb- xoxp- eyJ npm_ hf_"
#: The whole form of keys that some issuers give out.
ISSUED = r"^(?:A[KS]IA[0-9A-Z]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|npm_[A-Za-z0-9]{36})$"
SAYS = {
    "email": r"e-?mail|mail|contact|address|write|correo|courriel",
    "ip": r"ip|host|server|address|client|from",
    "card": r"card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|telephone|call|mobile|cell|fax|contact|telefon|telefono|t[eé]l",
    "ssn": r"ssn|social|security|taxpayer",
    "secret": r"password|passwd|passphrase|pwd|secret|token|key|bearer|authorization|credential|contraseña|passwort|kennwort|mot de passe",
    "name": r"dear|contact|sincerely|regards|signed|author|by",
}
OTHER = r"version|release|isbn|order|invoice|part|item|model|serial|section|chapter|ref|no|nr|id|build|page|commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|etag|revision|file|path|url"


#: Matches that are gone through one after the other; their stretches, apart. An array that grows by one is copied each time.
STRETCH = 128


def _matches(name: str) -> str:
    """SQL of the pattern's matches, each with what comes before and after it (`2`). The last has no match."""
    return f"arrays_zip(__pii_m_{name}, __pii_p_{name}, slice(__pii_p_{name}, 2, greatest(1, size(__pii_p_{name}))))"


def _offsets(name: str) -> str:
    """SQL of the positions where stretches of matches begin, and the end."""
    lengths = f"aggregate(slice(__pii_z_{name}, g * {STRETCH} + 1, {STRETCH}), 0, (n, x) -> n + char_length(x.__pii_p_{name}) + coalesce(char_length(x.__pii_m_{name}), 0))"
    stretches = f"transform(sequence(0, (size(__pii_z_{name}) - 1) div {STRETCH}), g -> {lengths})"
    return f"if(size(__pii_m_{name}) = 0, cast(array() as array<int>), aggregate({stretches}, array(0), (acc, n) -> concat(acc, array(element_at(acc, -1) + n))))"


def _candidates(name: str, kind: str, guard: str, pattern: str) -> str:
    """SQL of the pattern's matches with their positions and surroundings. __pii_m and __pii_p: matches, and what is between;
    __pii_z and __pii_o: `_matches` and `_offsets`."""
    stretch = f"""
    aggregate(slice(__pii_z_{name}, g * {STRETCH} + 1, {STRETCH}),
      named_struct('at', __pii_o_{name}[cast(g as int)], 'all', cast(array() as {CANDIDATE})),
      (acc, x) -> if(x.__pii_m_{name} is null, acc, named_struct(
        'at', acc.at + char_length(x.__pii_p_{name}) + char_length(x.__pii_m_{name}),
        'all', concat(acc.all, array(named_struct('start', acc.at + char_length(x.__pii_p_{name}), 'kind', {KINDS.index(kind)},
          'end', acc.at + char_length(x.__pii_p_{name}) + char_length(x.__pii_m_{name}), 'value', x.__pii_m_{name},
          'left', right(x.__pii_p_{name}, {CONTEXT}), 'right', left(x.`2`, {CONTEXT})))))),
      acc -> acc.all)"""
    return f"if(size(__pii_o_{name}) < 2, cast(array() as {CANDIDATE}), flatten(transform(sequence(0, size(__pii_o_{name}) - 2), g -> {stretch})))"


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' checksum is that of a card number."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + _luhn_value(F.substring(digits, -i, F.lit(1)).cast("int"), i),
    )
    return total % 10 == 0


def _luhn_value(digit: Column, place: Column) -> Column:
    doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
    return F.when(place % 2 == 0, doubled).otherwise(digit)


def _valid(x: Column) -> Column:
    """The base kinds' checks."""
    n = F.length(_digits(x["value"]))
    return (
        F.when(x["kind"] == 1, x["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(x["kind"] == 2, (n >= 12) & (n <= 19) & luhn(_digits(x["value"])))
        .when(x["kind"] == 3, (n >= 9) & (n <= 15))
        .otherwise(True)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `__pii_base` and `__pii_more`: the base spans, and the candidates that touch none of them."""
    text = docs.withColumn("__pii_text", F.coalesce("text", F.lit("")))
    for name, _, guard, pattern in PATTERNS:
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        guard = guard.replace("text", "__pii_text", 1)
        text = text.withColumn(f"__pii_m_{name}", F.expr(f"if({guard}, regexp_extract_all(__pii_text, '{quoted}', 0), cast(array() as array<string>))"))
    for name, _, _, pattern in PATTERNS:
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        text = text.withColumn(f"__pii_p_{name}", F.expr(f"if(size(__pii_m_{name}) > 0, split(__pii_text, '{quoted}', -1), array(''))"))
    text = text.withColumns({f"__pii_z_{p[0]}": F.expr(_matches(p[0])) for p in PATTERNS})
    text = text.withColumns({f"__pii_o_{p[0]}": F.expr(_offsets(p[0])) for p in PATTERNS})
    found = text.withColumns({f"__pii_c_{p[0]}": F.expr(_candidates(*p)) for p in PATTERNS})
    base = F.filter(F.concat(*[F.col(f"__pii_c_{p[0]}") for p in PATTERNS[: len(BASE)]]), _valid)
    kept = found.select(*[F.col(f"`{c}`") for c in docs.columns], base.alias("__pii_base"), *[f"__pii_c_{p[0]}" for p in PATTERNS[len(BASE) :]])
    more = F.filter(
        F.concat(*[F.col(f"__pii_c_{p[0]}") for p in PATTERNS[len(BASE) :]]),
        lambda x: ~F.exists("__pii_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], "__pii_base", more.alias("__pii_more"))


def _in(word: Column, words: str) -> Column:
    return F.lower(word).isin(*words.split())


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, 0 or null. Nearly all candidates have the form that their pattern asks for,
    and stand free; a vote that they all share would tell nothing, so these labelers vote against the others only."""
    kind, value, left, right = x["kind"], x["value"], x["left"], x["right"]
    digits = _digits(value)
    said = F.lit(None).cast("int")
    for name, words in SAYS.items():
        said = F.when((kind == KINDS.index(name)) & left.rlike(rf"(?i)(?<![a-z])(?:{words})s?\W{{0,12}}(?:\w{{0,3}}\W{{0,3}})?$"), 1).otherwise(said)
    return {
        "form": F.when(kind == 0, F.when(value.rlike(r"[.)\]] ?[A-Za-z]{2,24}$"), 1).otherwise(0))
        .when(kind == 1, F.when(value.rlike(r"(?:^|\.)0[0-9]"), 0).otherwise(1))
        .when(kind == 2, F.when(F.length(digits).isin(13, 14, 15, 16, 19), 1).otherwise(0))
        .when(kind == 3, F.when(F.length(digits).between(10, 13) & ~digits.rlike("^[01]{1}[0-9]{2}[01]"), None).otherwise(0))
        .when(kind == 4, F.when(digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"), None).otherwise(0))
        .when(kind == 5, F.when(value.contains(" "), 1))
        # A key has digits throughout and no long words; an identifier has words.
        .otherwise(F.when(value.rlike("[A-Za-z]{9}|[/_-][A-Za-z]{4,}[/_-]"), 0).when(value.rlike(ISSUED), 1).when(F.length(digits) * 8 < F.length(value), 0)),
        "gazetteer": F.when(kind == 0, F.when(_in(F.regexp_extract(value, r"([A-Za-z]+)$", 1), DOMAINS), 1).otherwise(0))
        .when(kind == 1, F.when(value.rlike(r"^(?:0|127|255)\."), 0))
        .when(kind == 2, F.when(F.substring(digits, 1, 1).isin(*ISSUERS.split()), 1).otherwise(0))
        .when(kind == 3, F.when(value.startswith("+"), F.when(digits.rlike(rf"^(?:{CODES.replace(' ', '|')})"), 1).otherwise(0)))
        .when(kind == 5, F.when(_in(F.regexp_extract(value, r"^([^ ]+)", 1), FORENAMES), 1))
        .when(kind == 6, F.when(value.rlike(rf"^(?:{KEYS.replace(' ', '|')})"), 1)),
        "context": F.when(left.rlike(rf"(?i)(?<![a-z])(?:{OTHER})\W{{0,3}}$"), 0).otherwise(said),
        "border": F.when(left.rlike(r"[\p{L}\p{N}_/.-]$") | right.rlike(r"^[\p{L}\p{N}_/@]"), 0),
    }


def _sort(symbol: Column) -> Column:
    """The sort of one symbol: letter, digit, white space, one of some marks, other; so few values whatever the corpus."""
    return (
        F.when(symbol == "", "").when(symbol.rlike(r"^\p{L}"), "a").when(symbol.rlike(r"^\p{N}"), "9").when(symbol.rlike(r"^\s"), "s")
        .when(symbol.isin(*".,:;=\"'()[]<>/-_@+#"), symbol).otherwise("o")
    )


def features(x: Column) -> dict[str, Column]:
    """Span features of the final classifier, each with few values."""
    return {
        "size": F.least(F.lit(8), (F.length(x["value"]) / 4).cast("int")).cast("string"),
        "digits": (10 * F.length(_digits(x["value"])) / F.length(x["value"])).cast("int").cast("string"),
        "marks": F.least(F.lit(6), F.length(F.regexp_replace(x["value"], r"[\p{L}\p{N}]", ""))).cast("string"),
        "before": _sort(F.right(x["left"], F.lit(1))),
        "after": _sort(F.left(x["right"], F.lit(1))),
    }


@dataclass
class Reliabilities:
    """By kind: the share of true spans. By kind and labeler: the chance of a right vote on true and on false spans."""

    prior: dict[int, float]
    right: dict[tuple[int, str], tuple[float, float]]

    def posterior(self, kind: int, vote: tuple) -> float:
        odds = math.log(self.prior[kind] / (1 - self.prior[kind]))
        for name, v in zip(LABELERS, vote, strict=True):
            if v is not None:
                true, false = self.right[kind, name]
                odds += math.log(true / (1 - false)) if v else math.log((1 - true) / false)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


#: What is believed of labelers at first: how often they vote for true spans and against false ones.
BELIEFS = {"form": (0.8, 0.8), "gazetteer": (0.8, 0.8), "context": (0.9, 0.9), "border": (0.8, 0.8)}


def expectation_maximisation(counts: dict[tuple[int, tuple], int], rounds: int = 25) -> Reliabilities:
    """counts: by kind and vote pattern. Two-class latent model with labelers independent given the class; BELIEFS to begin
    with, and as pseudo-counts, keep the classes' meaning."""
    kinds = {kind for kind, _ in counts}
    model = Reliabilities(dict.fromkeys(kinds, 0.5), {(k, n): BELIEFS[n] for k in kinds for n in LABELERS})
    for _ in range(rounds):
        expected = {key: model.posterior(*key) for key in counts}
        prior, right = {}, {}
        for kind in kinds:
            own = [(vote, n, expected[kind, vote]) for (k, vote), n in counts.items() if k == kind]
            prior[kind] = (2 + sum(n * p for _, n, p in own)) / (4 + sum(n for _, n, _ in own))
            for i, name in enumerate(LABELERS):
                true = sum(n * p for v, n, p in own if v[i] is not None)
                false = sum(n * (1 - p) for v, n, p in own if v[i] is not None)
                hit = sum(n * p for v, n, p in own if v[i] == 1)
                out = sum(n * (1 - p) for v, n, p in own if v[i] == 0)
                yes, no = BELIEFS[name]
                right[kind, name] = (10 * yes + hit) / (10 + true), (10 * no + out) / (10 + false)
        model = Reliabilities(prior, right)
    return model


def _posterior_column(model: Reliabilities, x: Column) -> Column:
    """The posterior log-odds of a candidate's votes as an expression."""
    vote = votes(x)
    total = F.lit(0.0)
    for kind, prior in sorted(model.prior.items()):
        odds = F.lit(math.log(prior / (1 - prior)))
        for name in LABELERS:
            true, false = model.right[kind, name]
            odds = odds + F.when(vote[name] == 1, math.log(true / (1 - false))).when(vote[name] == 0, math.log((1 - true) / false)).otherwise(0.0)
        total = F.when(x["kind"] == kind, odds).otherwise(total)
    return total


@dataclass
class Classifier:
    """Log-odds: by kind and vote pattern's posterior, and by kind, feature and value."""

    labels: Reliabilities
    odds: dict[tuple[int, str, str], float]

    def probability(self, x: Column) -> Column:
        """The labelers' log-odds, and the features' on top."""
        total = _posterior_column(self.labels, x)
        for name, value in features(x).items():
            known = [(f"{kind}:{v}", odds) for (kind, n, v), odds in self.odds.items() if n == name]
            if known:
                table = F.create_map(*[F.lit(part) for pair in known for part in pair])
                total = total + F.coalesce(F.element_at(table, F.concat_ws(":", x["kind"].cast("string"), value)), F.lit(0.0))
        return 1 / (1 + F.exp(-total))


FEATURE_WEIGHT = 0.5


def train(found: DataFrame) -> Classifier:
    """found: rows with `__pii_base` and `__pii_more`. Base spans take part in the estimates as well."""
    spans = found.select(F.explode(F.concat("__pii_base", "__pii_more")).alias("x"))
    x = F.col("x")
    # Votes and features of the few spans are computed once; what is brought to the driver has a row for each pattern.
    described = materialized(
        spans.select(x["kind"].alias("kind"), *[v.alias(f"v_{n}") for n, v in votes(x).items()], *[v.alias(f"f_{n}") for n, v in features(x).items()])
    )
    patterns = described.groupBy("kind", *[f"v_{n}" for n in LABELERS]).count().collect()
    model = expectation_maximisation({(r[0], tuple(r[1:-1])): r[-1] for r in patterns})
    names = list(features(x))
    votes_of = [F.col(f"v_{n}") for n in LABELERS]
    sums: dict[tuple[int, str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
    totals: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"f_{n}").alias("v")) for n in names])).alias("f")
    counted = described.select("kind", *votes_of, pairs).groupBy("kind", *[f"v_{n}" for n in LABELERS], "f.n", "f.v").count()
    for r in counted.toLocalIterator():
        kind, vote, name, value, n = r[0], tuple(r[1:-3]), r[-3], r[-2], r[-1]
        p = model.posterior(kind, vote)
        for cell in (sums[kind, name, value or ""], totals[kind]):
            cell[0] += n * p
            cell[1] += n * (1 - p)
    odds = {}
    for (kind, name, value), (yes, no) in sums.items():
        all_yes, all_no = (t / len(names) for t in totals[kind])
        odds[kind, name, value] = FEATURE_WEIGHT * math.log(((yes + 1) / (all_yes + 10)) / ((no + 1) / (all_no + 10)))
    return Classifier(model, odds)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])))


def with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with `__pii_base` and `__pii_spans`: base spans, and all of them with those that the
    classifier adds."""
    found = materialized(candidates(docs).select(*[F.col(f"`{c}`") for c in keep], "__pii_base", "__pii_more"))
    model = train(found)
    added = F.filter("__pii_more", lambda x: model.probability(x) >= THRESHOLD)
    return found.select(*[F.col(f"`{c}`") for c in keep], "__pii_base", F.array_sort(F.concat("__pii_base", added)).alias("__pii_spans"))


def _number(kind: str) -> Column:
    return F.size(F.filter("__pii_base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans, their number, and that of the secrets."""
    found = with_spans(docs.select("doc_id", "text"), ["doc_id"])
    return found.select(
        "doc_id",
        *[_number(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.col("__pii_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("__pii_spans")).alias("spans"),
        F.size("__pii_spans").cast("long").alias("n_spans"),
        F.size(F.filter("__pii_spans", lambda x: x["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars, if there, that of the new text. Of
    overlapping spans the one that begins first, then the longest, names the whole stretch."""
    found = with_spans(docs, docs.columns)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("__pii_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    found = found.withColumn("__pii_x", ordered)
    # Stretches of spans, each with the text from where the one before ended to where it ends itself.
    spans = lambda g: F.slice("__pii_x", g * STRETCH + 1, STRETCH)
    stretches = F.sequence(F.lit(0), F.floor((F.size("__pii_x") - 1) / STRETCH).cast("int"))
    last = F.transform(stretches, lambda g: -F.array_min(F.transform(spans(g), lambda x: x["end"])))
    ends = F.aggregate(last, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), n))))
    found = found.withColumn("__pii_e", F.when(F.size("__pii_x") > 0, ends).otherwise(F.array(F.lit(0))))

    def part(g: Column) -> Column:
        first = F.get("__pii_e", g)
        return F.struct(first.alias("first"), F.substring(F.col("text"), first + 1, F.get("__pii_e", g + 1) - first).alias("text"), spans(g).alias("spans"))

    found = found.withColumn("__pii_g", F.when(F.size("__pii_e") > 1, F.transform(F.sequence(F.lit(0), F.size("__pii_e") - 2), part)))

    def replaced(stretch: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            inside = -x["end"] <= acc["at"]
            overlap = x["start"] < acc["at"]
            before = F.substring(stretch["text"], acc["at"] - stretch["first"] + 1, x["start"] - acc["at"])
            out = F.when(overlap, acc["out"]).otherwise(F.concat(acc["out"], before, names[x["kind"]]))
            return F.struct(F.when(inside, acc["at"]).otherwise(-x["end"]).alias("at"), out.alias("out"))

        return F.aggregate(stretch["spans"], F.struct(stretch["first"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    rest = F.substring(F.col("text"), F.element_at("__pii_e", -1) + 1, F.char_length("text"))
    text = F.when(F.size("__pii_g") > 0, F.concat(F.array_join(F.transform("__pii_g", replaced), ""), rest)).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
