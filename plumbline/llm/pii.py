"""Personal data in texts: patterns, weak supervision, and a span classifier.

*Base.* Four patterns (email, ip, card, phone), leftmost and without overlap per kind,
with checks (parts of an address, Luhn's sum, number of digits). Base spans always stay.

*Candidates.* Wider patterns propose more spans of the same kinds: written-out mail
addresses and numbers without a country code. Those that overlap base spans are dropped.

*Labelers* vote on every span, base or not, for, against or not at all: the strict
pattern, a gazetteer (top-level domains, number prefixes), the words just before the span
for and against, what stands directly beside it, and its digits. How often which votes
occur together is counted over all documents: a few hundred rows at most, which is all
that reaches the driver. Expectation-maximisation finds how reliable each labeler is
and how likely each combination of votes is personal data. A logistic classifier of span
features is trained on those probabilities, and candidates it accepts are added.

All work on texts is done by expressions over single rows, without a shuffle. Positions
are sums of the lengths of what ``split`` and ``regexp_extract_all`` return. They are summed
up in groups, so that a text with many matches takes no quadratic time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows

KINDS = ("email", "ip", "card", "phone")
#: A candidate is added from this probability on.
ACCEPT = 0.5
#: Code points before and behind a span that labelers look at.
AROUND = 24
#: Lengths summed up together.
GROUP = 256

# The base patterns. Only runs of 12 to 19 digits can be cards, and a run
# starts where no digit stands before it, so the pattern may ask for that.
# A local part and an address start where their run of characters does, or where the last
# match ended, and nothing a quantifier took is given back: the matches are the same, long
# runs are passed once, and repeated groups need no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPOKEN = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[A-Za-z0-9-]++)++"
)
LOCAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"

_DOMAINS = (
    "com org net edu gov mil int info biz io de fr es it uk eu us ca au nl be ch at se no dk "
    "fi pl pt ie jp cn in br mx ru"
)
_CUES = {
    "email": "mail|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|number|contact|telefon|mobil",
}
_AGAINST = "version|release|section|chapter|isbn|issn|doi|page|figure|table|serial|build"


# ---------------------------------------------------------------- spans


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, b: a + b)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("bigint"))
    spans = F.transform(hits, lambda h: F.char_length(h).cast("bigint"))
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), spans, lambda a, b: a + b)
    groups = F.ceil(F.size(hits) / GROUP).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), groups - 1), lambda g: _total(F.slice(steps, g * GROUP + 1, F.lit(GROUP)))
    )
    before = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: _total(F.slice(sums, F.lit(1), g)))
    parts = F.struct(hits.alias("hits"), gaps.alias("gaps"), spans.alias("spans"), steps.alias("steps"),
                     before.alias("before"))

    def place(p: Column, hit: Column, i: Column) -> Column:
        group = F.floor(i / GROUP).cast("int")
        start = (
            F.get(p["before"], group)
            + _total(F.slice(p["steps"], group * GROUP + 1, i % GROUP))
            + F.get(p["gaps"], i)
        )
        return F.struct(
            start.alias("start"), (start + F.get(p["spans"], i)).alias("end"), hit.alias("hit")
        )

    # the parts are worked out once per text, as the only element of an array
    each = F.transform(F.array(parts), lambda p: F.transform(p["hits"], lambda h, i: place(p, h, i)))
    return F.when(F.size(hits) > 0, F.flatten(each)).otherwise(F.lit(None))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _is_address(hit: Column) -> Column:
    def fits(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.when(F.length(plain) <= 3, F.concat(F.lit("0"), plain)).cast("int") <= 255)

    return F.forall(F.split(hit, r"\."), fits)


def _luhn(hit: Column) -> Column:
    digits = F.reverse(_digits(hit))

    def worth(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def _base(text: Column) -> Column:
    """All base spans of a text as array<struct<kind, strict, start, end, hit>>."""
    found = {
        "email": (F.contains(text, F.lit("@")), EMAIL, lambda h: F.lit(True)),
        "ip": (F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), IP, _is_address),
        "card": (F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), CARD, _luhn),
        "phone": (
            F.contains(text, F.lit("+")), PHONE, lambda h: F.length(_digits(h)).between(9, 15)
        ),
    }
    return _joined(text, [(k, True, *v) for k, v in found.items()])


def _wider(text: Column) -> Column:
    return _joined(
        text,
        [
            ("email", False, F.rlike(text, F.lit(r"[(\[]\x20?at\x20?[)\]]")), SPOKEN, lambda h: F.lit(True)),
            ("phone", False, F.rlike(text, F.lit(r"[0-9]{3}[.-][0-9]{4}")), LOCAL, lambda h: F.lit(True)),
        ],
    )


_SPANS = "array<struct<kind:int,strict:boolean,start:bigint,end:bigint,hit:string>>"


def _joined(text: Column, parts: list[tuple]) -> Column:
    lists = []
    for kind, strict, guard, pattern, fits in parts:
        spans = _named(located(text, pattern), kind, strict, fits)
        some = F.when(guard, spans).otherwise(F.lit(None))
        lists.append(F.coalesce(some.cast(_SPANS), F.array().cast(_SPANS)))
    return F.concat(*lists)


def _named(spans: Column, kind: str, strict: bool, fits) -> Column:
    return F.transform(
        F.filter(spans, lambda s: fits(s["hit"])),
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"),
            s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
        ),
    )


# ---------------------------------------------------------------- labelers

#: What the classifier sees of a span, one bit each.
BITS = ("strict", "listed", "cue", "against", "glued", "plain")


def _bits(span: Column, text: Column) -> Column:
    """The features of a span as a number; see ``BITS``."""
    hit, kind = span["hit"], span["kind"]
    start = span["start"].cast("int")
    begin = F.greatest(F.lit(0), start - AROUND)
    before = F.lower(F.substring(text, begin + 1, start - begin))
    last = F.substring(before, F.length(before), F.lit(1))
    behind = F.substring(text, span["end"].cast("int") + 1, F.lit(1))
    domain = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    digits = _digits(hit)
    first = F.substring(digits, F.lit(1), F.lit(1))
    listed = (
        F.when(kind == 0, domain.isin(_DOMAINS.split()))
        .when(kind == 1, ~first.isin("0") & ~F.rlike(hit, F.lit(r"^(?:0|22[4-9]|2[3-5][0-9])\.")))
        .when(kind == 2, first.isin("3", "4", "5", "6"))
        .otherwise(~first.isin("0"))
    )
    cue = F.lit(False)
    for i, words in enumerate(_CUES.values()):
        cue = F.when(kind == i, F.rlike(before, F.lit(f"(?:{words})"))).otherwise(cue)
    glued = F.rlike(last, F.lit("[a-z0-9_]")) | F.rlike(behind, F.lit("[A-Za-z0-9_]"))
    flags = (
        span["strict"], listed, cue, F.rlike(before, F.lit(f"(?:{_AGAINST})")), glued,
        (digits != "") & F.rlike(digits, F.lit(r"^([0-9])\1*$")),
    )
    total = F.lit(0)
    for i, flag in enumerate(flags):
        total = total + F.when(flag, 1 << i).otherwise(0)
    return total


def votes(bits: int) -> list[int]:
    """For (1), against (-1) or nothing (0), by labeler.

    Strict pattern, gazetteer, cue words, words against, what stands beside, digits.
    """
    strict, listed, cue, against, glued, plain = (bits >> i & 1 for i in range(len(BITS)))
    return [strict, 1 if listed else -1, cue, -against, -1 if glued else 0, -1 if plain else 0]


# ---------------------------------------------------------------- learning


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50):
    """Expectation-maximisation over combinations of votes.

    ``counts``: spans by (kind, bits). Returns the probability of each combination to be
    personal data, and for each labeler its vote's probabilities given yes and given no.
    Starts from the majority; counts are smoothed, so nothing becomes certain.
    """
    if not counts:
        return {}, []
    ballots = {key: votes(key[1]) for key in counts}
    likely = {k: 1 / (1 + math.exp(-1.5 * sum(v))) for k, v in ballots.items()}
    width = len(next(iter(ballots.values())))
    table: list[dict] = []
    for _ in range(rounds):
        table = []
        for j in range(width):
            cells = {(truth, vote): 1.0 for truth in (0, 1) for vote in (-1, 0, 1)}
            for key, vote in ballots.items():
                cells[1, vote[j]] += counts[key] * likely[key]
                cells[0, vote[j]] += counts[key] * (1 - likely[key])
            for truth in (0, 1):
                whole = sum(cells[truth, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    cells[truth, v] /= whole
            table.append(cells)
        share = {}
        for kind in {k for k, _ in counts}:
            own = [k for k in counts if k[0] == kind]
            yes = sum(counts[k] * likely[k] for k in own) + 1
            share[kind] = yes / (sum(counts[k] for k in own) + 2)
        for key, vote in ballots.items():
            odds = math.log(share[key[0]] / (1 - share[key[0]]))
            odds += sum(math.log(table[j][1, v] / table[j][0, v]) for j, v in enumerate(vote))
            likely[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return likely, table


def trained(counts: dict[tuple[int, int], int], likely: dict, steps: int = 400) -> list[float]:
    """Weights of a logistic classifier: one per kind, then one per bit."""
    size = len(KINDS) + len(BITS)
    weights = [0.0] * size
    total = sum(counts.values())
    if not total:
        return weights
    inputs = {
        key: [float(key[0] == k) for k in range(len(KINDS))] + [float(key[1] >> i & 1) for i in range(len(BITS))]
        for key in counts
    }
    for _ in range(steps):
        slope = [1e-3 * w for w in weights]
        for key, x in inputs.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            pull = counts[key] / total * (p - likely[key])
            slope = [s + pull * a for s, a in zip(slope, x)]
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def _accepted(kind: Column, bits: Column, weights: list[float]) -> Column:
    worth = F.lit(0.0)
    for k in range(len(KINDS)):
        worth = worth + F.when(kind == k, F.lit(weights[k])).otherwise(0.0)
    for i in range(len(BITS)):
        worth = worth + F.when(bits.bitwiseAND(1 << i) > 0, F.lit(weights[len(KINDS) + i])).otherwise(0.0)
    return worth >= math.log(ACCEPT / (1 - ACCEPT))


# ---------------------------------------------------------------- queries


def _spelled(spans: Column) -> Column:
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = rows.pick(docs, doc_id=id_column, text=text_column).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    found = text.select("doc_id", "text", _base(F.col("text")).alias("base"), _wider(F.col("text")).alias("wide"))
    apart = F.filter(
        "wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    )
    apart = F.when(F.size("wide") > 0, apart).otherwise(F.col("wide"))
    return found.select("doc_id", "text", "base", apart.alias("wide"))


def _with_bits(spans: Column, text: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                           _bits(s, text).alias("bits")),
    )


def model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
    """Classifier weights, and the labelers' estimated reliabilities."""
    found = _candidates(docs, id_column, text_column).where("size(base) + size(wide) > 0")
    every = F.concat(_with_bits(F.col("base"), F.col("text")), _with_bits(F.col("wide"), F.col("text")))
    tally = found.select(F.explode(every).alias("s")).groupBy("s.kind", "s.bits").count()
    counts = {(r.kind, r.bits): r["count"] for r in tally.orderBy("kind", "bits").collect()}
    likely, table = reliabilities(counts)
    return trained(counts, likely), table


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of base spans; ``spans`` holds base and added ones as
    kind:start:end by start, then kind. NULL counts as the empty text, without spans.
    Without any span there is nothing to learn, and nothing is added. Repeated rows are
    treated each for itself. An empty table gives no rows. Extra columns are ignored.
    """
    weights, _ = model(docs, id_column, text_column)
    found = _candidates(docs, id_column, text_column)
    marked = found.select(
        "doc_id", "base",
        F.when(F.size("wide") > 0, _with_bits(F.col("wide"), F.col("text"))).alias("wide"),
    )
    added = F.filter("wide", lambda s: _accepted(s["kind"], s["bits"], weights))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    extra = F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(plain, F.coalesce(extra, F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))

    def count(kind: str) -> Column:
        number = KINDS.index(kind)
        found = F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint")
        return found.alias(f"n_{kind}")

    return marked.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(_spelled(plain), 256).alias("base_sha256"), _spelled(every).alias("spans"),
    )
