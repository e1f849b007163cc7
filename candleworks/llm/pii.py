"""Personal data, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (part ranges, digit
counts, Luhn, mod-97), and context words near a span raise its score. A span is
reported if its score reaches `min_score`; the base kinds (email, ip, card, phone)
always do once confirmed. Added kinds are `iban` (mod-97 confirmed), `ssn` and
`local_phone` (both need a context word); one that overlaps a base span is dropped.

Splitting a text by a pattern gives the pieces between its matches, so the lengths
of pieces and matches give positions without a search for each match. The patterns
are the plain ones of `BASE_PATTERNS` written with possessive quantifiers, and with
matches that start only where a run of their first class starts (or the last match
ended), which finds the same spans in linear time and constant stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns, as specified.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # for Java's engine
    hint: str  # texts without a match of it are not searched
    score: float  # once confirmed
    context: str  # words that raise the score by 0.5, looked for on both sides of the span
    tag: str
    neighbours: str = ""  # characters that may not touch the span


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write", "<EMAIL>"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server", "<IP>"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.8, "card|visa|credit|payment", "<CARD>"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax|cell", "<PHONE>"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9]{1,3})?)", "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank", "<IBAN>", "[A-Za-z0-9]"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", 0.3, "ssn|social security", "<SSN>", "[0-9-]"),
    Kind("local_phone", r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", "[0-9]{3}[ .-][0-9]{4}", 0.3, "phone|tel|call|mobile|fax|cell", "<PHONE>", "[0-9+.-]"),
]
BASE = ("email", "ip", "card", "phone")

#: Characters on each side of a span in which context words count, and how many matches
#: of the added kinds, of 11 characters at least, they can hold.
NEAR, MATCHES_NEAR = 40, 4

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda part: let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255)))
    if kind.name == "card":
        return let(digits(match), lambda n: F.when((F.length(n) >= 13) & (F.length(n) <= 19), luhn(n)).otherwise(False))
    if kind.name == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind.name == "iban":
        return let(F.regexp_replace(match, " ", ""), lambda n: F.length(n).between(15, 34) & mod97(n))
    if kind.name == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def clear(kind: Kind, left: Column, right: Column) -> Column:
    """Nothing that may not touch the span does."""
    if not kind.neighbours:
        return F.lit(True)
    return ~F.right(left, F.lit(1)).rlike(kind.neighbours) & ~F.left(right, F.lit(1)).rlike(kind.neighbours)


def score(kind: Kind, pieces: Column, matches: Column, i: Column) -> Column:
    """Score of match i, with context from the text on both sides of it."""
    piece = lambda k: F.coalesce(F.get(pieces, i + k), F.lit(""))
    match = lambda k: F.coalesce(F.get(matches, i + k), F.lit(""))
    reach = range(MATCHES_NEAR, 0, -1)
    before = F.concat(*[x for k in reach for x in (piece(-k), match(-k))], piece(0))
    after = F.concat(piece(1), *[x for k in range(1, MATCHES_NEAR + 1) for x in (match(k), piece(k + 1))])
    near = F.lower(F.right(before, F.lit(NEAR))).rlike(kind.context) | F.lower(F.left(after, F.lit(NEAR))).rlike(kind.context)
    return F.least(F.lit(kind.score) + F.when(near, 0.5).otherwise(0.0), F.lit(1.0))


def running(values: Column, zero: Column, add) -> Column:
    """add over each value and all before it, in blocks of 256, so that many values cost
    little more than a few."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int")), lambda b: F.aggregate(F.slice(values, b * 256 + 1, F.lit(256)), zero, add))

    def at(blocks: Column, i: Column) -> Column:
        block = F.floor(i / 256).cast("int")
        whole = F.aggregate(F.slice(blocks, F.lit(1), block), zero, add)
        return F.aggregate(F.slice(values, block * 256 + 1, i % 256 + 1), whole, add)

    return let(blocks, lambda blocks: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(blocks, i)))


def starts(pieces: Column, matches: Column) -> Column:
    """Code-point position of every match: running sums of the lengths before it."""
    before = F.transform(F.sequence(F.lit(0), F.size(matches) - 1), lambda i: (F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0)).cast("long"))
    return let(before, lambda steps: running(steps, F.lit(0).cast("long"), lambda a, x: a + x))


def found(kind: Kind, text: Column) -> Column:
    """Array of the reported spans of one kind, in order."""

    def spans(pieces: Column, matches: Column) -> Column:
        def one(at: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size(matches) - 1),
                lambda i: let(
                    F.get(matches, i),
                    lambda m: F.when(
                        F.coalesce(confirmed(kind, m) & clear(kind, F.get(pieces, i), F.get(pieces, i + 1)), F.lit(False)),
                        F.struct(F.lit(kind.name).alias("kind"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), score(kind, pieces, matches, i).alias("score")),
                    ),
                ),
            )

        return let(starts(pieces, matches), one)

    searched = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    either = let(searched, lambda matches: F.when(F.size(matches) > 0, let(F.split(text, kind.pattern, -1), lambda pieces: spans(pieces, matches))))
    kept = F.filter(F.when(text.rlike(kind.hint), either), lambda s: s.isNotNull())
    return F.coalesce(kept, F.array().cast(T.ArrayType(SPAN)))


def detect(docs: DataFrame, text_col: str = "text", keep=None, min_score: float = 0.5) -> DataFrame:
    """docs with base_spans and spans: arrays of (kind, start, end, score), by kind as
    KINDS lists them, then by start; positions count code points, ends are exclusive.

    Null and empty texts have none. Rows, repeated or not, are searched one by one.
    Columns of docs named base_spans or spans are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base_spans", "spans")]
    text = F.col("__text")
    df = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for kind in KINDS:
        df = df.withColumn(f"__{kind.name}", found(kind, text))
    df = df.withColumn("base_spans", F.concat(*[F.col(f"__{k}") for k in BASE]))
    added = F.concat(*[F.col(f"__{k.name}") for k in KINDS if k.name not in BASE])
    free = F.when(
        F.size(added) > 0,
        F.filter(added, lambda s: (s["score"] >= min_score) & ~F.exists(F.col("base_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
    )
    df = df.withColumn("spans", F.concat("base_spans", F.coalesce(free, F.array().cast(T.ArrayType(SPAN)))))
    return df.select(*[F.col(f"`keep_{c}`").alias(c) for c in names], "base_spans", "spans")


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def cut_out(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the tag of the first, the longest
    of those that begin there."""
    tag = F.create_map(*[x for k in KINDS for x in (F.lit(k.name), F.lit(k.tag))])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.element_at(tag, s["kind"]).alias("tag"))))

    def pieces(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: -s["back"])

        def one(reach: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                covered = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("long"))
                between = F.substring(text, (covered + 1).cast("int"), F.greatest(s["start"] - covered, F.lit(0)).cast("int"))
                return F.concat(between, F.when(s["start"] >= covered, s["tag"]).otherwise(""))

            tail = F.substring(text, (F.get(reach, F.size(reach) - 1) + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(F.transform(ordered, piece), ""), tail)

        return let(let(ends, lambda e: running(e, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))), one)

    return F.when(F.size(spans) > 0, let(ordered, pieces)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """docs with the spans that `detect` reports in text_col replaced by tags. All spans are
    found in the original text, which is cut once. A null text stays null, an empty one
    empty; other columns are untouched."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("keep_row"), F.col(text_col).alias("keep_text"))
    found = detect(row, "keep_text", min_score=min_score)
    new = F.when(F.col("keep_text").isNotNull(), cut_out(F.col("keep_text"), F.col("spans")))
    return found.select(*[new.alias(c) if c == text_col else F.col("keep_row").getField(c).alias(c) for c in docs.columns])
