"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds email, ip, card and phone follow the base rules: leftmost matches that do not overlap, failing ones dropped without another try.
The expressions used here are stricter forms with equal results: a look-behind pins a match to the place where the base expression must start,
so a run of letters or digits is walked once, and cards of a wrong length are never proposed.  The method adds

    iban   15 to 34 letters and digits, remainder 1 by mod-97
    ssn    ddd-dd-dddd, kept only where a word near it names such a number

Each span has a score: a start value by kind and checksum, plus ``bonus`` if a context word of its kind occurs within ``reach`` code points.
Base spans stay whatever their score; added kinds need ``least``.

Loops over groups are possessive or bounded, so no text is too long for Java's engine, which recurses for others.  Time grows with the length of a text plus
its matches: a text is cut at the matches once, places are running sums, and context comes from the pieces next to a match.

Positions are code points, end exclusive.  Null text counts as empty.  Rows that repeat a doc_id are each searched.  Other columns are ignored;
an empty table gives no rows.  Everything is built of Spark's own functions.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import text_or_empty

_LOCAL = "[A-Za-z0-9._%+-]"
_SHORTEST = 5  # code points of the shortest match of any kind


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    added: bool = False


#: Order of the kinds decides between spans with one start.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|write|contact|schreib|courriel|correo"),
    Kind("ip", r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|host|server|address|adresse"),
    Kind("card", r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.5, "phone|tel|call|mobile|fax|anruf"),
    Kind("iban", r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.9, "iban|bank|account|konto|compte|cuenta", True),
    Kind("ssn", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security", True),
)


@dataclass(frozen=True)
class Scoring:
    reach: int = 40
    bonus: float = 0.3
    least: float = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit doubled, its digits added."""
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder of an account number: its first four places go last, letters count 10 to 35."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(r: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substr(F.concat(F.lit("000"), p), F.lit(-3)).cast("int") <= 255))
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "iban":
        bare = F.replace(hit, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & (mod97(bare) == 1)
    return F.lit(True)


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column, chunk: int = 256) -> Column:
    """Sums of an array of integers up to each place.  Chunks are summed by themselves, as a fold copies its result at each step."""
    def fold(some: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(some, zero, add, lambda s: s["out"])

    def of(values: Column) -> Column:
        places = F.sequence(F.lit(0), ((F.size(values) - 1) / chunk).cast("int"))
        inside = F.transform(places, lambda c: fold(F.slice(values, c * chunk + 1, F.lit(chunk))))
        return _bound(inside, lambda parts: _bound(
            fold(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda ends: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i == 0, 0).otherwise(F.get(ends, i - 1)))))))

    return _bound(lengths, lambda values: F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(of(values)))


def _proposed(text: Column, kind: Kind, scoring: Scoring) -> Column:
    """Matches with their places and the text near them: the text between matches and the matches themselves add up to the positions."""
    reach, pairs = scoring.reach, -(-scoring.reach // _SHORTEST)

    def edges(piece: Column) -> Column:
        return F.when(F.length(piece) <= 2 * reach, piece).otherwise(F.concat(F.left(piece, F.lit(reach)), F.right(piece, F.lit(reach))))

    def near(pieces: Column, i: Column) -> Column:
        """Gap i has place 2i, match i place 2i + 1; so many pairs of them hold ``reach`` code points."""
        first = F.greatest(2 * i - 2 * pairs, F.lit(0))
        before = F.array_join(F.slice(pieces, first + 1, 2 * i + 1 - first), "")
        after = F.array_join(F.slice(pieces, 2 * i + 3, F.lit(2 * pairs + 1)), "")
        return F.concat(F.right(before, F.lit(reach)), F.lit(" "), F.left(after, F.lit(reach)))

    def walk(cut: Column) -> Column:
        hits, gaps = cut["hits"], cut["gaps"]
        ends = running_sums(F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i))))
        pieces = F.flatten(F.transform(gaps, lambda g, i: F.array(edges(g), F.coalesce(edges(F.get(hits, i)), F.lit("")))))
        return _bound(F.struct(ends.alias("ends"), pieces.alias("pieces")), lambda x: F.transform(hits, lambda h, i: F.struct(
            (F.get(x["ends"], i) - F.length(h)).alias("start"), F.get(x["ends"], i).alias("end"), h.alias("hit"), near(x["pieces"], i).alias("near"))))

    cut = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))
    # cheap tests first: most texts hold no such mark at all
    mark = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind.name, F.lit(True))
    return F.when(mark & F.rlike(text, F.lit(kind.pattern)), _bound(cut, walk)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,near:string>>"))


def _scored(found: Column, rank: int, kind: Kind, scoring: Scoring) -> Column:
    def one(x: Column) -> Column:
        score = F.lit(kind.score) + F.when(F.rlike(x["near"], F.lit(rf"(?i)(?<![A-Za-z])(?:{kind.context})")), scoring.bonus).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), F.least(F.lit(1.0), score).alias("score"))

    spans = F.transform(F.filter(found, lambda x: _confirmed(kind.name, x["hit"])), one)
    return (F.filter(spans, lambda s: s["score"] >= scoring.least) if kind.added else spans).cast(_SPAN)


def find_spans(docs: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """doc_id, spans: array of (start, rank, end, kind, score) by start, then kind."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", *[_proposed(F.col("text"), k, scoring).alias(k.name) for k in KINDS])
    parts = [_scored(F.col(k.name), i, k, scoring) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, top_score for every row of documents."""
    base = [k.name for k in KINDS if not k.added]
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    of_base = F.filter("spans", lambda s: s["rank"] < len(base))
    return find_spans(docs, scoring).select(
        "doc_id", *[count(n) for n in base], F.sha2(_listed(of_base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(of_base)).cast("long").alias("n_added"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
