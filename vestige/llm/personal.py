"""Personal data: patterns propose spans, checksums confirm them, words near them adjust their scores.  DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import columns

#: Characters on either side of a span, up to the next span of its kind, in which context words count.
NEAR = 40
#: What a context word adds to a score, in hundredths; the least score of an added span.
CONTEXT, LEAST = 20, 50


class Kind(NamedTuple):
    """A kind of personal data.

    pattern: what proposes spans, with possessive or bounded repeats, so that it reads a text in one pass whatever stands there.  valid: what
    confirms a proposal.  words: context words.  score: in hundredths, before context.  needs: what a text without a span of this kind is
    told apart by at little cost.  base: spans of the contract, which stay whatever their score.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    words: str
    score: int
    needs: str
    base: bool


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """Running sums of an array of longs.  Blocks of about the square root of its length keep the copies of growing arrays few."""

    def sums(a: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + value(x))))

    def blocks(n: Column) -> Column:
        step = F.ceil(F.sqrt(n)).cast("int")
        inner = F.transform(F.sequence(F.lit(1), n, step), lambda at: sums(F.slice(sizes, at, step), lambda x: x))
        return let(inner, lambda parts: let(sums(parts, lambda p: F.element_at(p, -1)), lambda tops: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: x + F.get(tops, i))))))

    return let(F.size(sizes), lambda n: F.when(n > 0, blocks(n)).otherwise(F.array().cast("array<long>")))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def mod97(hit: Column) -> Column:
    """Whether an account number's check digits hold: the first four characters moved to its end, letters as 10 to 35, is 1 modulo 97."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(F.split(moved, "", -1), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SOCIAL = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), "mail|contact|write|escrib|schreib|courriel|correo", 75, "@", True),
    Kind("ip", r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}", lambda h: F.rlike(h, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")), "ip|addr|host|server|login|adresse", 60, ".", True),
    Kind("card", r"[0-9](?<![0-9][\x20-]?[0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", lambda h: F.call_function("luhn_check", digits(h)), "card|visa|credit|debit|karte|carte|tarjeta", 70, "", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: F.length(digits(h)).between(9, 15), "phone|call|tel|mobil|fax|anruf|llam", 60, "+", True),
    Kind("card", r"[0-9]{12,}+", lambda h: (F.length(h) <= 19) & F.call_function("luhn_check", h), "card|visa|credit|debit|karte|carte|tarjeta", 50, "", False),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", mod97, "iban|account|bank|konto|compte|cuenta", 80, "", False),
    Kind("social", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda h: F.rlike(h, F.lit(_SOCIAL)), "ssn|social|tax|security|insurance|versicherung", 35, "-", False),
)
_LISTED = ("email", "ip", "card", "phone", "iban", "social")
_SPAN = "array<struct<start:long,listed:int,stop:long,kind:string,score:int,base:boolean>>"


def proposed(text: Column, k: Kind) -> Column:
    """The confirmed spans of a kind in a text: start, listed (the kind's place), stop, kind, score, base; places count code points.

    A text is split where the pattern matches, so a match's place is the sum of the lengths before it, and its neighbourhood is the end of
    the gap before it and the start of the gap behind it: both are linear in the text.
    """

    def spans(hits: Column, gaps: Column) -> Column:
        ends = running(F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("long")))

        def one(e: Column, h: Column, i: Column) -> Column:
            before, after = F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))
            if k.name == "card" and k.base:  # the context of a card ends at any other number
                before, after = F.element_at(F.split(before, r"[0-9](?:[\x20-]?[0-9])++", -1), -1), F.element_at(F.split(after, r"[0-9](?:[\x20-]?[0-9])++", -1), 1)
            near = F.rlike(F.translate(F.concat(before, F.lit(" "), after), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(k.words))
            valid = k.valid(h)
            if not k.base:
                valid &= ~F.rlike(before, F.lit(r"[A-Za-z0-9]\z")) & ~F.rlike(after, F.lit("^[A-Za-z0-9]"))
            if k.name == "card" and not k.base:
                # The chain of digits that the run stands in, unless it reaches another run and so is too long for a card.
                bridge = F.lit(r"^[\x20-]?(?:[0-9][\x20-]?)*+\z")
                long = ((i > 0) & F.rlike(F.get(gaps, i), bridge)) | ((i < F.size(hits) - 1) & F.rlike(F.get(gaps, i + 1), bridge))
                chain = digits(F.concat(F.regexp_extract(before, r"(?:[0-9][\x20-]?)*\z", 0), h, F.regexp_extract(after, r"^(?:[\x20-]?[0-9])*", 0)))
                valid &= long | (F.length(chain) > 19) | ~F.call_function("luhn_check", chain)
            return F.struct((e - F.length(h)).alias("start"), F.lit(_LISTED.index(k.name)).alias("listed"), e.alias("stop"), F.lit(k.name).alias("kind"), (F.lit(k.score) + F.when(near, CONTEXT).otherwise(0)).alias("score"), F.lit(k.base).alias("base"), valid.alias("valid"))

        found = let(ends, lambda es: F.transform(hits, lambda h, i: one(F.get(es, i), h, i)))
        kept = F.filter(found, lambda s: s["valid"] if k.base else s["valid"] & (s["score"] >= LEAST))
        return F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "listed", "stop", "kind", "score", "base"))))

    found = let(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, k.pattern, -1), lambda gaps: spans(hits, gaps))).otherwise(F.array().cast(_SPAN)))
    return F.when(F.contains(text, F.lit(k.needs)), found).otherwise(F.array().cast(_SPAN)) if k.needs else found


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, found (its spans in order of start, then of kind as listed).

    Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.  Added ones have kind "card" (a run of 12 to 19
    digits that passes Luhn and lies in no base card), "iban" (modulo 97) and "social", and stay at a score of LEAST or more, so a social
    number needs a context word.  One pass, no shuffle.  Null and empty texts have no spans; repeated rows each get a row; a null doc_id
    stays null; a caller's other columns are not read; an empty table has no rows.
    """
    d = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    # The generator keeps what follows from computing the spans anew.
    rows = d.select("doc_id", F.inline(F.array(F.struct(F.concat(*(proposed(F.col("text"), k) for k in KINDS)).alias("found")))))
    return rows.select("doc_id", F.sort_array("found").alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_added and scores (hundredths, in the order of spans)."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    found = personal_data(docs).select("doc_id", F.inline(F.array(F.struct(F.filter("found", lambda s: s["base"]).alias("base"), F.col("found").alias("every")))))
    counts = (F.size(F.filter(F.transform("base", lambda s: s["kind"]), F.lit(n).__eq__)).cast("long").alias(f"n_{n}") for n in ("email", "ip", "card", "phone"))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_added"), F.array_join(F.transform("every", lambda s: s["score"].cast("string")), ",").alias("scores"))
