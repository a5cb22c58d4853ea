"""Personal data: regular expressions propose, checksums confirm, context scores.

Every kind has a pattern whose leftmost non-overlapping matches are proposed,
and a validator that confirms them; a match that fails is dropped and not
retried, but for ``iban``.  Base kinds: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19
digits passing Luhn) and ``phone`` (9 to 15 digits).  The method adds ``iban`` (15
to 34 letters and digits that pass mod-97), ``ipv6`` (eight groups, or fewer about
one ``::``), ``key`` (access key identifiers of a known form) and ``secret`` (a value
of at least 16 characters, letters and digits both, given to a password, token or
the like).  The pattern of ``iban`` proposes a whole run of words of capitals and
digits; an account number is looked for from each of its words, up to the end of
any other.  A span's score starts at its kind's prior and rises when a word that
goes with the kind stands within ``CONTEXT`` code points before it, and behind the
match before.

Offsets count code points, ends are exclusive.  ``split`` and
``regexp_extract_all`` with one pattern see the same matches, so the lengths of
the pieces between matches and of the matches give every offset in one fold.  The
fold works in blocks of matches, since an array that grows by one at a time is
copied each time.  The patterns are written for Java's engine: possessive
groups iterate instead of recursing, and a look-behind stops a long run of
characters from being tried again at each of its positions.  Null text counts as
empty and has no spans.  Repeated rows have equal spans.  Other columns stay, but
for those named ``pii_<kind>``, which are replaced.  Only built-in column functions
run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions.arrays import let, matches, scan

LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> (pattern, character without which there is no match, prior score, context words)
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|kontakt|correo|courriel|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|addr|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.7, "card|karte|carte|tarjeta|visa|credit|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobil|fax"),
    "iban": (r"(?:\G|(?<![A-Z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++", None, 0.8, "iban|bank|konto|account|compte|cuenta"),
    "ipv6": (r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+:(?:[0-9A-Fa-f]{0,4}+:){1,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])", ":", 0.6, "ip|addr|host|server|login"),
    "key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", "IA", 0.8, "key|aws|access|secret"),
    "secret": (r"(?i)(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{16,}+", None, 0.7, "user|login|account|config"),
}
BASE = ("email", "ip", "card", "phone")
#: Lengths of account numbers by country; others are accepted too, these go first.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 "
    "MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
#: Code points before a span in which context words count, and what they add.
CONTEXT, BONUS = 40, 0.2


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass Luhn: every second from the right doubled, its digits summed."""
    digits = F.split(F.reverse(_digits(value)), "")
    numbers = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(
            F.try_to_number(d, F.lit("9")).cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)
        ),
    )
    return F.coalesce(F.aggregate(numbers, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0, F.lit(False))


def _mod97(value: Column) -> Column:
    """Whether the account number, its first four characters moved to the end, leaves 1 by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            parts, lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(999)) <= 255
        )
    if kind == "ipv6":
        short, groups = F.contains(value, F.lit("::")), F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
        clean = ~F.contains(value, F.lit(":::")) & ~F.substr(value, F.instr(value, "::") + 2).contains("::") & ~value.rlike("^:[^:]|[^:]:$")
        return clean & F.when(short, groups.between(1, 7)).otherwise(groups == 8)
    if kind == "key":
        return F.lit(True)
    if kind == "secret":
        given = F.regexp_extract(value, r"[A-Za-z0-9+/_-]+$", 0)
        return given.rlike("[0-9]") & given.rlike("[A-Za-z]")
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(value)).otherwise(F.lit(False))
    return n.between(9, 15)


def _account(rest: Column) -> Column:
    """The account number that begins ``rest``, or an empty string.

    It ends with a word; of several ends that of the country's length is taken,
    else the last one.
    """
    size = lambda k: F.char_length(F.replace(F.left(rest, k), F.lit(" "), F.lit("")))
    stops = lambda k: (F.char_length(rest) >= k) & F.substr(rest, k + 1, F.lit(1)).isin("", " ")
    ends = F.filter(F.sequence(F.lit(15), F.lit(67)), lambda k: stops(k) & size(k).between(15, 34) & _mod97(F.left(rest, k)))
    usual = F.filter(ends, lambda k: F.contains(F.lit(IBAN_LENGTHS), F.concat(F.left(rest, F.lit(2)), size(k).cast("string"))))
    return F.left(rest, F.coalesce(F.array_max(usual), F.array_max(ends), F.lit(0)))


FOUND = "array<struct<start:int,value:string,before:string>>"
#: Characters of an account number with a blank between any two, and one behind.
REACH = 68


def _accounts(value: Column, begin: Column, before: Column) -> Column:
    """The account numbers within a match, none over another."""

    def hits(words: Column) -> Column:
        def hit(word: Column, i: Column) -> Column:
            rest = F.left(F.array_join(F.transform(F.slice(words, i + 1, 34), lambda w: F.left(w, F.lit(REACH))), " "), F.lit(REACH))
            found = F.when(word.rlike("^[A-Z]{2}[0-9]{2}"), let(rest, _account)).otherwise("")
            return F.struct(F.char_length(word).alias("size"), found.alias("hit"))

        return F.transform(words, hit)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        size = F.char_length(x["hit"])
        good = (size > 0) & (state["at"] >= state["free"])
        one = F.array(F.struct(state["at"].alias("start"), x["hit"].alias("value"), before.alias("before")))
        after = F.struct((state["at"] + x["size"] + 1).alias("at"), F.when(good, state["at"] + size).otherwise(state["free"]).alias("free"))
        return after, F.when(good, one).otherwise(F.array().cast(FOUND))

    first = F.struct(begin.alias("at"), begin.alias("free"))
    found = scan(let(F.split(value, " "), hits), first, step, FOUND)
    return F.when(F.char_length(value) >= 15, found).otherwise(F.array().cast(FOUND))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def kind_spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order."""
    pattern, needed, prior, words = KINDS[kind]

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin, before = at + F.char_length(x["gap"]), F.right(x["gap"], F.lit(CONTEXT))
        if kind == "iban":
            found = _accounts(x["hit"], begin, before)
        else:
            one = F.array(F.struct(begin.alias("start"), x["hit"].alias("value"), before.alias("before")))
            found = F.when(_valid(kind, x["hit"]), one).otherwise(F.array().cast(FOUND))
        return begin + F.char_length(x["hit"]), found

    def scored(x: Column) -> Column:
        near = F.lower(x["before"]).rlike(rf"(?:{words})")
        return F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            (x["start"] + F.char_length(x["value"])).alias("end"),
            (F.lit(prior) + F.when(near, BONUS).otherwise(0.0)).alias("score"),
        )

    spans = F.transform(scan(matches(text, pattern), F.lit(0), step, FOUND), scored)
    present = F.contains(text, F.lit(needed)) if needed else text.rlike("(?i)password|passwd|secret|token|api[_-]?key" if kind == "secret" else "[0-9]")
    return F.when(present, spans).otherwise(F.array().cast(SPANS))


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``pii_<kind>`` of spans (kind, start, end, score) for each kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({f"pii_{kind}": kind_spans(text, kind) for kind in KINDS})


def span_digest(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the given kinds' spans in their order, comma-joined."""
    spans = F.concat(*[F.col(f"pii_{k}") for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
