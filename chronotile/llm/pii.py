"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (ranges of an address, Luhn for cards, digit counts for
phones, mod-97 for IBANs), and words near a span adjust its score. Base kinds: email, ip, card, phone. Added kinds:
iban (mod-97), ssn (kept only if a nearby word lifts its score to KEEP_SCORE; base spans stay at any score).

An IBAN is proposed at the length of its country code; the match itself takes only the country code and check digits and
looks ahead for the rest, so that a proposal that fails hides none that starts inside it. Valid IBANs that overlap are all
returned.

Places come from the texts between matches: ``split`` by a pattern and ``regexp_extract_all`` walk the same matches, so
a match starts where the texts and matches before it end. Sums run in two levels (RUN matches, then runs), so a text
with very many matches stays near linear. The patterns consume whole runs and never go back into one, which keeps
them linear on long texts without changing what they match: a try inside a run could only fail as its start did.

Cases: null text counts as empty for finding and stays null when redacted; empty text has no spans; overlapping spans
of different kinds are all returned and are redacted as one; repeated rows are treated alike; null ids are kept.
Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import fresh, prepare

RUN = 64
CONTEXT = 40  # code points before and after a span in which words count
LONGEST_IBAN = 66  # with spaces
KEEP_SCORE = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN_LENGTHS = {  # characters without spaces, of the IBAN registry and of the countries that use IBANs without an entry in it
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?=((?:{})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}".format(  # group 1 is the whole
    "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()))
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum holds for a string of digits."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: the rearranged number leaves 1 when divided by 97."""
    flat = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        a = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(a < 58, rest * 10 + a - 48).otherwise(rest * 100 + a - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _between(x: Column, low: int, high: int) -> Column:
    return (x >= low) & (x <= high)


#: kind, pattern, what a text must contain to be searched, validator, score, words nearby and what they add
KINDS = (
    ("email", EMAIL, "@", lambda m: F.lit(True), 0.9, "mail|contact|write|kontakt|correo|courriel", 0.1),
    ("ip", IP, ".", lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"), 0.6, r"\bip\b|address|host|server|adresse", 0.3),
    ("card", CARD, None, lambda m: F.when(_between(F.length(_digits(m)), 16, 19), luhn(_digits(m))).otherwise(False), 0.7,
     "card|visa|credit|karte|carte|tarjeta|payment", 0.3),
    ("phone", PHONE, "+", lambda m: _between(F.length(_digits(m)), 8, 15), 0.6, "phone|tel|call|mobile|fax", 0.3),
    ("iban", IBAN, None, mod97, 0.9, "iban|bank|account|konto|compte|cuenta", 0.1),
    ("ssn", SSN, "-", lambda m: F.lit(True), 0.3, "ssn|social security", 0.5),
)
BASE = ("email", "ip", "card", "phone")
TAKEN = {"iban": 4}  # code points that a match takes from the text where the rest is only looked at; its span is group 1
_SPAN = "array<struct<kind:int,start:int,end:int,score:double>>"


def _offsets(sizes: Column) -> Column:
    """Sum of the entries before each entry."""
    runs = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))

    def sums(a: Column) -> Column:
        empty = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(a, empty, lambda s, x: F.struct((s["total"] + x).alias("total"), F.array_append(s["at"], s["total"]).alias("at")))

    inner = F.transform(runs, lambda r: sums(F.slice(sizes, r * RUN + 1, RUN)))
    before = sums(F.transform(inner, lambda s: s["total"]))["at"]
    return F.flatten(F.zip_with(inner, before, lambda s, b: F.transform(s["at"], lambda x: x + b)))


def _spans_of(df: DataFrame, text: str, k: int) -> tuple[DataFrame, str]:
    """Add the spans of one kind in steps, so that each expression is computed once; returns the new column's name."""
    kind, pattern, need, valid, score, words, lift = KINDS[k]
    hit, gap, at, tails, heads, span = (fresh(df, f"{x}_{kind}") for x in ("hit", "gap", "at", "tails", "heads", "span"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(1 if kind in TAKEN else 0))
    df = df.withColumn(hit, hits if need is None else F.when(F.contains(body, F.lit(need)), hits).otherwise(none))
    df = df.withColumn(gap, F.when(F.size(hit) > 0, F.split(body, pattern, -1)).otherwise(none))
    sizes = F.flatten(F.zip_with(hit, F.slice(gap, 1, F.size(hit)), lambda h, g: F.array(F.length(g), F.lit(TAKEN[kind]) if kind in TAKEN else F.length(h))))
    # Context comes from the ends of the texts between matches and of the matches, in turn: every match takes at least two
    # code points, so ``reach`` + 1 pieces hold ``reach`` of them. What a match only looks at lies in the pieces after it.
    took = TAKEN.get(kind)
    reach = CONTEXT + (LONGEST_IBAN - took if took else 0)

    def pieces(cut) -> Column:
        taken = F.transform(hit, lambda h: cut(F.left(h, F.lit(took)) if took else h))
        whole = F.flatten(F.zip_with(F.transform(gap, cut), taken, lambda g, h: F.array(g, F.coalesce(h, F.lit("")))))
        return F.when(F.size(hit) > 0, whole).otherwise(none)

    df = df.withColumns({
        at: F.when(F.size(hit) > 0, _offsets(sizes)).otherwise(F.array().cast("array<int>")),
        tails: pieces(lambda x: F.right(x, F.lit(CONTEXT))), heads: pieces(lambda x: F.left(x, F.lit(reach))),
    })

    def judged(i: Column) -> Column:
        m, start = F.col(hit)[i], F.col(at)[i * 2 + 1]
        first = F.greatest(i * 2 - CONTEXT, F.lit(0))
        left = F.array_join(F.slice(tails, first + 1, i * 2 - first + 1), "")
        right = F.array_join(F.slice(heads, i * 2 + 3, F.lit(reach + 1)), "")
        skip = F.length(m) - took if took else F.lit(0)
        near = F.lower(F.concat(F.right(left, F.lit(CONTEXT)), F.lit(" "), F.substr(right, skip + 1, F.lit(CONTEXT))))
        points = F.round(F.lit(score) + F.when(near.rlike(words), F.lit(lift)).otherwise(F.lit(0.0)), 3)
        ok = valid(m) if kind in BASE else valid(m) & (points >= KEEP_SCORE)
        whole = F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), points.alias("score"))
        return F.when(ok, whole)

    kept = F.filter(F.transform(F.sequence(F.lit(0), F.size(hit) - 1), judged), lambda s: s.isNotNull())
    return df.withColumn(span, F.when(F.size(hit) > 0, kept.cast(_SPAN)).otherwise(F.array().cast(_SPAN))), span


def find(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array of (kind as index of KINDS, start, end, score), by kind, then start."""
    names, df, parts = list(docs.columns), docs, []
    for k in range(len(KINDS)):
        df, span = _spans_of(df, text, k)
        parts.append(span)
    return df.select(*names, F.concat(*parts).alias(out))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans and their scores, for every row."""
    prepare(docs.sparkSession)
    df = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE), len(KINDS))],
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; overlapping spans become one, named after the first.
    ``n_chars``, if there is one, becomes the new length where the text changed."""
    prepare(docs.sparkSession)
    spans, joined, chars = fresh(docs, "pii_spans"), fresh(docs, "pii_joined"), fresh(docs, "pii_chars")
    df = find(docs, text, spans)
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(
            (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) > s["start"]),
            F.array_append(F.slice(done, 1, F.size(done) - 1), longer),
        ).otherwise(F.array_append(done, new))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.withColumn(joined, F.when(F.size(spans) > 0, F.aggregate(by_start, empty, add)).otherwise(empty))
    df = df.withColumn(chars, F.when(F.size(joined) > 0, F.split(F.col(text).cast("string"), "", -1)).otherwise(F.array().cast("array<string>")))
    tag = F.array(*[F.lit(f"<{k[0].upper()}>") for k in KINDS])
    n = F.size(joined)

    def piece(i: Column) -> Column:
        start = F.when(i > 0, F.col(joined)[i - 1]["end"]).otherwise(0)
        end = F.when(i < n, F.col(joined)[i]["start"]).otherwise(F.length(F.col(text).cast("string")))
        return F.concat(
            F.array_join(F.slice(chars, start + 1, end - start), ""),
            F.when(i < n, tag[F.col(joined)[i]["kind"]]).otherwise(F.lit("")),
        )

    new = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    changed = fresh(df, "pii_text")
    df = df.withColumn(changed, F.when(n > 0, new).otherwise(F.col(text).cast("string")))
    out = []
    for f in docs.schema.fields:
        if f.name == text:
            out.append(F.col(changed).cast(f.dataType).alias(f.name))
        elif f.name == "n_chars":
            out.append(F.when(n > 0, F.length(changed)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
