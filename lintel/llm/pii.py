"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score. DataFrame operations only.

Every kind has one pattern, written with possessive repeats so that long runs cost linear time and no stack. Splitting
a text at the pattern gives the pieces between the matches, and so each match's place and its neighbourhood without
touching the text again. Digit limits, octets of at most 255, Luhn (cards) and mod 97 (IBANs, the one kind added to
the four of the contract) drop proposals that fail. Scores start at a value by kind and rise when a word of the kind
stands within 40 characters before or after.

Null text counts as empty; an empty text has no spans. Texts of any length are read whole, at a cost that follows their length. Places are code points, end exclusive. Repeated rows are
answered one by one, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The base patterns of the contract, made possessive. `\\G` lets a match start where the last one ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
}
#: Characters that must be there before a pattern is tried.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
NEAR, BONUS = 40, 0.1
PART = 512


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes: doubled digits count by the sum of their digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda x, i: x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the country and check digits, moved to the end, leave the remainder 1; letters count from A = 10."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)
    return (rest == 1) & F.length(bare).between(15, 34)


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.right(x, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, match, score>> of the confirmed matches, in order."""
    hits, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    tried = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next"))
    near = f"(?i)(?:{CONTEXT[kind]})"

    def place(a, x):
        start = a.at + F.length(x.gap)
        end = start + F.length(x.hit)
        bonus = F.when(F.concat_ws("\n", F.right(x.gap, F.lit(NEAR)), F.left(x["next"], F.lit(NEAR))).rlike(near), BONUS).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x.hit.alias("match"), F.round(F.lit(BASE_SCORE[kind]) + bonus, 3).alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind, x.hit), F.concat(a.spans, F.array(span))).otherwise(a.spans).alias("spans"))

    kinds = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"
    empty = F.array().cast(kinds)

    def some(a, part):  # a bounded number of matches at a time, so that adding to an array never copies all before
        got = F.aggregate(part, F.struct(a.at.alias("at"), empty.alias("spans")), place)
        return F.struct(got.at.alias("at"), F.concat(a.parts, F.array(got.spans)).alias("parts"))

    def all_of(hit):
        parts = F.transform(F.sequence(F.lit(0), F.size(hit), F.lit(PART)), lambda i: F.slice(hit, i + 1, F.lit(PART)))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kinds}>").alias("parts")), some, lambda a: F.flatten(a.parts))

    found = F.transform(F.array(F.filter(tried, lambda x: x.hit.isNotNull())), all_of)[0]  # names the matches, so they are found once
    gate = F.contains(text, F.lit(GATES[kind])) if GATES[kind] else text.rlike("[A-Z]{2}[0-9]{2}" if kind == "iban" else "[0-9](?:[ -]?[0-9]){15}")
    return F.when(gate, found).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per document, spans by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return one.select("doc_id", F.concat(*(spans_of(k, F.col("text")) for k in PATTERNS)).alias("spans"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op5_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.kind != "iban")
    return found.select("doc_id", *(count(k) for k in ("email", "ip", "card", "phone")), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count("iban"), F.array_join(F.transform("spans", lambda s: s.score.cast("string")), ",").alias("scores"))


#: The base patterns as the contract has them; SQL's engine needs no possessive repeats.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": PATTERNS["phone"], "iban": PATTERNS["iban"]}
_KINDS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {n} AS ord, {BASE_SCORE[k]} AS base, '(?i)(?:{CONTEXT[k]})' AS near, regexp_extract_all(t, '{p}', 0) AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d" for n, (k, p) in enumerate(PLAIN.items())
)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_KINDS}),
u AS (SELECT doc_id, kind, ord, base, near, i, hits[i] AS hit, gaps[i] AS gap, gaps[i + 1] AS nxt FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
s AS (SELECT *, (sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS a, regexp_replace(hit, '[^0-9]', '', 'g') AS dig, replace(hit, ' ', '') AS bare FROM u WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
x AS (SELECT *, a + length(hit) AS b, list_transform(range(0, length(dig)), lambda j: dig[length(dig) - j]::INT * (1 + j % 2)) AS luhn, bare[5:] || bare[1:4] AS moved FROM s),
c AS (SELECT *, CASE kind WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda o: length(ltrim(o, '0')) > 3 OR right(o, 3)::INT > 255)) = 0
 WHEN 'card' THEN length(dig) BETWEEN 16 AND 19 AND list_sum(list_transform(luhn, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0
 WHEN 'phone' THEN length(dig) BETWEEN 8 AND 15
 WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(moved, ''), lambda v: CASE WHEN v <= '9' THEN v::INT ELSE ascii(v) - 55 END), lambda q, v: (q * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1
 ELSE true END AS ok, round(base + CASE WHEN regexp_matches(right(gap, {NEAR}) || chr(10) || left(nxt, {NEAR}), near) THEN {BONUS} ELSE 0 END, 3) AS score FROM x),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban,
 string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) FILTER (kind <> 'iban') AS shown, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) AS spans, string_agg(score::DOUBLE::VARCHAR, ',' ORDER BY ord, a) AS scores FROM c WHERE ok GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, sha256(coalesce(shown, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (doc_id)
"""
