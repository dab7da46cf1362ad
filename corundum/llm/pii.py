"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn for cards, mod-97
for IBANs) confirm them, and context words nearby adjust the score.  The base
kinds are e-mail, IP address, card and phone number; the method adds ``iban``
(mod-97 must hold) and ``ssn`` (kept only where a context word supports it).

Positions without a UDF: matches are wrapped in control characters together
with the text around them (caught by a lookbehind and a lookahead), the text is
split there, and the lengths of the pieces add up to offsets, in blocks and
within a block, so that the work grows with the text and not with the square of
its matches.  The patterns start only where a leftmost match can start and are
possessive, so long runs of characters take linear time.

Cases: a null text counts as empty; control characters 1 and 2 of the text are
replaced beforehand by another that no pattern matches, which moves nothing;
offsets are code points; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\x01", "\x02"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Where a match of each kind may start, and what it is.
STARTS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))",
    "ip": r"(?<![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])",
    "phone": "",
    "iban": r"(?<![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])",
}
BODIES = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
PATTERNS = {k: STARTS[k] + BODIES[k] for k in KINDS}
#: What a text must contain for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a span by itself, and what a context word adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.5, 0.4), "iban": (0.9, 0.1), "ssn": (0.3, 0.5)}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
LEAST = 0.5
NEAR = 40
#: Matches whose offsets are added up together.
BLOCK = 128


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the Luhn sum of a string of digits is divisible by 10."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        x = F.substr(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an IBAN without spaces leaves 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(s: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 65, (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def proposed(kind: str, text: Column) -> Column:
    """The matches of a kind: an array of (start, end, match, near), near being the text around it."""
    spans = "array<struct<start:int,end:int,match:string,near:string>>"
    before = rf"(?<=(\A[\s\S]{{0,{NEAR - 1}}}|[\s\S]{{{NEAR}}}))"
    marked = rf"{STARTS[kind]}(?={BODIES[kind]}){before}({BODIES[kind]})(?=([\s\S]{{0,{NEAR}}}))"
    pieces = F.split(F.regexp_replace(text, marked, f"{OPEN}$2{CLOSE}$1 $3{CLOSE}"), OPEN)
    match = lambda piece: F.substring_index(piece, CLOSE, 1)
    width = lambda piece: F.length(match(piece)) + F.length(F.substring_index(piece, CLOSE, -1))

    def step(acc: Column, piece: Column) -> Column:
        new = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(match(piece))).alias("end"), match(piece).alias("match"), F.substring_index(F.substring_index(piece, CLOSE, 2), CLOSE, -1).alias("near"))
        return F.struct((acc["at"] + width(piece)).alias("at"), F.concat(acc["spans"], F.array(new)).alias("spans"))

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(spans).alias("spans")), step, lambda acc: acc["spans"])

    def starts(first: Column, sizes: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(sizes, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def located(p: Column) -> Column:
        cuts = F.sequence(F.lit(2), F.size(p), F.lit(BLOCK))  # the first piece is before all matches
        blocks = F.transform(cuts, lambda c: F.slice(p, c, F.lit(BLOCK)))
        sizes = lambda found: F.transform(found, lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + width(x)))
        return _let(blocks, lambda found: F.flatten(F.zip_with(found, starts(F.length(p[0]), sizes(found)), within)))

    may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(may & text.rlike(PATTERNS[kind]), _let(pieces, located)).otherwise(F.array().cast(spans))


def scored(kind: str, spans: Column) -> Column:
    """The valid spans with their scores."""
    own, bonus = SCORES[kind]

    def score(s: Column) -> Column:
        return F.lit(own) + F.when(F.lower(s["near"]).rlike(CONTEXT[kind]), bonus).otherwise(0.0)

    out = F.transform(F.filter(spans, lambda s: valid(kind, s["match"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score(s), 2).alias("score")))
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of (kind, start, end, score)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, "\x03\x03")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", *(proposed(k, F.col("text")).alias(k) for k in KINDS))
    return rows.select("doc_id", *(scored(k, F.col(k)).alias(k) for k in KINDS))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base spans, their digest, all spans and their scores."""
    rows = find(docs)
    every = F.concat(*(F.col(k) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(spelled(F.concat(*(F.col(k) for k in BASE))), 256).alias("base_sha256"),
        spelled(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def oracle() -> str:
    """The query in DuckDB's SQL, whose patterns have no lookaround: runs are matched whole and judged afterwards."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": BODIES["phone"],
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
        "ssn": "[0-9-]+",
    }
    digits, compact = "regexp_replace(m, '[^0-9]', '', 'g')", "replace(m, ' ', '')"
    luhn_sum = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INTEGER) ELSE 2 * CAST(reverse({digits})[i] AS INTEGER) - CASE WHEN CAST(reverse({digits})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END))"
    turned = f"({compact}[5:] || {compact}[1:4])"
    number = f"array_to_string(list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN {turned}[i] BETWEEN '0' AND '9' THEN {turned}[i] ELSE CAST(ascii({turned}[i]) - 55 AS VARCHAR) END), '')"
    rest = f"list_reduce(list_prepend(0, list_transform(range(1, length({number}) + 1), lambda i: CAST({number}[i] AS INTEGER))), lambda a, b: (a * 10 + b) % 97)"
    ok = {
        "email": "true",
        "ip": r"regexp_full_match(m, '(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}')",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"{rest} = 1",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
    }
    found = []
    for n, k in enumerate(KINDS):
        own, bonus = SCORES[k]
        near = f"lower(x[greatest(s - {NEAR} + 1, 1) : s] || ' ' || x[s + length(m) + 1 : s + length(m) + {NEAR}])"
        score = f"round({own} + CASE WHEN regexp_matches({near}, '{CONTEXT[k]}') THEN {bonus} ELSE 0.0 END, 2)"
        found.append(
            f"""SELECT r, {n} AS n, '{k}' AS kind, s, s + length(m) AS e, CAST({score} AS DOUBLE) AS score FROM (
            SELECT r, x, split_part(piece, chr(2), 1) AS m, CAST(sum(length(piece)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) - (i - 2) AS BIGINT) AS s, i
            FROM (SELECT r, x, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM
                  (SELECT r, x, string_split(regexp_replace(x, '{plain[k]}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM t)))
            WHERE i > 1 AND CASE WHEN {"m <> ''" if k != "iban" else "length(m) > 4"} THEN {ok[k]} ELSE false END"""
            + ("" if k in BASE else f" AND {score} >= {LEAST}")
        )
    word = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS x FROM documents),
        f AS ({" UNION ALL ".join(found)}),
        g AS (SELECT r, {counts}, string_agg({word}, ',' ORDER BY n, s) FILTER (n < {len(BASE)}) AS base, string_agg({word}, ',' ORDER BY n, s) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY n, s) AS scores FROM f GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN g USING (r)"""


ORACLE = oracle()
