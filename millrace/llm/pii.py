"""Personal data in texts, in DataFrame functions only: patterns propose, checksums confirm, words nearby adjust the score.

Each kind has a prior score; a checksum that holds (Luhn for cards, mod-97 for account numbers) and a word of the kind's context within
some characters add to it. The four base kinds are always reported; account numbers, and numbers that only a word nearby tells from any
other number, are reported from a least score on.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import fresh, staged

# Lengths of international account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local"]
BASE = 4
# Scores in hundredths before any evidence, and the words that speak for a kind.
PRIOR = {"email": 70, "ip": 50, "card": 40, "phone": 55, "iban": 40, "ssn": 25, "local": 25}
CONTEXT = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|credit|visa|mastercard|karte|tarjeta|carte",
    "phone": "phone|tel|telephone|telefon|mobile|call|fax|móvil|téléphone",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|tax id",
    "local": "phone|tel|telephone|telefon|mobile|call|fax|móvil|téléphone",
}
CHECKSUM, NEARBY, LEAST, SCOPE = 40, 30, 50, 50


def _iban_pattern() -> str:
    """Country, two digits and as many letters or digits as the country has, in groups or not, and no more."""
    by_length = sorted(IBAN_LENGTHS, key=lambda c: (IBAN_LENGTHS[c], c))
    ways = [f"(?:{'|'.join(cs)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in groupby(by_length, IBAN_LENGTHS.get)]
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(ways)})(?![A-Za-z0-9])"


# Patterns match what their plain forms do, each in one walk over the text: possessive parts never give back, and a match begins where
# a run of its first characters does (or the last match ended), as from within the run it could end no differently.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a kind to have a match that counts; quicker to tell than all matches.
NEEDED = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": PATTERNS["phone"],
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "local": r"[0-9]{3}[.\x20-][0-9]{4}",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mod97(number: Column) -> Column:
    """Whether an account number, its first four characters put last and its letters as 10 to 35, leaves 1 when divided by 97."""
    turned = F.concat(F.substring(number, 5, 64), F.substring(number, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    return F.aggregate(digits, F.lit(0), lambda rest, d: (rest * F.when(d > 9, 100).otherwise(10) + d) % 97) == 1


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a kind counts."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def candidates(text: Column) -> Column:
    """Matches of all kinds in a text as one array, and as further kinds the context words of those that have one."""
    has = {k: text.rlike(NEEDED[k]) for k in KINDS}
    words = {k: has[k] & text.rlike(_context(k)) if k in ("ssn", "local") else has[k] for k in KINDS}
    seen = [F.when(words[k], S.matches(text, i, PATTERNS[k], lambda m, k=k: valid(k, m))) for i, k in enumerate(KINDS)]
    around = [F.when(words[k], S.matches(text, len(KINDS) + i, _context(k), lambda m: F.lit(True))) for i, k in enumerate(KINDS)]
    return F.concat(*[F.coalesce(x, S.none(S.MATCH)) for x in [*seen, *around]])


def _context(kind: str) -> str:
    return rf"(?iu)(?<![\p{{L}}0-9])(?:{CONTEXT[kind]})(?![\p{{L}}0-9])"


def scored(spans: DataFrame) -> DataFrame:
    """spans (row, kind, start, end; context words among them) with score, as far as they are reported."""
    keys = ["row", "kind", "start", "end"]
    found = spans.filter(F.col("kind") < len(KINDS))
    words = spans.filter(F.col("kind") >= len(KINDS)).withColumn("kind", F.col("kind") - len(KINDS))
    told = S.near(found, words, SCOPE, SCOPE, "kind").withColumn("told", F.lit(NEARBY))
    prior = F.element_at(F.array(*[F.lit(PRIOR[k] + CHECKSUM * (k in ("card", "iban"))) for k in KINDS]), F.col("kind") + 1)
    rated = found.join(told, keys, "left").select(*keys, F.least(prior + F.coalesce("told", F.lit(0)), F.lit(100)).alias("score"))
    base = rated.filter(F.col("kind") < BASE)
    more = rated.filter((F.col("kind") >= BASE) & (F.col("score") >= LEAST))
    return base.union(more.join(S.near(more.select(*keys), base.select(*keys), 0, SCOPE), keys, "left_anti").select(base.columns))


def _same(number: int):
    return lambda x: x == number


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores: the digest of a scan.

    spans lists kind:start:end of all reported spans by start and kind, scores their scores in the same order; base_sha256 is the digest of the
    base kinds' list alone. Positions count characters of the whole text, however long. Null and empty texts have no spans: counts of 0, the
    digest of nothing, empty lists. Repeated rows come each for itself, an empty table gives an empty result, and columns other than
    doc_id and text are not used. Only matches are stored on the way, never texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = staged(docs.select("doc_id", candidates(text).alias("found"), F.monotonically_increasing_id().alias("row")), "pii-matches")
    spans = scored(staged(S.placed(slim.filter(F.size("found") > 0).select("row", "found")), "pii-spans"))
    by_row = spans.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("all"))
    joined = slim.select("doc_id", "row").join(by_row, F.col("row") == F.col("of"), "left")
    joined = joined.withColumn("all", F.coalesce("all", S.none("array<struct<start:bigint,kind:int,end:bigint,score:int>>")))
    counts = [F.size(F.filter(F.col("all")["kind"], _same(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    scores = F.array_join(F.col("all")["score"].cast("array<string>"), ",").alias("scores")
    return joined.select("doc_id", *counts, F.sha2(S.listed(F.col("all"), KINDS, BASE), 256).alias("base_sha256"), S.listed(F.col("all"), KINDS, len(KINDS)).alias("spans"), scores)


def masked(docs: DataFrame) -> DataFrame:
    """docs with every reported span of the text replaced by its kind in brackets (of overlapping spans, by the first one's), and n_chars anew.

    Null and empty texts stay as they are; rows, repeated ones too, all stay; an empty table gives an empty result; columns of any
    name are carried along. Only documents with a match are stored on the way; the time a text takes grows with its length and its spans, each by itself.
    """
    row, raw, of, at, rest, parts = (fresh(docs, c) for c in ("pii_row", "pii_raw", "pii_of", "pii_cuts", "pii_rest", "pii_parts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | text.rlike(NEEDED[k])
    stored = staged(docs.filter(hit).withColumn(raw, candidates(text)).withColumn(row, F.monotonically_increasing_id()), "pii-matches")
    spans = scored(staged(S.placed(stored.select(F.col(row).alias("row"), F.col(raw).alias("found"))), "pii-spans"))
    cut = S.cuts(spans).withColumnsRenamed({"of": of, "cuts": at, "rest": rest})
    joined = stored.join(cut, F.col(row) == F.col(of), "left").withColumn(parts, S.pieces(F.col("text")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean = S.replaced(parts, at, rest, F.length("text"), lambda kind: F.element_at(names, kind + 1))
    changed = joined.withColumn("text", F.when(F.col(at).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(at).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.filter(~hit).union(changed.select(*docs.columns))
