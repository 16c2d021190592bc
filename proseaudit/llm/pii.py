"""Personal data in texts, with DataFrame functions only.

Patterns propose spans, validators confirm them, and words near a span adjust its score. The base kinds (e-mail, IP address, payment card,
international phone) are returned whenever their check holds. The others (bank account, national number, local phone, secret) are
returned if their score reaches ``least``: a proposal alone, an IBAN whose remainder by 97 is 1, and a context word before or after it count.

Positions are in code points. Matches come from the same pattern twice, once as matches and once as the pieces between them, and a match
starts after all pieces and matches before it. Patterns are written so that long runs neither recurse nor back up from each of their characters:
a run's start is tied to the end of the last match or to a character outside the run, and repeated groups are read as one run up to where it must end.

Defined cases: a null text counts as empty; an empty text has no spans; rows are judged one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NEAR, BLOCK = 40, 128
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]*?(?=[ -][ -]|[ -]?(?:[^0-9 -]|\z))"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Length of an account number, and the countries that use it (the registry, and those that use the form without being in it).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GF GP GQ GR IT KM MC MG MQ MR NC PF PM RE SM TD TF WF YT", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")


def _accounts(step: str) -> str:
    return "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:{step}[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"


# A listed country's number has its length and ends there, whatever follows; others are taken as far as they go. Neither runs into what could be a listed one.
_STEP = f"(?: (?!{_accounts(' ?')}))?"
IBAN = rf"(?<![A-Za-z0-9])(?:{_accounts(_STEP)}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:{_STEP}[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,256}[\"']?)"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone", "secret")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str, guard: Column) -> Column:
    """Matches as (start, stop, found, before, after), end exclusive, with up to 40 characters on either side; empty where the guard fails."""
    def with_gaps(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: F.transform(found, lambda m, i: F.struct(
            m.alias("found"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"),
            F.substring(F.get(gaps, i), -NEAR, NEAR).alias("before"), F.substring(F.get(gaps, i + 1), 1, NEAR).alias("after"))))

    def length_of(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda acc, p: acc + p["gap"] + p["size"])

    def placed(items: Column) -> Column:
        # Sums of whole blocks first, so that a text with very many matches costs each of them one block and no more.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: length_of(F.slice(items, b * BLOCK + 1, BLOCK)))
        bases = let(blocks, lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda acc, x: acc + x)))

        def place(base: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                start = F.get(base, b) + length_of(F.slice(items, b * BLOCK + 1, i - b * BLOCK)) + p["gap"]
                return F.struct(start.alias("start"), (start + p["size"]).alias("stop"), p["found"].alias("found"), p["before"].alias("before"), p["after"].alias("after"))

            return F.transform(items, one)

        return F.when(F.size(items) > 0, let(bases, place)).otherwise(F.filter(let(F.array(F.lit(0)), place), lambda _: F.lit(False)))

    found = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(let(found, with_gaps), placed)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def valid_iban(found: Column) -> Column:
    """Moved by four characters and with letters as numbers from 10, the remainder by 97 is 1."""
    plain = F.translate(found, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    code = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (code == 1)


def near(span: Column, words: str) -> Column:
    around = F.lower(F.concat_ws(" ", span["before"], span["after"]))
    return around.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")


def spans(text: Column) -> Column:
    """Struct of the base kinds and the added ones; each an array of (start, stop, found, score) in order of start."""
    def scored(items: Column, score) -> Column:
        return F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["found"].alias("found"), score(x).cast("double").alias("score")))

    any_digit = text.rlike("[0-9]")
    email = located(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["found"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = F.filter(located(text, CARD, text.rlike("[0-9][ -]?[0-9]")), lambda x: F.length(digits(x["found"])).between(13, 19) & F.call_function("luhn_check", digits(x["found"])))
    phone = F.filter(located(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(digits(x["found"])).between(9, 15))
    iban = located(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}"))
    national = located(text, NATIONAL, text.rlike("[0-9]-[0-9]{2}-[0-9]"))
    local = located(text, LOCAL_PHONE, any_digit & text.rlike(r"[0-9]\)?[ .-][0-9]{3}[ .-][0-9]{4}"))
    secret = located(text, SECRET, text.rlike("AKIA|(?i:password|passwd|pwd|token|secret|api_?key)"))
    lift = lambda x, words: F.when(near(x, words), 0.3).otherwise(0.0)
    return F.struct(
        scored(email, lambda x: 0.7 + lift(x, "e-?mail|mail|contact")).alias("email"),
        scored(ip, lambda x: 0.6 + lift(x, "ip|address|host|server")).alias("ip"),
        scored(card, lambda x: 0.7 + lift(x, "card|visa|credit|payment|karte|tarjeta|carte")).alias("card"),
        scored(phone, lambda x: 0.7 + lift(x, "tel|phone|call|mobile|fax|telefon|tél|teléfono")).alias("phone"),
        scored(iban, lambda x: F.when(valid_iban(x["found"]), 0.8).otherwise(0.1) + lift(x, "iban|bank|account|konto|compte|cuenta")).alias("iban"),
        scored(national, lambda x: 0.4 + lift(x, "ssn|social security|national id|tax id")).alias("national_id"),
        scored(local, lambda x: 0.4 + lift(x, "tel|phone|call|mobile|fax")).alias("local_phone"),
        scored(secret, lambda x: F.lit(0.8) + lift(x, "key|secret|credentials?|aws|login")).alias("secret"),
    )


def detect(documents: DataFrame, least: float = 0.6) -> DataFrame:
    """``doc_id`` and ``found``: an array of (kind, start, stop, found, score, base) by kind as listed, then start. Added spans that overlap a base one are left out."""
    def listed(all_spans: Column) -> Column:
        def tagged(kind: str, items: Column, base: bool) -> Column:
            return F.transform(items, lambda x: F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["found"].alias("found"), x["score"].alias("score"), F.lit(base).alias("base")))

        def with_added(base: Column) -> Column:
            added = [tagged(k, F.filter(all_spans[k], lambda x: (x["score"] >= least) & ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))), False) for k in ADDED]
            return F.concat(base, *added)

        return let(F.concat(*[tagged(k, all_spans[k], True) for k in BASE]), with_added)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", let(text, lambda t: let(spans(t), listed)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of the rows of ``detect``."""
    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        *[count(k) for k in ADDED], F.array_max(F.transform("found", lambda x: x["score"])).alias("top_score"))
