"""PII: format-preserving Feistel pseudonyms, in SQL functions alone.

Numbers and dates that are what they look like (a card number by its check digit, an
address by its octets, a calendar date) are replaced by others of the same format through a
keyed permutation, so equal values stay equal across documents and different ones differ.
Each kind is a Feistel network over its own domain whose rounds are keyed SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 10
#: The days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DAYS = (17, 4297)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}-[0-9]{2}-(?:19|20)[0-9]{2})(?![0-9])"
NATIONAL = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: A plus, a country code and 7 to 12 digits in any groups.
INTERNATIONAL = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]\)?){7,12}(?![0-9])"
PHONE = rf"(?:{NATIONAL}|{INTERNATIONAL})"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: Groups of digits, 13 digits or more, up to where another value starts; the cards among them are found by `_cards`.
RUN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{EMAIL}|{IPV4}|{DATE}|{PHONE}|{SSN})[0-9]++)*+"
ANY = "|".join([EMAIL, IPV4, DATE, PHONE, SSN, RUN])
#: How cards are written: in one group, or in the groups that issuers print.
GROUPED = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{3}){3})$"
KINDS = ("email", "ip", "date", "phone", "ssn", "card")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mac(key: Column, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), half.cast("string")), 256)


def _number(key: Column, kind: str, i: Column, half: Column) -> Column:
    return F.conv(F.substring(_mac(key, kind, i, half), 1, 14), 16, 10).cast("long")


def feistel(key: Column, kind: str, a: Column, b: Column, mod_a: Column, mod_b: Column) -> Column:
    """struct(a, b) permuted in [0, mod_a) x [0, mod_b): rounds add a keyed function of one half to the other."""

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s.a + _number(key, kind, i, s.b), mod_a)).otherwise(s.a)
        right = F.when(i % 2 == 1, F.pmod(s.b + _number(key, kind, i, s.a), mod_b)).otherwise(s.b)
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """The check sum; every second digit from the right is doubled, the first at `doubled_from`."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(F.when(i % 2 == doubled_from, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0) & ~d.rlike(r"^0+$")


def _permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """Digits permuted among those of the same number (2 to 30)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    a, b = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    out = feistel(key, kind, a, b, power(half), power(n - half))
    return F.concat(F.lpad(out.a.cast("string"), half, "0"), F.lpad(out.b.cast("string"), n - half, "0"))


def _fill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        isnum = c.rlike("^[0-9]$")
        return F.struct(F.concat(s.out, F.when(isnum, F.substring(digits, s.k, F.lit(1))).otherwise(c)).alias("out"), F.when(isnum, s.k + 1).otherwise(s.k).alias("k"))

    return F.aggregate(F.split(m, ""), start, step).out


def _card(key: Column, m: Column) -> Column:
    d = _digits(m)
    body = _permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
    check = F.pmod(10 - _luhn_sum(body, 0) % 10, F.lit(10)).cast("string")
    return _fill(m, F.concat(body, check))


def _phone(key: Column, m: Column) -> Column:
    """The ten national digits are permuted; a country code stays. Of other international numbers what
    stands before the first separator stays, or the first two digits where there is none."""
    d = _digits(m)
    n = F.length(d)
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1))
    stays = F.when(m.rlike(f"^(?:{NATIONAL})$"), n - 10).when(code > 0, code).otherwise(F.lit(2))
    return _fill(m, F.concat(F.substring(d, F.lit(1), stays), _permute_digits(key, "phone", F.substring(d, stays + 1, n - stays))))


def _ip(key: Column, m: Column) -> Column:
    o = F.split(m, r"\.")
    part = lambda i: F.element_at(o, i).cast("long")
    s = feistel(key, "ip", part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536))
    byte = lambda c, up: (F.floor(c / 256) if up else c % 256).cast("long").cast("string")
    return F.concat_ws(".", byte(s.a, True), byte(s.a, False), byte(s.b, True), byte(s.b, False))


#: How dates are written; two numbers before the year are month and day if that is a date, else day and month.
FORMATS = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy"), ("^[0-9]{2}-", "MM-dd-yyyy"))


def _day(m: Column) -> Column:
    """Days from 1900-01-01 of a date; null where there is no such day or the month is not before the day."""
    part = lambda a, n: F.substring(m, F.lit(a), F.lit(n))
    iso = F.lit(None).cast("string")
    for start, pattern in FORMATS:
        at = {k: pattern.index(k) + 1 for k in ("yyyy", "MM", "dd")}
        iso = F.when(m.rlike(start), F.concat_ws("-", part(at["yyyy"], 4), part(at["MM"], 2), part(at["dd"], 2))).otherwise(iso)
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))


def _is_day_first(m: Column) -> Column:
    """dd/MM/yyyy or dd-MM-yyyy of a day that is no month."""
    day = F.try_to_date(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)), "yyyy-MM-dd")
    return m.rlike("^[0-9]{2}[/-]") & (F.substring(m, 1, 2).cast("int") > 12) & day.isNotNull()


def _day_first(key: Column, m: Column) -> Column:
    """Days 13 to 28 are permuted with their months; 29 to 31 stay, among the months and years that have them."""
    day, month, year = (F.substring(m, a, n).cast("int") for a, n in ((1, 2), (4, 2), (7, 4)))
    mark = F.substring(m, 3, 1)
    said = lambda d, mo, y: F.concat(F.lpad(d.cast("string"), 2, "0"), mark, F.lpad(mo.cast("string"), 2, "0"), mark, y.cast("string"))
    early = feistel(key, "day", day - 13, (year - 1900) * 12 + month - 1, F.lit(16), F.lit(2400))
    leap = feistel(key, "leap", F.floor((year - 1904) / 28), F.floor((year - 1904) / 4) % 7, F.lit(7), F.lit(7))
    months = F.when(day == 31, F.array(*[F.lit(x) for x in (1, 3, 5, 7, 8, 10, 12)])).otherwise(F.array(*[F.lit(x) for x in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]))
    late = feistel(key, "late", year - 1900, F.array_position(months, month) - 1, F.lit(200), F.size(months))
    return (
        F.when(day <= 28, said(early.a + 13, early.b % 12 + 1, F.floor(early.b / 12) + 1900))
        .when(month == 2, said(day, month, leap.a * 28 + leap.b * 4 + 1904))
        .otherwise(said(day, F.get(months, late.b.cast("int")), late.a + 1900))
    )


def _date(key: Column, m: Column) -> Column:
    day = _day(m)
    s = feistel(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]))
    moved = F.date_add(F.lit("1900-01-01").cast("date"), (s.a * DAYS[1] + s.b).cast("int"))
    out = m
    for start, pattern in FORMATS:
        out = F.when(m.rlike(start), F.date_format(moved, pattern)).otherwise(out)
    return F.when(day.isNull(), _day_first(key, m)).otherwise(out)


def _email(key: Column, m: Column) -> Column:
    """Letters and digits before the @ are shifted within their kind, either half by the other one; other
    letters than a to z within the 32 code points around them."""
    local, host = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    half = F.floor(F.length(local) / 2).cast("int")

    def shift(i: Column, part: Column, by: Column) -> Column:
        stream = _mac(key, "email", i, F.concat_ws("|", host, by))

        def one(c: Column, j: Column) -> Column:
            s = F.conv(F.substring(stream, F.pmod(j * 2, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
            move = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + s, F.lit(n)))
            code = F.ascii(c)
            wide = F.decode(F.unhex(F.lpad(F.hex(code - code % 32 + (code + s) % 32), 4, "0")), "UTF-16BE")
            return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).when(c.rlike(r"^[\x{80}-\x{D7FF}]$"), wide).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shift(i, s.a, s.b)).otherwise(s.a).alias("a"), F.when(i % 2 == 1, shift(i, s.b, s.a)).otherwise(s.b).alias("b"))

    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(out.a, out.b, F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """What a match is, once validated; '' for none."""
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int").between(0, 255))
    area = F.substring(m, 1, 3)
    return (
        F.when(m.contains("@"), "email")
        .when(whole(IPV4), F.when(octets, "ip").otherwise(""))
        .when(whole(DATE), F.when(_day(m).isNotNull() | _is_day_first(m), "date").otherwise(""))
        .when(whole(PHONE), F.when(_digits(m).rlike("^[0-9]{0,3}0{10}$"), "").otherwise("phone"))
        .when(whole(SSN), F.when(~area.isin("000", "666") & ~area.startswith("9"), "ssn").otherwise(""))
        .otherwise("")
    )


def _cards(m: Column) -> Column:
    """The segments (m, k) of a run of groups of digits, in order; together they are the run.

    At every group, a card in the groups that issuers print comes first, the shortest if there
    are several; what is left between such cards is a card if its first up to 19 digits
    are one in whatever groups, and so on behind them.
    """
    segment = lambda x, k: F.struct(x.alias("m"), F.lit(k).alias("k"))
    none = F.array().cast("array<struct<m:string,k:string>>")

    def tries(groups: Column) -> Column:
        """Each group g, its number i, and the card c (with `own`, its separator behind, and n groups) that starts there, or null."""
        own = lambda i: F.transform(F.array(*[F.lit(n) for n in (1, 3, 4, 5)]), lambda n: F.struct(F.array_join(F.slice(groups, i + 1, n), "").alias("own"), n.alias("n")))
        bare = lambda c: F.rtrim(c.own, F.lit(" -"))
        return F.transform(groups, lambda g, i: F.struct(g.alias("g"), i.alias("i"), F.get(F.filter(own(i), lambda c: bare(c).rlike(GROUPED) & _is_card(bare(c))), 0).alias("c")))

    # As an element of an array the groups are computed once, not at every use.
    starts = F.get(F.transform(F.array(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0))), tries), 0)

    def step(s: Column, x: Column) -> Column:
        # `rest` is the text behind the last card, from its separator on.
        card = F.rtrim(x.c.own, F.lit(" -"))
        taken = F.concat(s.out, F.array(segment(s.rest, ""), segment(card, "card")))
        new = F.when(x.i < s.next, s).when(x.c.isNotNull(), F.struct(taken.alias("out"), F.substring(x.c.own, F.length(card) + 1, F.lit(1)).alias("rest"), (x.i + x.c.n).alias("next")))
        return new.otherwise(F.struct(s.out.alias("out"), F.concat(s.rest, x.g).alias("rest"), s.next.alias("next")))

    start = F.struct(none.alias("out"), F.lit("").alias("rest"), F.lit(0).alias("next"))
    parts = F.aggregate(starts, start, step, lambda s: F.concat(s.out, F.array(segment(s.rest, ""))))

    def odd(x: Column) -> Column:
        found = F.transform(F.regexp_extract_all(x.m, F.lit(CARD), F.lit(0)), lambda c: F.struct(c.alias("m"), F.when(_is_card(c), "card").otherwise("").alias("k")))
        return F.flatten(F.zip_with(F.split(x.m, CARD, -1), found, lambda b, f: F.when(f.isNull(), F.array(segment(b, ""))).otherwise(F.array(segment(b, ""), f))))

    return F.flatten(F.transform(parts, lambda x: F.when(x.k == "card", F.array(x)).otherwise(odd(x))))


def segments(m: Column) -> Column:
    """The segments (m, k) of a match of ANY: one, or those of a run."""
    return F.when(m.rlike("^[0-9 -]+$") & ~m.rlike(f"^(?:{DATE}|{PHONE}|{SSN})$"), _cards(m)).otherwise(F.array(F.struct(m.alias("m"), kind_of(m).alias("k"))))


def pseudonym(key: Column, kind: Column, m: Column) -> Column:
    return F.when(kind == "email", _email(key, m)).when(kind == "ip", _ip(key, m)).when(kind == "date", _date(key, m)).when(kind == "phone", _phone(key, m)).when(kind == "ssn", _fill(m, _permute_digits(key, "ssn", _digits(m)))).when(kind == "card", _card(key, m)).otherwise(m)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = "rillgraph-demo-key", out: str = "text", counts: bool = True) -> DataFrame:
    """docs with pseudonyms in place of personal numbers, dates and addresses.

    Adds n_email, n_ip, n_date, n_phone, n_ssn and n_card if `counts` (they replace columns
    of those names). Null texts stay null with counts 0; a text without any stays as it is,
    byte for byte. A value is replaced alike wherever it stands. Keep the key secret.
    """
    secret = F.lit(key)
    columns = [c for c in docs.columns if c != out and not (counts and c in {f"n_{k}" for k in KINDS})]
    quoted = [F.col(f"`{c}`") for c in columns]
    text = F.col(f"`{text_col}`").cast("string")
    found = docs.select(*quoted, text.alias("__pii_text"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("__pii_found"))
    kinds = F.transform("__pii_found", segments)
    found = found.withColumn("__pii_found", F.when(F.size("__pii_found") > 0, kinds).otherwise(F.array().cast("array<array<struct<m:string,k:string>>>")))
    new = F.transform("__pii_found", lambda found: F.array_join(F.transform(found, lambda x: pseudonym(secret, x.k, x.m)), ""))
    mixed = F.array_join(F.zip_with(F.split("__pii_text", ANY, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("__pii_found") > 0, mixed).otherwise(F.col("__pii_text")).alias(out)
    of = lambda k: F.size(F.filter(F.flatten("__pii_found"), lambda x: x.k == k)).cast("long").alias(f"n_{k}")
    numbers = [of(k) for k in KINDS] if counts else []
    return found.select(*quoted, text, *numbers).select(*[F.col(f"`{c}`") for c in docs.columns if c in columns or c == out], *([] if out in docs.columns else [out]), *([f"n_{k}" for k in KINDS] if counts else []))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs)
