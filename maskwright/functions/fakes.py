"""Reproducible substitutes: a keyed hash picks from fixed pools, in built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocabulary as v
from maskwright.functions.companies import company_column


class Fakes:
    """Substitutes under one seed; the same seed, kind and key give the same value everywhere."""

    def __init__(self, seed: str = v.SEED, salt: str = "") -> None:
        self.prefix = f"{seed}\u001f{salt}\u001f"

    def number(self, tag: str, key: Column) -> Column:
        """The first 64 bits of the hash, unsigned."""
        return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{self.prefix}{tag}\u001f"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")

    def below(self, n: int, tag: str, key: Column) -> Column:
        return (self.number(tag, key) % F.lit(n).cast("decimal(20,0)")).cast("long")

    def pick(self, pool: tuple[str, ...], tag: str, key: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in pool]), (self.below(len(pool), tag, key) + 1).cast("int"))

    def digits(self, n: int, tag: str, key: Column) -> Column:
        """n decimal digits, the least first."""
        return F.reverse(F.lpad(self.below(10**n, tag, key).cast("string"), n, "0"))

    def din(self, key: Column) -> Column:
        return self.digits(8, "din", key)

    def ssn(self, key: Column) -> Column:
        two = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", (self.below(100, "ssn-area", key) + 900).cast("string"), two(self.below(100, "ssn-grp", key), 2), two(self.below(10000, "ssn-ser", key), 4))

    def card(self, key: Column) -> Column:
        return F.concat(F.lit("4111 1111 1111 "), self.digits(4, "cc", key))

    def ip(self, key: Column) -> Column:
        return F.concat(F.lit("198.51.100."), (self.below(254, "ip", key) + 1).cast("string"))

    def birth_date(self, key: Column) -> Column:
        two = lambda c: F.lpad((c + 1).cast("string"), 2, "0")
        return F.concat_ws("/", two(self.below(28, "dob-d", key)), two(self.below(12, "dob-m", key)), (self.below(50, "dob-y", key) + 1950).cast("string"))

    def person(self, key: Column, original: Column) -> Column:
        """As many names as the original has (two to four), with its title."""
        words = F.split(F.trim(original), r"\s+")
        titled = F.element_at(words, 1).rlike(r"(?i)^(dr|mr|mrs|ms|prof|shri|smt)\.?$")
        title = F.when(titled, F.concat(F.regexp_replace(F.element_at(words, 1), r"\.$", ""), F.lit(". "))).otherwise("")
        n = F.size(words) - titled.cast("int")
        given, last = self.pick(v.GIVEN_NAMES, "given", key), self.pick(v.SURNAMES, "surname", key)
        middle = F.concat(F.substring(self.pick(v.SURNAMES, "middle", key), 1, 1), F.lit("."))
        four = F.concat_ws(" ", given, self.pick(v.GIVEN_NAMES, "given2", key), self.pick(v.SURNAMES, "surname2", key), last)
        return F.concat(title, F.when(n <= 2, F.concat_ws(" ", given, last)).when(n == 3, F.concat_ws(" ", given, middle, last)).otherwise(four))

    def email(self, value: Column) -> Column:
        """The first two parts of the local name at a reserved domain, no longer than the original where that can be."""
        local, host = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(-1))
        tld = F.split_part(host, F.lit("."), F.lit(-1))
        domain = F.concat(F.lit("example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("com"))
        parts = F.slice(F.regexp_extract_all(local, F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 2)
        room = F.greatest(F.lit(1), F.length(value) - F.length(domain) - 1)
        return F.concat(F.substring(F.array_join(parts, "."), F.lit(1), room), F.lit("@"), domain)

    def address(self, key: Column, original: Column) -> Column:
        """The longest of a ladder of forms that fits the original's length; its PIN style and state are copied."""
        flat = F.trim(F.regexp_replace(original, r"\s+", " "))
        raw = self.digits(6, "addr-pin", key)
        pin = F.when(flat.rlike(r"[0-9]{3} [0-9]{3}"), F.concat_ws(" ", F.substring(raw, 1, 3), F.substring(raw, 4, 3))).otherwise(raw)
        has_pin, has_state = flat.rlike(r"[0-9]{3} ?[0-9]{3}"), flat.rlike(r"(?i)\b(?:maharashtra|madhya pradesh|india)\s*[,.]?\s*$")
        city, state = self.pick(v.CITIES, "addr-city", key), self.pick(v.STATES, "addr-state", key)
        long = F.concat((self.below(900, "addr-house", key) + 1).cast("string"), F.lit(", "), self.pick(v.BUILDING_WORDS, "addr-building", key), F.lit(" Apartments, "), self.pick(v.STREET_NAMES, "addr-street", key), F.lit(" "), self.pick(v.STREET_TYPES, "addr-type", key), F.lit(", "), city, F.lit(" – "), pin)
        forms = F.array(F.when(has_pin & has_state, F.concat_ws(", ", long, state)), F.when(has_pin, long), F.when(has_pin, F.concat(city, F.lit(" – "), pin)), F.when(has_state, F.concat_ws(", ", city, state)), F.concat(city, F.lit(", India")), city)
        fits = F.filter(forms, lambda x: x.isNotNull() & (F.length(x) <= F.length(flat)))
        return F.when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(F.regexp_replace(F.substring(city, F.lit(1), F.length(flat)), "[ ,–-]+$", ""))

    def company(self, key: Column, original: Column) -> Column:
        prefix = self.prefix

        def number(tag: str, k: str) -> int:
            return int.from_bytes(hashlib.sha256(f"{prefix}{tag}\u001f{k}".encode()).digest()[:8], "big")

        return company_column(number, key, original)

    def url(self, original: Column) -> Column:
        """A reserved host no longer than the original's; of the path the words are replaced, width and other characters stay."""
        scheme = F.lower(F.regexp_extract(original, "(?i)^https?://", 0))
        rest = F.substring(original, F.length(scheme) + 1, F.length(original))
        host = F.split_part(rest, F.lit("/"), F.lit(1))
        path = F.substring(rest, F.length(host) + 2, F.length(rest))
        tld = F.lower(F.split_part(host, F.lit("."), F.lit(-1)))
        tld = F.when(host.contains(".") & tld.isin("com", "net", "org"), tld).otherwise("com")
        hosts = F.array(F.concat(F.lit("www.example."), tld), F.concat(F.lit("example."), tld), F.lit("example.net"), F.lit("example.org"), F.lit("test.invalid"), F.lit("test"))
        fake_host = F.coalesce(F.get(F.filter(hosts, lambda h: F.length(h) <= F.length(host)), F.lit(0)), F.lit("test"))
        pool = F.array(*[F.lit(w) for w in v.URL_PATH_WORDS])

        def word(w: Column) -> Column:
            same = F.filter(pool, lambda p: F.substring(p, 1, 1) == F.lower(F.substring(w, 1, 1)))
            among = F.when(F.size(same) > 0, same).otherwise(pool)
            best = F.array_min(F.transform(among, lambda p: F.struct(F.abs(F.length(p) - F.length(w)).alias("far"), p.alias("w"))))["w"]
            return F.substring(F.concat(best, F.repeat(F.get(among, F.lit(0)), F.length(w))), F.lit(1), F.length(w))

        runs = F.regexp_extract_all(path, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
        tail = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z]"), word(r)).otherwise(r)), "")
        room = F.greatest(F.lit(0), F.length(original) - F.length(scheme) - F.length(fake_host) - 1)
        return F.concat(scheme, fake_host, F.when(rest.contains("/"), F.concat(F.lit("/"), F.substring(tail, F.lit(1), room))).otherwise(""))

    def subscriber(self, original: Column) -> Column:
        """The substitute digits of a phone number, drawn from its digits behind the country or area code."""
        own = _national(original)
        return F.substring(F.reverse(F.lpad(self.number("phone", own).cast("string"), 40, "0")), F.lit(1), F.length(own))

    def phone(self, digits: Column, printed: Column) -> Column:
        """The digits in the layout of one printed number; missing ones are drawn from its spelling."""
        more = F.conv(F.substring(F.sha2(F.concat(F.lit("phone-pad\u001f"), printed), 256), 1, 16), 16, 10)
        filled = F.concat(digits, F.reverse(F.lpad(more, 40, "0")))
        skip = F.length(F.regexp_replace(printed, "[^0-9]", "")) - F.length(_national(printed))
        start = F.struct(F.lit(0).alias("seen"), F.lit("").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            seen = acc["seen"] + c.rlike("^[0-9]$").cast("int")
            new = F.when(c.rlike("^[0-9]$") & (seen > skip), F.substring(filled, seen - skip, F.lit(1))).otherwise(c)
            return F.struct(seen.alias("seen"), F.concat(acc["out"], new).alias("out"))

        out = F.aggregate(F.split(printed, ""), start, step, lambda acc: acc["out"])
        return F.when(printed.rlike("[0-9]"), out).otherwise("+91 00000 00000")


def _national(printed: Column) -> Column:
    """The digits behind +91 or an area code; all of them if nothing is left."""
    digits = F.regexp_replace(printed, "[^0-9]", "")
    code = F.when(printed.rlike(r"^\s*\+\s*91"), 2).otherwise(F.length(F.regexp_extract(printed, r"^\s*(0\d{2,4})(?=[\s\-])", 1)))
    rest = F.substring(digits, code + 1, F.length(digits))
    return F.when(rest == "", digits).otherwise(rest)


def match_case(fake: Column, original: Column) -> Column:
    """Copy capitals, or a leading capital, of what stands before the at sign."""
    local = F.split_part(original, F.lit("@"), F.lit(1))
    head = F.substring(local, 1, 1)
    rest = F.substring(local, F.lit(2), F.length(local))
    upper = local.rlike(r"\p{Lu}") & (F.upper(local) == local)
    leading = head.rlike(r"\p{Lu}") & rest.rlike(r"\p{Ll}") & (F.lower(rest) == rest)
    return F.when(upper, F.upper(fake)).when(leading, F.concat(F.upper(F.substring(fake, 1, 1)), F.substring(fake, F.lit(2), F.length(fake)))).otherwise(fake)
