"""Identity-field normalisers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.schemas import DEFAULT_COUNTRY

# The characters Unicode counts as white space, information
# separators included.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Mail domains whose local part ignores dots and plus suffixes.
DOTLESS_DOMAINS = ["gmail.com", "googlemail.com"]


def text(c: Column) -> Column:
    """Missing text is empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z]+", " "))


def norm_email(c: Column) -> Column:
    s = F.lower(strip(text(c)))
    local = F.substring_index(s, "@", 1)
    domain = F.substr(s, F.char_length(local) + F.lit(2))
    plain_local = F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit(""))
    return F.when(
        domain.isin(DOTLESS_DOMAINS), F.concat(plain_local, F.lit("@"), domain)
    ).otherwise(s)


def norm_phone_e164(c: Column) -> Column:
    digits = F.regexp_replace(text(c), r"\P{Nd}+", "")
    return F.when(
        F.char_length(digits) >= 10, F.concat(F.lit("+"), digits)
    ).otherwise(digits)


def norm_govid(c: Column) -> Column:
    return F.upper(strip(text(c)))


def norm_postal_code(c: Column) -> Column:
    code = F.replace(strip(text(c)), F.lit(" "), F.lit(""))
    return F.when(code.rlike(r"\A[1-9]\p{Nd}{5}\z"), code).otherwise(F.lit(""))


def norm_country(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULT_COUNTRY))


def iso_date(c: Column) -> Column:
    """The ISO text of a date, or of date-like text; null when it is no date."""
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """A date from a date, a timestamp or ISO text; null when it is no date."""
    iso = F.regexp_extract(
        strip(c.cast("string")), r"\A(\d{4}-\d{2}-\d{2})(?:\z|[ T])", 1)
    return F.try_to_date(iso, "yyyy-MM-dd")


def canonical_identity_text(
    full_name: Column,
    dob: Column,
    phone: Column,
    email: Column,
    gov_id: Column,
    addr_line: Column,
    city: Column,
    state: Column,
    postal_code: Column,
    country: Column,
    normalised: bool = False,
) -> Column:
    """The canonical text of one identity.

    ``normalised`` says that phone, email, government id and postal code went
    through their normalisers already, which then are not applied again.
    """
    def apply(normaliser, c):
        return text(c) if normalised else normaliser(c)

    parts = [
        ("name", norm_name(full_name)),
        ("dob", strip(text(dob))),
        ("phone", apply(norm_phone_e164, phone)),
        ("email", apply(norm_email, email)),
        ("govid", apply(norm_govid, gov_id)),
        ("addr", F.lower(text(addr_line))),
        ("city", F.lower(text(city))),
        ("state", F.lower(text(state))),
        ("pc", apply(norm_postal_code, postal_code)),
        ("ctry", F.upper(text(country))),
    ]
    return F.concat_ws(
        " | ", *[F.concat(F.lit(f"{key}:"), value) for key, value in parts])
