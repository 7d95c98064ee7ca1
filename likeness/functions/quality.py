"""Data-quality checks: each gives a flag or a list of messages per row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.normalize import strip, text

# Field formats, choices and messages.
EMAIL_FORMAT = r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"
PHONE_FORMAT = r"\A\+[1-9][0-9]{1,14}\z"
POSTAL_FORMAT = r"\A[0-9]{6}\z"
DATE_FORMAT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
AMOUNT_FORMAT = r"\A[0-9]+(\.[0-9]{1,2})?\z"
EARLIEST_YEAR = 1900

LOAN_TYPES = [
    "Personal Loan", "Home Loan", "Car Loan",
    "Business Loan", "Education Loan", "Gold Loan",
]
COUNTRIES = ["IN", "US", "GB", "CA", "AU"]
DECISIONS = ["pending", "approved", "rejected"]

REQUIRED_IDENTITY = {
    "full_name": "Full name is required",
    "dob": "Date of birth is required",
    "phone": "Phone number is required",
    "email": "Email is required",
    "gov_id": "Government ID is required",
    "addr_line": "Address is required",
    "city": "City is required",
    "state": "State is required",
    "postal_code": "Postal code is required",
}
REQUIRED_LOAN = {
    "loan_application_id": "Loan application ID is required",
    "requested_amount": "Requested amount is required",
    "loan_type": "Loan type is required",
    "branch_code": "Branch code is required",
}


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def valid_email(c: Column) -> Column:
    return _matches(c, EMAIL_FORMAT)


def valid_phone(c: Column) -> Column:
    return _matches(c, PHONE_FORMAT)


def valid_postal_code(c: Column) -> Column:
    return _matches(c, POSTAL_FORMAT)


def _day(c: Column) -> Column:
    return F.try_to_date(F.when(c.rlike(DATE_FORMAT), c), "yyyy-MM-dd")


def valid_date(c: Column) -> Column:
    """A real day in ISO form."""
    return _day(c).isNotNull()


def valid_birth_date(c: Column, as_of: Column) -> Column:
    """A real day, not after ``as_of`` and after the year 1900."""
    day = _day(c)
    return F.coalesce((day <= as_of) & (F.year(day) > EARLIEST_YEAR), F.lit(False))


def valid_amount(c: Column) -> Column:
    amount = F.when(_matches(c, AMOUNT_FORMAT), c).try_cast("double")
    return F.coalesce(amount > 0, F.lit(False))


def one_of(c: Column, choices: list[str]) -> Column:
    return F.coalesce(c.isin(choices), F.lit(False))


def _blank(c: Column) -> Column:
    return strip(text(c)) == ""


def _messages(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, message) for bad, message in checks]))


def identity_errors(as_of: Column | None = None) -> Column:
    """Messages on the identity fields of a raw applicant, empty when it is good.

    With ``as_of`` the date of birth may not lie after it or before 1901.
    """
    dob = F.col("dob")
    good_dob = valid_date(dob) if as_of is None else valid_birth_date(dob, as_of)
    formats = [
        ("dob", good_dob, "Please enter a valid date (YYYY-MM-DD)"),
        ("phone", valid_phone(F.col("phone")),
         "Please enter a valid E.164 phone number (e.g., +911234567890)"),
        ("email", valid_email(F.col("email")), "Please enter a valid email address"),
        ("postal_code", valid_postal_code(F.col("postal_code")),
         "Please enter a valid 6-digit postal code"),
        ("country", one_of(F.col("country"), COUNTRIES), "Please choose a listed country"),
    ]
    return _messages(
        [(_blank(F.col(c)), m) for c, m in REQUIRED_IDENTITY.items()]
        + [(~_blank(F.col(c)) & ~good, m) for c, good, m in formats])


def loan_errors() -> Column:
    """Messages on the loan fields of an application, empty when it is good."""
    formats = [
        ("requested_amount", valid_amount(F.col("requested_amount")),
         "Please enter a valid amount (e.g., 100000.00)"),
        ("loan_type", one_of(F.col("loan_type"), LOAN_TYPES),
         "Please choose a listed loan type"),
    ]
    return _messages(
        [(_blank(F.col(c)), m) for c, m in REQUIRED_LOAN.items()]
        + [(~_blank(F.col(c)) & ~good, m) for c, good, m in formats])
