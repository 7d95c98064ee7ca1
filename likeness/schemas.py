"""Record layouts shared by the sources, jobs and streams."""

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names):
    return T.StructType([T.StructField(n, _S) for n in names])


RAW_FIELDS = [
    "full_name", "dob", "phone", "email", "gov_id",
    "addr_line", "city", "state", "postal_code", "country",
]

# Other accepted spellings of each raw field, tried after the field's own name.
ALIASES = {
    "dob": ["date_of_birth"],
    "phone": ["phone_e164"],
    "email": ["email_norm"],
    "gov_id": ["government_id", "gov_id_norm"],
    "addr_line": ["address_line"],
}

RAW_APPLICANT = _strings(*RAW_FIELDS)

# A payload file may use either spelling, so it is read with both.
RAW_PAYLOAD = _strings(
    *RAW_FIELDS, "date_of_birth", "government_id", "address_line",
)

CUSTOMER_TEXT_FIELDS = [
    "full_name", "phone_e164", "email_norm", "gov_id_norm",
    "addr_line", "city", "state", "postal_code", "country",
]

CUSTOMER = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("full_name", _S),
    T.StructField("dob", T.DateType()),
    T.StructField("phone_e164", _S),
    T.StructField("email_norm", _S),
    T.StructField("gov_id_norm", _S),
    T.StructField("addr_line", _S),
    T.StructField("city", _S),
    T.StructField("state", _S),
    T.StructField("postal_code", _S),
    T.StructField("country", _S),
    T.StructField("identity_text", _S),
    T.StructField("identity_vec", T.ArrayType(T.FloatType())),
    T.StructField("created_at", T.TimestampType()),
])

# The exported customer file: everything is text, the vector is a JSON list.
CUSTOMER_CSV = _strings(
    "customer_id", "full_name", "dob", "phone_e164", "email_norm", "gov_id_norm",
    "addr_line", "city", "state", "postal_code", "country",
    "identity_text", "identity_vec",
)

PAIR_QUERY_FIELDS = {
    "full_name": "query_full_name",
    "dob": "query_dob",
    "phone_e164": "query_phone",
    "email_norm": "query_email",
    "gov_id_norm": "query_gov_id",
    "addr_line": "query_addr",
    "city": "query_city",
    "state": "query_state",
    "postal_code": "query_pc",
    "country": "query_ctry",
}

PAIR = T.StructType(
    [T.StructField(n, _S) for n in PAIR_QUERY_FIELDS.values()]
    + [T.StructField("cand_customer_id", T.LongType()),
       T.StructField("label", T.IntegerType())]
)

FEATURES = [
    "vsim", "name_sim", "phone_match", "email_match", "govid_match",
    "addr_overlap", "city_sim", "state_sim", "pincode_match", "dob_delta",
]

LOAN_FIELDS = [
    "account_number", "loan_application_id", "requested_amount",
    "loan_type", "branch_code",
]

LOAN_APPLICATION = _strings(*RAW_FIELDS, *LOAN_FIELDS)

COMPLIANCE_NOTE = T.StructType([
    T.StructField("applicant_id", _S, False),
    T.StructField("note", _S),
    T.StructField("officer", _S),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("decision", _S),
])

# Texts of the training report.
TRAINED = "Model trained successfully"
NO_TRAINING_DATA = "Training data not found"

# The decision rule, search depth and vector width of the check.
THRESHOLD = 0.82
TOP_K = 200
EVIDENCE = 10
VECTOR_DIM = 512
MAX_POSITIVES = 5
MAX_PAIRS = 3000
MISSING_DATE_DELTA = 9999.0
DEFAULT_COUNTRY = "IN"
