"""Table layouts.

Measured values are fixed-scale decimals: their sums do not depend on the order in
which partitions arrive, so a re-run after a lost executor gives the same digits.
"""

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


LONG, TEXT, BOOL = T.LongType(), T.StringType(), T.BooleanType()
TIME, NUMBER = T.TimestampType(), T.DoubleType()
MEASURE = T.DecimalType(18, 4)

USER = _struct(
    ("id", LONG, False),
    ("username", TEXT, False),
    ("email", TEXT, True),
    ("password_hash", TEXT, False),
    ("role", TEXT, False),
    ("is_active", BOOL, False),
    ("created_at", TIME, False),
    ("last_login_at", TIME, True),
)
PUBLIC_USER = [field.name for field in USER if field.name != "password_hash"]

AUDIT = _struct(
    ("id", LONG, False),
    ("user_id", LONG, True),
    ("username", TEXT, True),
    ("ip", TEXT, True),
    ("ok", BOOL, False),
    ("created_at", TIME, False),
)

# Request batches: `seq` is the arrival order and unique in a batch. Passwords
# arrive hashed (`password_hash`) or already checked (`password_ok`).
REGISTER_REQUEST = _struct(
    ("seq", LONG, False),
    ("username", TEXT, True),
    ("email", TEXT, True),
    ("password_hash", TEXT, True),
    ("created_at", TIME, False),
)
PATCH_REQUEST = _struct(
    ("seq", LONG, False),
    ("user_id", LONG, False),
    ("username", TEXT, True),
    ("email", TEXT, True),
    ("password_hash", TEXT, True),
    ("role", TEXT, True),
    ("is_active", BOOL, True),
    ("last_login_at", TIME, True),
)
DELETE_REQUEST = _struct(("seq", LONG, False), ("user_id", LONG, False))
LOGIN_REQUEST = _struct(
    ("seq", LONG, False),
    ("username", TEXT, True),
    ("ip", TEXT, True),
    ("password_ok", BOOL, True),
    ("created_at", TIME, False),
)

EXPERIMENT = _struct(
    ("experiment_id", TEXT, False),
    ("user_id", LONG, True),
    ("experiment_type", TEXT, False),
    ("created_at", TIME, True),
)
PARAMETER = _struct(
    ("experiment_id", TEXT, False), ("name", TEXT, False), ("value", MEASURE, True)
)
RESULT = _struct(
    ("experiment_id", TEXT, False), ("outcome", MEASURE, True), ("success", BOOL, True)
)
PREDICTION = _struct(
    ("prediction_id", LONG, False),
    ("experiment_type", TEXT, True),
    ("params", T.MapType(TEXT, NUMBER), True),
    ("score", NUMBER, True),
    ("confidence", NUMBER, True),
)
PREDICTION_PARAMETER = _struct(("prediction_id", LONG, False), ("parameter_id", LONG, False))
FEEDBACK = _struct(
    ("prediction_id", LONG, True),
    ("user_id", LONG, True),
    ("rating", MEASURE, True),
    ("success", BOOL, True),
    ("created_at", TIME, True),
)
LITERATURE = _struct(
    ("doc_id", LONG, False),
    ("data_type", TEXT, False),
    ("name", TEXT, True),
    ("value", NUMBER, True),
    ("unit", TEXT, True),
)
CONSTRAINT = _struct(
    ("query_id", LONG, False),
    ("experiment_type", TEXT, True),
    ("param", TEXT, False),
    ("min", NUMBER, True),
    ("max", NUMBER, True),
)

# What an uploaded file carries: one experiment per line, as text; see
# operators.experiments for the checks that turn it into typed rows.
UPLOAD = _struct(
    ("experiment_id", TEXT, True),
    ("user_id", LONG, True),
    ("experiment_type", TEXT, True),
    ("temperature", NUMBER, True),
    ("pressure", NUMBER, True),
    ("outcome", NUMBER, True),
    ("success", BOOL, True),
)
