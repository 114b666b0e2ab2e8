"""JSON payloads, upload lists and token times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Life time of a login token in minutes.
TOKEN_MINUTES = 60

# File name endings the upload form takes.
UPLOAD_NAME = r"\.(csv|xlsx|xls)$"

_BAD = "_bad"


def parse_json(text: Column, schema: T.StructType) -> Column:
    """Struct of `schema`, or NULL where the text cannot be read."""
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = F.from_json(text, wide, {"columnNameOfCorruptRecord": _BAD})
    fields = F.struct(*[parsed[name].alias(name) for name in schema.names])
    # Blank text gives a NULL struct, other unreadable text a struct with `_bad` filled.
    return F.when(parsed.isNotNull() & parsed[_BAD].isNull(), fields)


def accepted_name(name: Column) -> Column:
    return F.lower(name).rlike(UPLOAD_NAME)


def append_names(names: Column, files: Column) -> Column:
    """Names of the uploaded files (structs with `name`) behind the earlier ones."""
    return F.concat(names, F.transform(files, lambda f: f["name"]))


def drop_position(names: Column, position: Column) -> Column:
    """List without the element at the zero-based position, if there is one."""
    return F.filter(names, lambda _, i: i != position)


def token_expiry(issued: Column, minutes: int = TOKEN_MINUTES) -> Column:
    return issued + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def token_subject(user_id: Column) -> Column:
    return user_id.cast("string")
