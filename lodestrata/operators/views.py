"""Row visibility: a hidden owner column and the filter that every read carries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = "__identityKey"


class SignInRequired(PermissionError):
    pass


def visible_to(df: DataFrame, identity: str | int | None, column: str = IDENTITY) -> DataFrame:
    """The identity's rows; None is a partition of its own, that of rows without an owner."""
    return df.where(F.col(column).eqNullSafe(F.lit(identity)))


def public(df: DataFrame, identity: object = None) -> DataFrame:
    return df


def authenticated(df: DataFrame, identity: object) -> DataFrame:
    if identity is None:
        raise SignInRequired("this view needs a signed-in reader")
    return df


def owned(df: DataFrame, identity: object, field: str) -> DataFrame:
    return df.where(F.col(field).eqNullSafe(F.lit(identity)))


def stripped(df: DataFrame, *hidden: str) -> DataFrame:
    """Without hidden and omitted fields; names that aren't there are passed over."""
    return df.drop(IDENTITY, *hidden)


def known_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in fields])
