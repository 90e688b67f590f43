"""Canonical JSON and Unicode forms, where byte equality matters (Arrow UDFs: Spark has no
NFC, and its JSON escapes control characters in another case)."""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value, dialect: str) -> str:
    """Sorted keys, no spaces. `contract`: NFC, no nulls or floats. `storage`: nulls allowed,
    no floats, text as it is. `key`: NFC and finite floats, -0 as 0."""
    return json.dumps(_checked(value, dialect), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _checked(value, dialect: str):
    if isinstance(value, dict):
        normal = {_checked(k, dialect): _checked(v, dialect) for k, v in value.items()}
        if len(normal) != len(value):
            raise ValueError("keys collide in composed form")
        return normal
    if isinstance(value, list):
        return [_checked(v, dialect) for v in value]
    if isinstance(value, str):
        return value if dialect == "storage" else unicodedata.normalize("NFC", value)
    if value is None and dialect != "storage":
        raise ValueError("null is not allowed")
    if isinstance(value, float):
        if dialect != "key" or not math.isfinite(value):
            raise ValueError("this number is not allowed")
        return 0.0 if value == 0 else value
    return value


def parse(text: str | bytes, dialect: str, limit: int = 65_536):
    """The value of canonical JSON. Raises, in this order, where it is too long (bytes), is no
    UTF-8, begins with a byte order mark, is no JSON, repeats a key at any level, holds a value
    that the dialect lacks, or is not byte for byte what encode() gives."""
    try:
        data = text.encode() if isinstance(text, str) else text
    except UnicodeEncodeError:
        raise ValueError("not UTF-8") from None
    if len(data) > limit:
        raise ValueError("too long")
    if data.startswith(codecs.BOM_UTF8):
        raise ValueError("begins with a byte order mark")
    try:
        text = data.decode()
    except UnicodeDecodeError:
        raise ValueError("not UTF-8") from None

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key comes twice")
        return dict(items)

    def constant(_):
        raise ValueError("this number is not allowed")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=float if dialect == "key" else constant)
    except (json.JSONDecodeError, RecursionError):
        raise ValueError("no JSON") from None
    if encode(value, dialect).encode("utf-8", "surrogatepass") != data:
        raise ValueError("not canonical")
    return value


def verdict(column: Column, dialect: str, limit: int = 65_536) -> Column:
    """Why each text is no canonical JSON of a dialect, `canonical` where it is; null stays null."""

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                parse(t, dialect, limit)
            except ValueError as e:
                return str(e)
            return "canonical"

        return texts.map(one).astype(object)

    return check(column)


def is_canonical(column: Column, dialect: str) -> Column:
    """Whether each text is canonical JSON; null stays null."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                parse(t, dialect)
            except ValueError:
                return False
            return True

        return texts.map(one).astype(object)

    return check(column)


def digest(column: Column, dialect: str = "contract") -> Column:
    """sha256: of the canonical form of JSON texts; null where there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return "sha256:" + hashlib.sha256(encode(json.loads(t), dialect).encode()).hexdigest()
            except (TypeError, ValueError):
                return None

        return texts.map(one).astype(object)

    return run(column)


def nfc(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t)).astype(object)

    return run(column)
