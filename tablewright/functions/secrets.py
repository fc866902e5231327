"""Redaction of secrets in free text, in typed records and in JSON text."""

import json
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "***"

# Keys whose values are never shown.
SENSITIVE_KEYS = (
    "password",
    "passwd",
    "pwd",
    "new_password",
    "old_password",
    "current_password",
    "hashed_password",
    "secret",
    "client_secret",
    "totp_secret",
    "fernet_key",
    "jwt_secret",
    "token",
    "access_token",
    "refresh_token",
    "mfa_token",
    "id_token",
    "authorization",
    "cookie",
    "set_cookie",
    "code",
    "totp_code",
    "recovery_code",
    "recovery_codes",
    "verification_code",
    "reset_token",
    "verify_token",
    "session_token",
)

# The text before a key is kept anyway, so a key that ends in another key needs no pattern of its own.
_ENDINGS = [k for k in SENSITIVE_KEYS if not any(k != s and k.endswith(s) for s in SENSITIVE_KEYS)]
_KEYS = "|".join(_ENDINGS)
_INLINE = rf"(?iU)({_KEYS})(\s*[:=]\s*|\s+)[^\s,;]+"
_INLINE_STRICT = rf"(?iU)(?<!\w)({'|'.join(sorted(SENSITIVE_KEYS, key=len, reverse=True))})(\s*[:=]\s*)[^\s,;]+"
_BEARER = r"(?iU)\bbearer\s+[A-Za-z0-9._\-]+"


def _mentions_key(c: Column) -> Column:
    """Cheap test that every cell with something to mask passes, and most others do not."""
    folded = F.translate(F.lower(c), "ſ", "s")
    words = (*_ENDINGS, "bearer")
    # As a lambda's argument the folded text is computed once for all tests.
    return F.exists(F.array(folded), lambda t: reduce(or_, [t.contains(w) for w in words]))


def redact_text(c: Column, strict: bool = False) -> Column:
    """Mask ``key=value``, ``key: value``, ``key value`` and bearer tokens.

    As specified, a key may end any word and the separator may be a plain
    blank, so ``encode foo`` is masked too; ``strict`` asks for a whole word
    and ``:`` or ``=``.
    """
    masked = F.regexp_replace(c, _INLINE_STRICT if strict else _INLINE, rf"$1$2{REDACTED}")
    masked = F.regexp_replace(masked, _BEARER, f"Bearer {REDACTED}")
    return F.when(_mentions_key(c), masked).otherwise(c)


def redact_record(c: Column, dtype: T.DataType) -> Column:
    """Mask sensitive fields of a struct or sensitive keys of a map, at any depth."""
    if isinstance(dtype, T.StructType):
        fields = [
            F.lit(REDACTED).alias(f.name)
            if f.name.lower() in SENSITIVE_KEYS
            else redact_record(c.getField(f.name), f.dataType).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        hidden = F.lit(REDACTED if isinstance(dtype.valueType, T.StringType) else None).cast(dtype.valueType)
        return F.transform_values(
            c,
            lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), hidden).otherwise(
                redact_record(v, dtype.valueType)
            ),
        )
    return c


def _mask(value):
    if not isinstance(value, dict):
        return value
    return {k: REDACTED if k.lower() in SENSITIVE_KEYS else _mask(v) for k, v in value.items()}


def _mask_json(text: str) -> str:
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return json.dumps(_mask(value), ensure_ascii=False) if isinstance(value, dict) else text


@F.pandas_udf(T.StringType())
def _mask_cells(cells: pd.Series) -> pd.Series:
    return cells.map(_mask_json, na_action="ignore")


# An escaped key may hide a sensitive one, so cells with \\u escapes are looked at too.
_JSON_KEY = r'(?i)\\u|"(' + "|".join(map(re.escape, SENSITIVE_KEYS)) + r')"\s*:'


def redact_json(c: Column) -> Column:
    """Mask sensitive keys of a JSON object in text, at any depth.

    Only cells in which such a key occurs are sent to Python.
    """
    hit = c.rlike(_JSON_KEY)
    return F.when(hit, _mask_cells(F.when(hit, c))).otherwise(c)
