"""Named-key column encryption and salted hashes (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.functions.scalars import distinct_from


class KeyNotFound(LookupError):
    pass


def key_value(keys: DataFrame, key_name: str) -> bytes:
    """Look one key up by its unique name (one small read on the driver)."""
    row = keys.filter(F.col("key_name") == key_name).select("key_value").first()
    if row is None or row[0] is None:
        raise KeyNotFound(f"no key is stored under the name {key_name}")
    return bytes(row[0])


def encrypt(value: Column, key: bytes) -> Column:
    return F.aes_encrypt(value.cast("string"), F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(value, F.lit(key), F.lit("GCM")).cast("string")


def encrypt_cols(df: DataFrame, cols: list[str], key: bytes, suffix: str = "_encrypted") -> DataFrame:
    """Replace each column by its encrypted form under `<name><suffix>`."""
    out = df.withColumns({f"{c}{suffix}": encrypt(F.col(c), key) for c in cols})
    return out.drop(*cols)


def decrypt_cols(df: DataFrame, cols: list[str], key: bytes, suffix: str = "_encrypted") -> DataFrame:
    out = df.withColumns({c: decrypt(F.col(f"{c}{suffix}"), key) for c in cols})
    return out.drop(*[f"{c}{suffix}" for c in cols])


def secret_hash(secret: Column, salt: Column) -> Column:
    """Salt and digest in one text, so the salt travels with the hash."""
    salt = salt.cast("string")
    return F.concat_ws("$", salt, F.sha2(F.concat(salt, secret), 256))


def hash_on_change(new: Column, old: Column | None, salt: Column) -> Column:
    """Hash a secret only where it is set and new or different from before."""
    fresh = new.isNotNull() if old is None else new.isNotNull() & distinct_from(new, old)
    return F.when(fresh, secret_hash(new, salt)).otherwise(new)
