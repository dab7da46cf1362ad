"""Keys, encrypted columns, digests and the audit chain.

Keys are derived on the driver.  Columns are encrypted in the JVM with AES-GCM;
the stored value is nonce, ciphertext and tag.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpoint, fresh

ROUNDS = 100_000
ZERO = "0" * 64
#: Rows of a range of a chain, and the most ranges.
ROWS_PER_RANGE = 100_000
RANGES = 20_000


def derive_key(password: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    """A 32-byte key from a password: PBKDF2 with HMAC-SHA256."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def hkdf(key: bytes, info: str, size: int = 32, salt: bytes = b"") -> bytes:
    """HKDF-SHA256 (RFC 5869)."""
    prk, out, block = hmac.digest(salt or bytes(32), key, "sha256"), b"", b""
    for i in range(1, -(-size // 32) + 1):
        block = hmac.digest(prk, block + info.encode() + bytes([i]), "sha256")
        out += block
    return out[:size]


def table_key(key: bytes, table: str) -> bytes:
    return hkdf(key, f"table:{table}")


def token(size: int = 32) -> bytes:
    return secrets.token_bytes(size)


def hash_password(password: str, salt: bytes) -> bytes:
    return hashlib.blake2b(password.encode() + salt, digest_size=32).digest()


def verify_password(password: str, salt: bytes, digest: bytes) -> bool:
    return hmac.compare_digest(hash_password(password, salt), digest)


def encrypt(value: Column, key: bytes) -> Column:
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: bytes) -> Column:
    """The text; null with another key or an altered value."""
    return F.try_aes_decrypt(value, F.lit(key), F.lit("GCM")).cast("string")


def encrypt_column(value: Column, key: bytes, table: str) -> Column:
    return encrypt(value, table_key(key, table))


def decrypt_column(value: Column, key: bytes, table: str) -> Column:
    return decrypt(value, table_key(key, table))


def sha3_256(value: Column) -> Column:
    """SHA3-256 in hexadecimal; Spark has no built-in one."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else hashlib.sha3_256(v.encode() if isinstance(v, str) else bytes(v)).hexdigest())

    return run(value)


def blake2b(value: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else hashlib.blake2b(v.encode() if isinstance(v, str) else bytes(v), digest_size=32).hexdigest())

    return run(value)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from Spark's own digests; keys are derived, so none is longer than a block."""
    if len(key) > 64:
        raise ValueError("a key has 64 bytes at most")
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), once), 256)


def _before(rows: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """Adds the value of the row before, in ``order`` (unique).

    Rows are dealt into ranges with like numbers of rows, whatever the values
    of ``order``; a window runs within each range, and only the first row of a
    range looks at the last one of the ranges before.  There are ``RANGES`` of
    them at most, so that no task sorts the whole table or a long list.
    """
    own, ahead, part, last = (fresh(rows, c) for c in ("inside_", "ahead_", "range_", "last_"))
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, min(RANGES, n // ROWS_PER_RANGE)), F.col(order))
    dealt = checkpoint(dealt.withColumn(part, F.spark_partition_id()))
    ends = dealt.groupBy(part).agg(F.max_by(value, order).alias(last))
    ends = ends.select(part, F.lag(last).over(Window.orderBy(part)).alias(ahead))
    inside = F.lag(value).over(Window.partitionBy(part).orderBy(order))
    return dealt.withColumn(own, inside).join(ends, part).withColumn(out, F.coalesce(own, ahead)).drop(part, own, ahead)


def _signed(order: str, key: bytes) -> Column:
    return hmac_sha256(key, F.concat_ws("|", F.col(order).cast("string"), F.col("data_hash"), F.col("prev_hash")))


def chain(log: DataFrame, data: str, order: str, by: list[str] | None = None, key: bytes | None = None) -> DataFrame:
    """Each entry with the digest of its data and of the entry before it (zeros at first).

    Without ``by`` the log is one chain; else there is one for each value.  With
    a key each entry also carries ``mac``, an HMAC over its place and digests.
    """
    hashed = log.withColumn("data_hash", F.sha2(F.col(data), 256))
    if by:
        out = hashed.withColumn("prev_hash", F.coalesce(F.lag("data_hash").over(Window.partitionBy(*by).orderBy(order)), F.lit(ZERO)))
    else:
        prev = fresh(hashed, "prev_")
        out = _before(hashed, "data_hash", order, prev).withColumn("prev_hash", F.coalesce(prev, F.lit(ZERO))).drop(prev)
    return out.withColumn("mac", _signed(order, key)) if key else out


def broken(log: DataFrame, order: str, data: str | None = None, key: bytes | None = None) -> DataFrame:
    """Entries that do not fit: none in a sound log.

    ``prev_hash`` must be the digest of the entry before; with ``data`` the
    digest must be that of the data, and with the key the ``mac`` must be right,
    so that data and digests forged together are found too.  Entries cut off at
    the end leave no trace; keep the number of entries elsewhere.
    """
    want = fresh(log, "expected_")
    kept = [order, *([data] if data and data != order else []), "data_hash", "prev_hash", *(["mac"] if key else [])]
    seen = _before(log.select(*kept), "data_hash", order, want)
    wrong = ~F.col("prev_hash").eqNullSafe(F.coalesce(want, F.lit(ZERO)))
    if data:
        wrong = wrong | ~F.col("data_hash").eqNullSafe(F.sha2(F.col(data), 256))
    if key:
        wrong = wrong | ~F.col("mac").eqNullSafe(_signed(order, key))
    return seen.filter(wrong).select(order)
