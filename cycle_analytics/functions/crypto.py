"""AES-256-GCM over chunk rows: nonce(12), ciphertext, tag(16) in one binary value.

The key never appears as a literal, which plans and event logs would show. It is the value
of a scalar subquery on a one-row key ring, so the rows are neither joined nor shuffled.
"""

from __future__ import annotations

import base64
import binascii
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.functions.derive import NONCE_BYTES, TAG_BYTES

KEY_BYTES = 32
KEY_VARIABLE = "CYCLE_AES_KEY_B64"
ALGORITHM = "AES-256-GCM"


def decode_key(text: str | None) -> bytes:
    """Base64 key text to 32 bytes, or ValueError."""
    if not text:
        raise ValueError(f"{KEY_VARIABLE} is required")
    try:
        key = base64.b64decode(text, validate=True)
    except binascii.Error as error:
        raise ValueError(f"{KEY_VARIABLE} must be valid Base64") from error
    if len(key) != KEY_BYTES:
        raise ValueError(f"{KEY_VARIABLE} must decode to exactly {KEY_BYTES} bytes")
    return key


def key_ring(spark: SparkSession, key_id: str = "current", key: bytes | None = None) -> DataFrame:
    """One row (key_id, aes_key); the key comes from the environment unless given."""
    secret = key if key is not None else decode_key(os.environ.get(KEY_VARIABLE))
    if len(secret) != KEY_BYTES:
        raise ValueError(f"the key must have exactly {KEY_BYTES} bytes")
    return spark.createDataFrame([(key_id, bytearray(secret))], "key_id string, aes_key binary")


def key_is_valid(key_b64: Column) -> Column:
    """Whether a Base64 column decodes to 32 bytes."""
    return F.coalesce(F.length(F.try_to_binary(key_b64, F.lit("base64"))) == KEY_BYTES, F.lit(False))


def _key(ring: DataFrame, key_id: str) -> Column:
    """The key of that id; more than one is an error, none encrypts and opens nothing."""
    return ring.where(F.col("key_id") == key_id).select("aes_key").scalar()


def chunk_identity(*parts: str) -> Column:
    """Authenticated data that ties a chunk to its place; lengths keep neighbouring parts apart, NULL is a part too."""
    values = [F.col(p).cast("string") for p in parts]
    sized = [F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.concat_ws("|", *sized).cast("binary")


def encrypted(
    df: DataFrame, ring: DataFrame, content: str, identity: Column, out: str = "artifact", key_id: str = "current"
) -> DataFrame:
    """Replace `content` by its ciphertext. A fresh nonce per evaluation: write before reading twice."""
    fresh_nonce = F.lit(b"").cast("binary")
    cipher = F.aes_encrypt(F.col(content), _key(ring, key_id), F.lit("GCM"), F.lit("DEFAULT"), fresh_nonce, identity)
    return df.withColumns({"key_id": F.lit(key_id), out: cipher}).drop(content)


def decrypted(
    df: DataFrame, ring: DataFrame, artifact: str, identity: Column, out: str = "content", key_id: str = "current"
) -> DataFrame:
    """Plain bytes of `artifact`, NULL where the tag, key or place does not match."""
    plain = F.try_aes_decrypt(F.col(artifact), _key(ring, key_id), F.lit("GCM"), F.lit("DEFAULT"), identity)
    return df.withColumn(out, plain)


def nonce_hex(artifact: Column) -> Column:
    return F.lower(F.hex(F.substring(artifact, 1, NONCE_BYTES)))


def tag_hex(artifact: Column) -> Column:
    return F.lower(F.hex(F.substring(artifact, -TAG_BYTES, TAG_BYTES)))
