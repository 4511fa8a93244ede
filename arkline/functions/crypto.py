"""Decryption of stored payloads with built-in functions, and key derivation in batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .kernels import derive_keys, hmac_sha256


def _xor_16(block: Column) -> Column:
    """A 16-byte block with every byte xor 16, in four 32-bit words."""
    word = lambda k: F.conv(F.substring(F.hex(block), 8 * k + 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(0x10101010).cast("long"))
    return F.unhex(F.concat(*[F.lpad(F.hex(word(k)), 8, "0") for k in range(4)]))


def decrypt_cbc(content: Column, key: Column, iv: Column) -> Column:
    """AES-CBC without padding. The built-in function wants PKCS padding, so a block is appended
    that decrypts to one: the encryption of sixteen 16s xor the last block."""
    last = F.substring(content, F.octet_length(content) - 15, 16)
    block = F.substring(F.aes_encrypt(_xor_16(last), key, F.lit("ECB"), F.lit("PKCS")), 1, 16)
    padded = F.concat(iv, content, block)
    whole = F.aes_decrypt(padded, key, F.lit("CBC"), F.lit("PKCS"))
    return F.when(F.octet_length(content) == 0, content).otherwise(whole)


@pandas_udf(StructType([StructField("aes_key", BinaryType()), StructField("hash_key", BinaryType()), StructField("check", BinaryType())]))
def keys_column(password: pd.Series, salt: pd.Series, lg2_count: pd.Series) -> pd.DataFrame:
    """Keys per row; each distinct (password, salt, count) of a batch is derived once."""
    known: dict = {}
    rows = []
    for p, s, n in zip(password, salt, lg2_count, strict=True):
        key = (p, bytes(s), int(n))
        if key not in known:
            known[key] = derive_keys(*key)
        rows.append(known[key])
    return pd.DataFrame(rows, columns=["aes_key", "hash_key", "check"])


@pandas_udf(LongType())
def keyed_sum(crc: pd.Series, hash_key: pd.Series) -> pd.Series:
    """A CRC-32 as encrypted entries note it: an HMAC of it folded to 32 bits; without a key the sum itself."""

    def one(value, key):
        if key is None or pd.isna(value):
            return value
        mac = hmac_sha256(bytes(key), int(value).to_bytes(4, "little"))
        folded = 0
        for k in range(0, 32, 4):
            folded ^= int.from_bytes(mac[k : k + 4], "little")
        return folded

    return pd.Series([one(*row) for row in zip(crc, hash_key, strict=True)], dtype="Int64")
