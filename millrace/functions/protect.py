"""Protecting columns: AES with the IV in front of the cipher text, and base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported modes with the padding each one takes.
PADDING = {"GCM": "DEFAULT", "CBC": "PKCS"}
KEY_BYTES = 32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mode(mode: str) -> tuple[Column, Column]:
    if mode not in PADDING:
        raise ValueError(f"mode must be one of {sorted(PADDING)}")
    return F.lit(mode), F.lit(PADDING[mode])


def encrypt(value: Column | str, key: Column, mode: str = "GCM") -> Column:
    """AES-256; the random IV (12 bytes for GCM, 16 for CBC) leads the result."""
    m, p = _mode(mode)
    return F.aes_encrypt(_col(value).cast("binary"), key, m, p)


def decrypt(value: Column | str, key: Column, mode: str = "GCM") -> Column:
    """Back to bytes; null when the key or the data is wrong."""
    m, p = _mode(mode)
    return F.try_aes_decrypt(_col(value), key, m, p)


def to_base64(value: Column | str, alphabet: str = "basic") -> Column:
    """``basic``, ``url`` (- and _ instead of + and /) or ``mime`` (76 characters a line)."""
    plain = F.regexp_replace(F.base64(_col(value).cast("binary")), r"\s", "")
    if alphabet == "basic":
        return plain
    if alphabet == "url":
        return F.translate(plain, "+/", "-_")
    if alphabet == "mime":
        return F.regexp_replace(plain, r"(.{76})(?=.)", "$1\r\n")
    raise ValueError("alphabet must be basic, url or mime")


def from_base64(text: Column | str, alphabet: str = "basic") -> Column:
    t = _col(text)
    if alphabet == "url":
        t = F.translate(t, "-_", "+/")
    elif alphabet == "mime":
        t = F.regexp_replace(t, r"\s", "")
    elif alphabet != "basic":
        raise ValueError("alphabet must be basic, url or mime")
    return F.unbase64(t)
