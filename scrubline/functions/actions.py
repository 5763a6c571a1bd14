"""Replacement text per action, as Column expressions.

mask   -- per-type masker (e-mail, phone, IPv4) or the generic token
drop   -- empty string
hash   -- ``hash_`` + 12 hex of SHA-256(salt|type|raw)
pseudonymize -- ``Prefix_`` + 8 base32 characters of HMAC-SHA256(salt, TYPE|norm)
none   -- NULL (keep the original slice)
other  -- the generic token

HMAC is built from two SHA-256 calls over the key pads (RFC 2104); the pads are
derived on the driver from the caller's salt, so pseudonym expressions hold
only the pads.  The hash action hashes ``salt|type|value`` and so carries the
salt as a literal: do not print plans of queries that use it.  Everything
stays inside the JVM.
"""

from __future__ import annotations

import hashlib
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, prefixes, base32 alphabet, alias length, hash length.
MASK_TOKEN = "[REDACTED]"
PSEUDONYM_PREFIX = {"PERSON": "Person", "ORG": "Org", "LOC": "Loc", "GPE": "Loc", "ACCOUNT": "Account"}
PSEUDONYM_DEFAULT_PREFIX = "Ent"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALIAS_LENGTH = 8
HASH_HEX_LENGTH = 12
ACTIONS = ("mask", "drop", "hash", "pseudonymize", "none")

# Characters Python's str.split()/strip() treat as whitespace, as a Java class.
PY_WHITESPACE_CHARS = (r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
                       r"\x{202f}\x{205f}\x{3000}")
PY_WHITESPACE = f"[{PY_WHITESPACE_CHARS}]"


def mask_email(s: Column) -> Column:
    at = F.instr(s, "@")
    user = F.substring_index(s, "@", 1)
    domain = F.substr(s, at + F.lit(1), F.length(s))
    return (F.when(at == 0, F.lit(MASK_TOKEN))
            .when(F.length(user) == 0, F.concat(F.lit("* @"), domain))
            .when(F.length(user) <= 1, F.concat(F.lit("*@"), domain))
            .otherwise(F.concat(F.substr(user, F.lit(1), F.lit(1)), F.lit("***@"), domain)))


def mask_phone(s: Column) -> Column:
    """Every digit but the last two becomes '*'; other characters stay."""
    return F.when(~s.rlike(r"\d"), F.lit(MASK_TOKEN)) \
        .otherwise(F.regexp_replace(s, r"\d(?=(?:\D*\d){2})", "*"))


def mask_ip(s: Column) -> Column:
    parts = F.split(s, r"\.", -1)
    return F.when(F.size(parts) == 4,
                  F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".x"))) \
        .otherwise(F.lit(MASK_TOKEN))


def mask_generic(_s: Column) -> Column:
    return F.lit(MASK_TOKEN)


# Masker registry; every type not listed masks with the generic token.
MASKERS: dict[str, Callable[[Column], Column]] = {
    "EMAIL": mask_email,
    "PHONE": mask_phone,
    "IP": mask_ip,
    "IPV6": mask_generic,
    "CREDIT_CARD": mask_generic,
    "SSN": mask_generic,
    "IBAN": mask_generic,
    "SECRET": mask_generic,
    "API_KEY": mask_generic,
}


def mask_by_type(etype: Column, s: Column) -> Column:
    expr = None
    for t, fn in MASKERS.items():
        if fn is mask_generic:
            continue
        expr = (F.when(etype == t, fn(s)) if expr is None else expr.when(etype == t, fn(s)))
    return expr.otherwise(F.lit(MASK_TOKEN)) if expr is not None else F.lit(MASK_TOKEN)


def hash_value(etype: Column, s: Column, salt: str) -> Column:
    """Deterministic fingerprint."""
    digest = F.sha2(F.encode(F.concat(F.lit(salt + "|"), etype, F.lit("|"), s), "UTF-8"), 256)
    return F.concat(F.lit("hash_"), F.substr(digest, F.lit(1), F.lit(HASH_HEX_LENGTH)))


def hmac_pads(salt: str) -> tuple[str, str]:
    """(ipad, opad) hex for HMAC-SHA256 with ``salt`` as key."""
    key = salt.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def normalise_alias_text(s: Column) -> Column:
    """Trim, collapse whitespace runs to one space, lower-case."""
    ws = PY_WHITESPACE
    trimmed = F.regexp_replace(s, f"^{ws}+|{ws}+$", "")
    return F.lower(F.regexp_replace(trimmed, f"{ws}+", " "))


def hmac_sha256_hex(message_utf8: Column, salt: str) -> Column:
    ipad, opad = hmac_pads(salt)
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad)), message_utf8), 256)
    return F.sha2(F.concat(F.unhex(F.lit(opad)), F.unhex(inner)), 256)


def base32_prefix(hex_digest: Column, n_chars: int = ALIAS_LENGTH) -> Column:
    """First ``n_chars`` (<= 8) base32 characters of the digest bytes.

    The 40-bit value is bound once (a one-element array fed to a lambda), so
    the digest is not recomputed for every character inside span lambdas."""
    def chars(v):
        out = []
        for k in range(n_chars):
            idx = F.shiftright(v, 35 - 5 * k).bitwiseAND(31)
            out.append(F.substr(F.lit(BASE32_ALPHABET), idx + F.lit(1), F.lit(1)))
        return F.concat(*out)
    v = F.conv(F.substr(hex_digest, F.lit(1), F.lit(10)), 16, 10).cast("long")
    return F.element_at(F.transform(F.array(v), chars), 1)


def pseudonymize(etype: Column, s: Column, salt: str) -> Column:
    """``Prefix_XXXXXXXX``."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PSEUDONYM_PREFIX.items() for x in kv]),
                                     etype), F.lit(PSEUDONYM_DEFAULT_PREFIX))
    msg = F.encode(F.concat(etype, F.lit("|"), normalise_alias_text(s)), "UTF-8")
    return F.concat(prefix, F.lit("_"), base32_prefix(hmac_sha256_hex(msg, salt)))


def replacement(etype: Column, s: Column, action: Column, salt: str) -> Column:
    """A1-A10: NULL for ``none`` (keep), else the replacement string."""
    return (F.when(action == "none", F.lit(None).cast("string"))
            .when(action == "mask", mask_by_type(etype, s))
            .when(action == "drop", F.lit(""))
            .when(action == "hash", hash_value(etype, s, salt))
            .when(action == "pseudonymize", pseudonymize(etype, s, salt))
            .otherwise(F.lit(MASK_TOKEN)))
