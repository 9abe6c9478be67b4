"""Digests and seeded draws as column expressions."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def id_list_json(ids: Column) -> Column:
    """Canonical JSON of an array of identifiers (plain ASCII, so nothing needs escaping)."""
    return F.concat(F.lit('["'), F.array_join(ids, '","'), F.lit('"]'))


def canonical_record(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object of text and whole numbers: keys in order, no spaces; text is plain ASCII without quotes. Null fields are null."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        value = fields[name].cast("string")
        quoted = F.when(F.typeof(fields[name]) == "string", F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
        parts += [F.lit(f'{"," if i else "{"}"{name}":'), F.coalesce(quoted, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hex, from the plain hash: hash(outer, hash(inner, message))."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def xor_pad(key_hex: Column, byte: int) -> Column:
    """A key of 32 bytes (hex) filled up to a block of 64 with zeros, every byte combined with one byte."""
    own = lambda i: F.when(i < 32, F.conv(F.substring(key_hex, 2 * i + 1, 2), 16, 10).cast("int")).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(own(i).bitwiseXOR(F.lit(byte))), 2, "0")), ""))


def unit_draw(digest: Column) -> Column:
    """The leading 64 bits of a digest (hex) as a number in [0, 1)."""
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") for at in (1, 9))
    return high / float(2**32) + low / float(2**64)


def keyed_uniform(inner: Column, outer: Column, domain: str, key: Column) -> Column:
    """As uniform, with a key that differs by row: inner and outer are its two pads (xor_pad with 0x36 and 0x5c)."""
    message = F.concat(F.lit(domain + "\x1f"), key).cast("binary")
    return unit_draw(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def uniform(seed_hex: str, domain: str, key: Column) -> Column:
    """A draw in [0, 1) for each key: the leading 64 bits of HMAC(seed, domain | key)."""
    digest = hmac_sha256(bytes.fromhex(seed_hex), F.concat(F.lit(domain + "\x1f"), key))
    return unit_draw(digest)


def es6_number(x: float) -> str:
    """A double as JSON's canonical form writes it: shortest digits that read back, exponents only beyond 1e21 and below 1e-6."""
    if x != x or x in (float("inf"), float("-inf")) or (x == 0 and str(x)[0] == "-"):
        raise ValueError("not a finite number, or negative zero")
    if x == int(x) and abs(x) < 2**53:
        return str(int(x))
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part.rstrip("0")).lstrip("0")
    point = len(whole) + int(exponent or 0) if whole != "0" else int(exponent or 0) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0")
    sign = "-" if x < 0 else ""
    if 0 < point <= 21:
        text = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{digits}"
    else:
        text = f"{digits[0]}{'.' if len(digits) > 1 else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + text


def canonical_json(value) -> str:
    """JSON with sorted keys (by UTF-16 code units), no spaces, and canonical numbers."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > (1 << 53) - 1:
            raise ValueError("a whole number beyond 2**53 - 1")
        return str(value)
    if isinstance(value, float):
        return es6_number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda s: s.encode("utf-16-be"))) + "}"
    return "[" + ",".join(map(canonical_json, value)) + "]"


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(record: Column) -> Column:
    """Canonical JSON of a whole nested record (structs, maps, arrays, text, whole numbers, doubles, booleans, nulls): keys by UTF-16 units, no spaces,
    shortest numbers. Fails on NaN, infinities, negative zero, and whole numbers beyond 2**53 - 1. Records cross to Python as JSON, in batches, and once
    more as they are: JSON writes NaN as the text "NaN", so only the numbers themselves tell."""
    return _canonical(record, F.to_json(F.named_struct(F.lit("r"), record), {"ignoreNullFields": "false"}))


def digest(record: Column) -> Column:
    return F.sha2(canonical(record), 256)


def _all_finite(values: pa.Array) -> bool:
    """No NaN and no infinity at any depth."""
    kind = values.type
    if pa.types.is_floating(kind):
        return pc.all(pc.is_finite(values)).as_py() is not False
    if pa.types.is_struct(kind):
        return all(map(_all_finite, values.flatten()))
    if pa.types.is_map(kind):
        return _all_finite(values.keys) and _all_finite(values.items)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return _all_finite(values.flatten())
    return True


@F.arrow_udf(StringType())
def _canonical(records: pa.Array, texts: pa.Array) -> pa.Array:
    if not _all_finite(records):
        raise ValueError("a number that is not finite")
    return pa.array([None if t is None else canonical_json(json.loads(t)["r"]) for t in texts.to_pylist()], pa.string())
