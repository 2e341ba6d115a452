"""JSON text, paths and masks as Columns. Documents are canonical JSON text; SQL NULL is absent, 'null' is JSON null."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+"|-?\d[\d.eE+-]*|[^"\d-]+|-'
#: Numbers whose text may not be the canonical one: exponents, closing zeros, more than 15 digits, very small, minus zero.
_UNSURE = r"\d[eE]|\.\d*0(?!\d)|0\.000000|\d{8}\.\d|\.\d{9}|\d{22}|-0(?![.\d])"


def _number_text(t: Column) -> Column:
    """Canonical text of a number's text: plain digits without closing zeros from 1e-6 up to 1e21, else an exponent."""
    value = t.try_cast("double")
    size = F.abs(value)
    # the fewest of 15, 16 or 17 digits that read as the same number
    shorter = [F.when(f.try_cast("double") == value, f) for f in (F.format_string(f"%.{n}e", value) for n in (14, 15, 16))]
    text = F.coalesce(*shorter, value.cast("string"))
    plain = lambda scale: F.regexp_replace(text.try_cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(F.regexp_replace(F.lower(text), r"(\.\d*?)0*e", "$1e"), r"\.e", "e")
    short = F.regexp_replace(short, r"e([+-]?)0*", "e$1")
    short = F.regexp_replace(short, r"e(\d)", "e+$1")
    whole = F.when(t.rlike("[eE]"), text).otherwise(t).try_cast("decimal(38,0)").cast("string")
    return F.when(~t.rlike(r"[.eE]|\d{22}|^-0$"), t).when((F.rint(value) == value) & (size < 1e21), whole).when((size >= 1e21) | (size < 1e-6), short).when(size < 1, plain(28)).otherwise(plain(17))


def canonical_json(col: Column | str) -> Column:
    """Deterministic text: keys sorted at every level, no HTML escapes, null kept. Malformed text gives NULL, and so do
    text that nests more than 999 levels and numbers beyond a double.

    Equal numbers are equal text, the same that the folds write: a whole number below 1e21 is its digits however it is
    written, other numbers are plain from 1e-6 on. Integers of up to 21 digits are exact; all else is read as a double.
    """
    return respelled(parsed_text(col), col)


def parsed_text(col: Column | str) -> Column:
    """The first step of ``canonical_json``: parsed and written again with sorted keys, numbers as the JVM writes them."""
    c = F.col(col) if isinstance(col, str) else col
    # the parser stops behind one value; as the only element of an array, trailing text is malformed
    items = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(items) == 1, F.to_json(F.get(items, F.lit(0))))


def respelled(text: Column | str, col: Column | str) -> Column:
    """The second step: equal numbers as equal text. It uses ``text`` several times, so where that is a column of its own it
    is parsed once a row; inside one expression Spark parses it again for every use."""
    text, c = (F.col(x) if isinstance(x, str) else x for x in (text, col))
    spelled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), lambda t: F.when(t.rlike(r"^-?\d"), _number_text(t)).otherwise(t)), "")
    return F.when(text.rlike("Infinity") & text.rlike(r'(?:^|[\[:,])-?"?Infinity"?(?:[,\]}]|$)') & ~c.contains("Infinity"), None).when(text.rlike(_UNSURE), spelled).otherwise(text)


def valid_json(col: Column | str) -> Column:
    """Whether a text is exactly one JSON value."""
    c = F.col(col) if isinstance(col, str) else col
    alone = F.size(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).cast("array<variant>")) == 1
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull(), F.lit(False))


def quoted(value: Column) -> Column:
    """JSON text of a string."""
    text = F.to_json(F.array(value))
    return F.substring(text, 2, F.length(text) - 2)


def parse_path(col: Column | str) -> Column:
    """Path text to segments: struct(kind, name, idx, key_field, key_val); kind is key, index or keyed.

    All-digit segments are indexes and ``name[field=value]`` is a keyed selector, so keys with ``.`` or ``[`` cannot be
    written.
    """
    c = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]|[^.\[]+)"), F.lit(1)), lambda s: s != "")

    def segment(s: Column) -> Column:
        body = F.substring(s, 2, 1 << 20)
        inner = F.regexp_replace(body, r"\]$", "")
        field = F.substring_index(inner, "=", 1)
        keyed, index = s.startswith("["), s.rlike(r"^\d+$")
        return F.struct(
            F.when(keyed, "keyed").when(index, "index").otherwise("key").alias("kind"),
            F.when(~keyed & ~index, s).alias("name"),
            F.when(index, s.try_cast("int")).alias("idx"),
            F.when(keyed, field).alias("key_field"),
            F.when(keyed, F.substring(inner, F.length(field) + 2, F.lit(1 << 20))).alias("key_val"),
        )

    return F.when(c == "", F.array().cast("array<struct<kind:string,name:string,idx:int,key_field:string,key_val:string>>")).otherwise(F.transform(parts, segment))


def json_pointer(path: Column) -> Column:
    """RFC 6901 pointer of a dotted path: ``~`` and ``/`` escaped. Keyed paths have none (NULL)."""
    escaped = F.replace(F.replace(path, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.when(path.contains("["), None).when(path == "", "").otherwise(F.concat(F.lit("/"), F.replace(escaped, F.lit("."), F.lit("/"))))


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: ``*`` is exactly one dot segment; the empty glob matches the root only."""
    if glob == "":
        return "^$"
    parts = glob.split(".")
    if "" in parts:
        raise ValueError(f"empty segment in path glob {glob!r}")
    return "^" + r"\.".join(r"[^.]*" if p == "*" else re.escape(p) for p in parts) + "$"


def collection_mask(col: Column | str, patterns: list[str]) -> Column:
    """Whether a collection name matches any pattern: ``*`` all, ``crm.*`` crm and below, else exact; no pattern, nothing."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(False)
    for p in patterns:
        if p == "*":
            return F.lit(True)
        out = out | ((c == p[:-2]) | c.startswith(p[:-1]) if p.endswith(".*") else c == p)
    return out


def mask_names(col: Column | str) -> Column:
    """Every pattern that shows a collection name: itself, ``*``, and for each of its dotted prefixes (the name included)
    that prefix with ``.*``."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "."), F.lit(".*")))
    return F.when(c.isNotNull(), F.concat(F.array(c, F.lit("*")), below))


def valid_collection(col: Column | str) -> Column:
    """Whether a collection name is well formed."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(r"^[a-z0-9]+(\.[a-z0-9]+)*\z")


def physical_name(col: Column | str) -> Column:
    """Storage name of a collection."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(c, F.lit("."), F.lit("_"))


def hmac_sha256(body: Column, secret: str) -> Column:
    """``sha256=`` and the hex HMAC-SHA256 of a body; native, the pads come from the secret on the driver."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, digest), 256))


def encode_cursor(**fields) -> str:
    """A page cursor: base64url JSON."""
    return base64.urlsafe_b64encode(json.dumps(fields, sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    """The fields of a cursor; malformed text raises ValueError."""
    try:
        out = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(out, dict):
        raise ValueError("malformed cursor")
    return out
