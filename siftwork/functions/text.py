"""Lines, positions, digests and small mappings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class that Java and RE2 read alike.
SPACE = "[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def lines(content: Column) -> Column:
    """Lines split at line feeds, each that one ended less one carriage return, without the empty one after a final line feed."""
    parts = F.split(content, "\n", -1)
    body = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    ended = F.transform(body, lambda x, i: F.when(x.endswith("\r") & (i < F.size(parts) - 1), F.left(x, F.length(x) - 1)).otherwise(x))
    return F.when(content.contains("\r\n"), ended).otherwise(body)


def line_at(content: Column, line: Column) -> Column:
    """The line of a 1-based number; null outside."""
    return F.try_element_at(lines(content), line)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def spaced(word: str) -> str:
    """A pattern for a word with white space anywhere in it."""
    return f"{SPACE}*".join("".join(f"\\{c}" if c in "\\.*+?()[]{}|^$-/" else c) for c in word)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def byte_slice(text: Column, begin: Column, end: Column) -> Column:
    """Bytes [begin, end) of the UTF-8 form, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), begin + 1, end - begin), "UTF-8")


def utf16_col(content: Column, row: Column, byte_col: Column) -> Column:
    """1-based UTF-16 column of a 0-based row and byte column; lines end at line feeds alone, so \\r counts.

    Null outside the content, beyond the line and inside a character.
    """
    line = F.when(row >= 0, F.try_element_at(F.split(content, "\n", -1), row + 1))
    raw = F.encode(line, "UTF-8")
    inside = F.hex(F.substring(raw, byte_col + 1, 1)).rlike("^[89AB]")
    ok = (byte_col >= 0) & (byte_col <= F.octet_length(raw)) & ~F.coalesce(inside, F.lit(False))
    return F.when(ok, utf16_length(byte_slice(line, F.lit(0), byte_col)) + 1)


def line_of_offset(content: Column, offset: Column) -> Column:
    """1-based line of a byte offset; null at or beyond the end."""
    head = F.substring(F.encode(content, "UTF-8"), F.lit(1), offset)
    latin = F.decode(head, "ISO-8859-1")
    feeds = F.length(latin) - F.length(F.replace(latin, F.lit("\n"), F.lit("")))
    return F.when(offset < F.octet_length(content), feeds + 1)


def fingerprint(rule: Column, path: Column, content: Column, regions: Column) -> Column:
    """Hex SHA-256 over rule|path|bytes|stripped line|bytes of each region's line, comma-joined; null if no line exists."""
    rows = F.transform(regions, lambda n: line_at(content, n))
    kept = F.transform(F.filter(rows, lambda x: x.isNotNull()), stripped)
    parts = F.transform(kept, lambda s: _region(rule, path, s))
    return F.when(F.size(parts) > 0, F.sha2(F.array_join(parts, ","), 256))


def line_fingerprint(rule: Column, path: Column, line: Column) -> Column:
    """fingerprint of one region whose line is at hand."""
    return F.sha2(_region(rule, path, F.when(line.isNotNull(), stripped(line))), 256)


def _region(rule: Column, path: Column, bare: Column) -> Column:
    """Null without a line."""
    return F.when(bare.isNotNull(), F.concat_ws("|", rule, path, F.octet_length(path).cast("string"), bare, F.octet_length(bare).cast("string")))


def percent_encode(path: Column) -> Column:
    """Controls, non-ASCII bytes and space " < > ` [ ] # % as %XX."""
    out = F.replace(path, F.lit("%"), F.lit("%25"))
    for c in ' "<>`[]#':
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    for n in (*range(32), 127):
        out = F.when(F.instr(out, chr(n)) > 0, F.replace(out, F.lit(chr(n)), F.lit(f"%{n:02X}"))).otherwise(out) if n in (9, 10, 13) else out
    # other controls and non-ASCII characters are rare: encode by character where there are any
    odd = F.split(out, "")
    each = F.transform(odd, lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f]|[^\x00-\x7f]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(out.rlike(r"[\x00-\x1f\x7f]|[^\x00-\x7f]"), F.array_join(each, "")).otherwise(out)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "NOTICE", "note").when(severity == "WARNING", "warning").when(severity == "ERROR", "error").otherwise("none")


def priority_severity(priority: Column) -> Column:
    p = F.lower(priority)
    return F.when(p.isin("critical", "high"), "ERROR").when(p == "medium", "WARNING").otherwise("NOTICE")


def status_severity(status: Column) -> Column:
    return F.when(status == "NOT_VALIDATED", "NOTICE").when(status == "INVALID", "NONE").when(status == "VALIDATION_ERROR", "WARNING").when(status.isin("VALID", "NOT_AVAILABLE"), "ERROR")


def status_tag(status: Column, prefix: str = "SECRET_VALIDATION_STATUS") -> Column:
    return F.concat(F.lit(f"{prefix}:"), status)


def doc_url(url: Column, base: str, rule: Column) -> Column:
    return F.coalesce(url, F.concat(F.lit(base), rule))


def rule_checksum(code_base64: Column) -> Column:
    """Of the base64 text itself."""
    return F.sha2(code_base64, 256)


def rule_digest(name: Column, pattern: Column, code: Column) -> Column:
    return F.concat_ws(":", name, F.coalesce(pattern, F.lit("no pattern")), code)


def decoded(base64: Column) -> Column:
    return F.decode(F.unbase64(base64), "UTF-8")
