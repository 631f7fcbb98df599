"""String functions as Column expressions; positions are code points, 0-based, unless named bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(s: Column) -> Column:
    return F.char_length(s).cast("long")


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def is_valid_utf8(b: Column) -> Column:
    return F.is_valid_utf8(b)


def find(s: Column, needle: str) -> Column:
    """First position of a needle, -1 if absent."""
    return (F.instr(s, needle) - 1).cast("long")


def find_last(s: Column, needle: str) -> Column:
    r = F.instr(F.reverse(s), needle[::-1])
    return F.when(r == 0, F.lit(-1)).otherwise(F.char_length(s) - r - len(needle) + 1).cast("long")


def find_nth_char(s: Column, char: str, n: int) -> Column:
    """Position of the n-th (0-based) occurrence of a character, -1 if there are fewer."""
    parts = F.split(s, F.lit("\\Q" + char + "\\E"))
    head = F.array_join(F.slice(parts, 1, n + 1), char)
    return F.when(F.size(parts) > n + 1, F.char_length(head)).otherwise(-1).cast("long")


def count(s: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.char_length(s) - F.char_length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def span(s: Column, chars: str) -> Column:
    """Length of the prefix made of ``chars`` only."""
    return (F.char_length(s) - F.char_length(F.ltrim(s, F.lit(chars)))).cast("long")


def find_any(s: Column, chars: str) -> Column:
    """Position of the first character that is one of ``chars``, -1 if none is."""
    marked = F.instr(F.translate(s, chars, chars[0] * len(chars)), chars[0])
    return (marked - 1).cast("long")


def substring(s: Column, start: int, size: int) -> Column:
    return F.substring(s, start + 1, size)


def slice_inclusive(s: Column, start: int, end: int) -> Column:
    """Characters start .. end inclusive; negatives count from the end; bounds are clamped."""
    n = F.char_length(s)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.lit(end) if end >= 0 else n + end
    return F.when((a > b) | (a >= n), F.lit("")).otherwise(F.substr(s, a + 1, F.least(b, n - 1) - a + 1))


def trim(s: Column, chars: str) -> Column:
    return F.trim(s, F.lit(chars))


def split(s: Column, sep: str, most: int | None = None) -> Column:
    """Pieces between separators; a trailing empty piece is dropped, an empty string has none; beyond ``most`` pieces the rest is dropped."""
    parts = F.split(s, F.lit("\\Q" + sep + "\\E"))
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.slice(parts, 1, most) if most else parts


def translate(s: Column, old: str, new: str) -> Column:
    return F.translate(s, old, new)


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def compare_ignoring_case(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes, A-Z as a-z."""
    x, y = ascii_lower(a), ascii_lower(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0).cast("long")


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: ``*``, ``?``, sets such as ``[a-z]`` and ``[^x]``, and backslash before a literal."""
    quoted = lambda c: c if c.isalnum() else "\\" + c
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] == "^")) if c == "[" else -1
        if end > 0:
            body = pattern[k + 1 : end]
            negated = body.startswith("^")
            body = body[negated:]
            out.append("[" + "^" * negated + "".join(x if x == "-" and 0 < i < len(body) - 1 else quoted(x) for i, x in enumerate(body)) + "]")
            k = end
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(quoted(pattern[k]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, quoted(c)))
        k += 1
    return "".join(out)


def glob(s: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whole-string match of a glob."""
    return s.rlike(("(?si)" if ignore_case else "(?s)") + f"^{glob_regex(pattern)}$")


def is_digits(s: Column) -> Column:
    return s.rlike("^[0-9]+$")


def escaped(s: Column) -> Column:
    """Quoted, with backslash, quote, tab, newline and carriage return escaped."""
    out = s
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def truncate_bytes(s: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that cuts no character."""
    fits = F.octet_length(s) <= most
    whole = [F.try_validate_utf8(F.substring(F.encode(s, "UTF-8"), 1, most - k).cast("string")) for k in range(4)]
    return F.when(fits, s).otherwise(F.coalesce(*whole))


#: Classes of zero width: controls, formats and marks. Ranges of two columns (East Asian wide and full-width blocks).
ZERO_WIDTH = r"[\p{Cc}\p{Cf}\p{Mn}\p{Me}]"
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"


def display_width(s: Column) -> Column:
    """Columns on a terminal: 0 for marks and controls, 2 for wide and full-width characters."""
    return (F.char_length(s) - F.regexp_count(s, F.lit(ZERO_WIDTH)) + F.regexp_count(s, F.lit(WIDE))).cast("long")


def grapheme_count(s: Column) -> Column:
    """Extended grapheme clusters."""
    return F.size(F.regexp_extract_all(s, F.lit(r"\X"), F.lit(0))).cast("long")


def shell_split(s: Column) -> Column:
    """Arguments of a command line with quotes and backslashes; null if a quote isn't closed."""
    part = r"""(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')"""
    args = F.regexp_extract_all(s, F.lit(f"(?s){part}+"), F.lit(0))
    # inside double quotes a backslash only goes before a quote or another one
    pieces = lambda x: F.regexp_extract_all(x, F.lit(r"""(?s)"(?:[^"\\]|\\.)*"|'[^']*'|\\.|[^"'\\]+"""), F.lit(0))
    bare = lambda p: F.when(p.startswith("'"), F.substr(p, F.lit(2), F.char_length(p) - 2)).when(p.startswith('"'), F.regexp_replace(F.substr(p, F.lit(2), F.char_length(p) - 2), r'\\([\\"])', "$1")).otherwise(F.regexp_replace(p, r"(?s)\\(.)", "$1"))
    out = F.transform(args, lambda x: F.array_join(F.transform(pieces(x), bare), ""))
    return F.when(s.rlike(rf"(?s)^\s*(?:{part}+(?:\s+|$))*$"), out)


def code_point_bytes(cp: Column) -> Column:
    """UTF-8 bytes of a code point; null for surrogates and numbers out of range."""
    tail = lambda shift: F.shiftright(cp, shift).bitwiseAND(F.lit(0x3F)) + 0x80
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    two = F.concat(byte(F.shiftright(cp, 6) + 0xC0), byte(tail(0)))
    three = F.concat(byte(F.shiftright(cp, 12) + 0xE0), byte(tail(6)), byte(tail(0)))
    four = F.concat(byte(F.shiftright(cp, 18) + 0xF0), byte(tail(12)), byte(tail(6)), byte(tail(0)))
    out = F.when(cp < 0x80, byte(cp)).when(cp < 0x800, two).when(cp < 0x10000, three).otherwise(four)
    return F.unhex(F.when(cp.between(0, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF), out))


def code_point(b: Column) -> Column:
    """The first code point of UTF-8 bytes; -1 for the empty string."""
    at = lambda k: F.conv(F.hex(F.substring(b, k, 1)), 16, 10).cast("long")
    first, rest = at(1), lambda k: at(k).bitwiseAND(F.lit(0x3F))
    two = (first - 0xC0) * 64 + rest(2)
    three = ((first - 0xE0) * 64 + rest(2)) * 64 + rest(3)
    four = (((first - 0xF0) * 64 + rest(2)) * 64 + rest(3)) * 64 + rest(4)
    return F.when(F.octet_length(b) == 0, F.lit(-1)).when(first < 0x80, first).when(first < 0xE0, two).when(first < 0xF0, three).otherwise(four)


def byte_offset(s: Column, chars: int | Column) -> Column:
    """Byte offset of a character position; the size in bytes beyond the end."""
    return F.octet_length(F.left(s, F.lit(chars) if isinstance(chars, int) else chars)).cast("long")


def char_index(s: Column, offset: int) -> Column:
    """Characters that begin before a byte offset: its bytes but for those that continue a character."""
    head = F.hex(F.substring(F.encode(s, "UTF-8"), 1, offset))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    return (F.char_length(head) / 2 - F.regexp_count(pairs, F.lit("[89AB][0-9A-F] "))).cast("long")


def compare_first(a: Column, b: Column, n: int) -> Column:
    """-1, 0 or 1 by the first ``n`` code points."""
    x, y = F.left(a, F.lit(n)), F.left(b, F.lit(n))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0).cast("long")


def is_letter(s: Column) -> Column:
    return s.rlike(r"^\p{L}")


def is_digit(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}")


def is_space(s: Column) -> Column:
    return s.rlike(r"^[\p{Z}\t-\r]")


def find_not_any(s: Column, chars: str) -> Column:
    """Position of the first character that is none of ``chars``, -1 if all are."""
    return F.when(span(s, chars) < F.char_length(s), span(s, chars)).otherwise(-1).cast("long")


def span_not(s: Column, chars: str) -> Column:
    """Length of the prefix that holds none of ``chars``."""
    p = find_any(s, chars)
    return F.when(p >= 0, p).otherwise(F.char_length(s)).cast("long")


def natural_key(s: Column) -> Column:
    """A sort key under which runs of digits compare as numbers: each run is led by the length of its digits."""
    runs = F.regexp_extract_all(s, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.char_length(bare(x)).cast("string"), 5, "0"), bare(x))).otherwise(x)), "")


def pad_width(s: Column, width: int, fill: str = " ") -> Column:
    """Padded at the right to a width in characters; longer strings are cut."""
    return F.rpad(s, width, fill)


def grapheme_head(s: Column, n: int) -> Column:
    """The first ``n`` extended grapheme clusters."""
    return F.regexp_extract(s, rf"^\X{{0,{n}}}", 0)


def matches_number(s: Column, n: Column) -> Column:
    """Whether a text reads as a whole number."""
    from .numbers import parse_long

    return F.coalesce(parse_long(s) == n, F.lit(False))
