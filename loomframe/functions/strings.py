"""String functions. Positions count code points from 0; null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row: lambdas of arrays compute an expression anew for each element, a variable not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fail_if(condition: Column, message: str, value: Column) -> Column:
    """`value`, or an error where the condition holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def trim(s: Column) -> Column:
    return F.regexp_replace(s.cast("string"), f"^{SPACE}+|{SPACE}+$", "")


def length(s: Column) -> Column:
    """0 for null."""
    return F.coalesce(F.length(s), F.lit(0))


def repeat(s: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return fail_if(n < 0, "repeat: negative count", F.repeat(s, n))


def split(s: Column, separator: str) -> Column:
    """By a literal; an empty one splits into characters, and empty ends stay."""
    if separator == "":
        return F.filter(F.split(s, "", -1), lambda c: c != "")
    return F.split(s, re.escape(separator), -1)


def split_regex(s: Column, pattern: str) -> Column:
    return F.split(s, pattern, -1)


def join(a: Column, separator: str) -> Column:
    """Null elements read `null`."""
    return F.array_join(a.cast("array<string>"), separator, "null")


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """[start, end); an error out of range."""
    stop = F.length(s) if end is None else F.lit(end)
    bad = (F.lit(start) < 0) | (F.lit(start) > stop) | (stop > F.length(s))
    return fail_if(bad, "substring: out of range", F.substr(s, F.lit(start + 1), stop - start))


def char_at(s: Column, i: int) -> Column:
    return fail_if((F.lit(i) < 0) | (F.lit(i) >= F.length(s)), "charAt: out of range", F.substr(s, F.lit(i + 1), F.lit(1)))


def char_code_at(s: Column, i: int) -> Column:
    """Code point, from the character's UTF-32 bytes."""
    return F.conv(F.hex(F.encode(char_at(s, i), "UTF-32")), 16, 10).cast("int")


def from_char_code(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def index_of(s: Column, part: str) -> Column:
    """-1 where absent."""
    return F.instr(s, part) - 1


def last_index_of(s: Column, part: str) -> Column:
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at == 0, -1).otherwise(F.length(s) - at + 1 - len(part))


def append_if_missing(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), s).otherwise(F.concat(s, F.lit(suffix)))


def prepend_if_missing(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), s).otherwise(F.concat(F.lit(prefix), s))


def upper(s: Column) -> Column:
    return F.upper(s.cast("string"))


def lower(s: Column) -> Column:
    return F.lower(s.cast("string"))


def to_upper(s: Column) -> Column:
    """As `upper`, but null is an error."""
    return fail_if(s.isNull(), "toUpper: null", upper(s))


def to_lower(s: Column) -> Column:
    return fail_if(s.isNull(), "toLower: null", lower(s))


def slice(s: Column, start: int, end: int) -> Column:  # noqa: A001
    """[start, end) of the characters, negative bounds from the end, clamped."""
    n = F.length(s)
    a, b = (F.least(F.greatest(F.lit(i) if i >= 0 else n + i, F.lit(0)), n) for i in (start, end))
    return F.substr(s, a + 1, F.greatest(b - a, F.lit(0)))


def range_index(s: Column, start: int, end: int) -> Column:
    """start to end inclusive, downwards too; null where a bound is out of range."""
    n = F.length(s)
    a, b = (F.lit(i) if i >= 0 else n + i for i in (start, end))
    ok = (a >= 0) & (b >= 0) & (a < n) & (b < n)
    part = F.substr(s, F.least(a, b) + 1, F.abs(b - a) + 1)
    return F.when(ok & (a <= b), part).when(ok, F.reverse(part))


def lines(s: Column) -> Column:
    """The lines of a text, without their ends and without an empty last one."""
    return F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n", -1)


def unlines(a: Column) -> Column:
    """Lines as text, each with its end."""
    return F.concat(F.array_join(a, "\n", ""), F.when(F.size(a) > 0, "\n").otherwise(""))


def to_base64(s: Column) -> Column:
    """One line, padded."""
    return F.regexp_replace(F.base64(F.encode(s, "UTF-8")), r"\s", "")


def from_base64(s: Column) -> Column:
    """An error for text that is no base 64."""
    data = F.try_to_binary(s, F.lit("base64"))
    return fail_if(data.isNull() & s.isNotNull(), "fromBase64: invalid", F.decode(data, "UTF-8"))


def to_hex(s: Column) -> Column:
    return F.lower(F.hex(F.encode(s, "UTF-8")))


def from_hex(s: Column) -> Column:
    """An error for text that is no pairs of hex digits."""
    return fail_if(~s.rlike("^([0-9A-Fa-f]{2})*$"), "fromHex: invalid", F.decode(F.unhex(s), "UTF-8"))


def hashed(s: Column, algorithm: str) -> Column:
    """MD5, SHA-1, SHA-256, SHA-384 or SHA-512 in lower-case hex; case, `-` and `_` of the name do not matter."""
    name = re.sub("[-_]", "", algorithm.lower())
    if name == "md5":
        return F.md5(F.encode(s, "UTF-8"))
    if name in ("sha1", "sha"):
        return F.sha1(F.encode(s, "UTF-8"))
    if name in ("sha256", "sha384", "sha512"):
        return F.sha2(F.encode(s, "UTF-8"), int(name[3:]))
    raise ValueError(f"unknown algorithm {algorithm}")


def humps(s: Column, mark: str) -> Column:
    """A mark before each capital inside that has a small letter before or after it."""
    return F.regexp_replace(s, r"(?s)(?<=.)(?=\p{Lu})(?:(?<=\p{Ll})|(?=\p{Lu}\p{Ll}))", mark)


def capitalize(s: Column) -> Column:
    """Words parted by white space or a small letter before a capital, each with one capital."""
    words = F.filter(F.split(F.regexp_replace(s, r"(\p{Ll})(?=\p{Lu})", "$1 "), rf"{SPACE}+", -1), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def camelize(s: Column) -> Column:
    parts = F.filter(F.split(s, "[-_]", -1), lambda p: p != "")
    rest = lambda p: F.substr(p, F.lit(2))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.concat(F.lower(F.substring(p, 1, 1)), rest(p))).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), rest(p)))), "")


def dasherize(s: Column) -> Column:
    return F.lower(humps(s, "-"))


def underscore(s: Column) -> Column:
    return F.lower(humps(s, "_"))


def pluralize(s: Column) -> Column:
    cut = lambda n: F.substr(s, F.lit(1), F.length(s) - n)
    return (
        F.when(s.rlike("(?i)[^aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .when(s.rlike("(?i)(ch|sh|s|x|z)$"), F.concat(s, F.lit("es")))
        .when(s.rlike("(?i)fe$"), F.concat(cut(2), F.lit("ves")))
        .when(s.rlike("(?i)f$"), F.concat(cut(1), F.lit("ves")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def singularize(s: Column) -> Column:
    cut = lambda n: F.substr(s, F.lit(1), F.length(s) - n)
    return (
        F.when(s.rlike("(?i).ies$"), F.concat(cut(3), F.lit("y")))
        .when(s.rlike("(?i)ives$"), F.concat(cut(3), F.lit("fe")))
        .when(s.rlike("(?i).ves$"), F.concat(cut(3), F.lit("f")))
        .when(s.rlike("(?i)(ch|sh|s|x|z)es$"), cut(2))
        .when(s.rlike("(?i)[^s]s$"), cut(1))
        .otherwise(s)
    )


def ordinalize(n: Column) -> Column:
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    end = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def left_pad(s: Column, n: int, pad: str = " ") -> Column:
    """Never shortens."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, pad))


def right_pad(s: Column, n: int, pad: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, pad))


def starts_with(s: Column, prefix: str) -> Column:
    """False for null."""
    return F.coalesce(F.startswith(s.cast("string"), F.lit(prefix)), F.lit(False))


def ends_with(s: Column, suffix: str) -> Column:
    return F.coalesce(F.endswith(s.cast("string"), F.lit(suffix)), F.lit(False))


def contains(s: Column, part: str) -> Column:
    return F.coalesce(F.contains(s, F.lit(part)), F.lit(False))


def contains_regex(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(pattern), F.lit(False))


def replace(s: Column, part: str, by: str) -> Column:
    """All occurrences of a literal."""
    return F.replace(s, F.lit(part), F.lit(by))


def replace_regex(s: Column, pattern: str, by: str) -> Column:
    """`$1` and `${name}` in `by` stand for groups."""
    return F.regexp_replace(s, pattern, by)


def find(s: Column, part: str) -> Column:
    """All offsets of a literal, overlapping ones too."""
    spots = F.when(F.length(s) >= len(part), F.sequence(F.lit(0), F.length(s) - len(part))).otherwise(F.array().cast("array<int>"))
    return F.when(s.isNotNull(), F.filter(spots, lambda i: F.substr(s, i + 1, F.lit(len(part))) == part))


def find_regex(s: Column, pattern: str) -> Column:
    """[start, end) of all matches, from the lengths of the matches and of what is between them."""
    found, between = F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.split(s, pattern, -1)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(so_far: Column, x: Column) -> Column:
        a, b = so_far["at"] + x["b"], so_far["at"] + x["b"] + x["m"]
        return F.struct(b.alias("at"), F.array_append(so_far["out"], F.struct(a.alias("start"), b.alias("end"))).alias("out"))

    return F.aggregate(sizes, start, step, lambda x: x["out"])


def regex(pattern: str, flags: str = "") -> str:
    """A pattern with flags, for all functions that take one: i, m, s, u, x."""
    if set(flags) - set("imsux"):
        raise ValueError(f"regex: unknown flags {flags}")
    return f"(?{flags}){pattern}" if flags else pattern


def groups_of(pattern: str) -> int:
    """Groups of a Java pattern: an opening bracket that is not escaped or in a class, and plain or named."""
    bare = re.sub(r"\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def match(s: Column, pattern: str) -> Column:
    """[whole, group 1, ...] of a match of the full string, or an empty array."""
    full = rf"\A(?:{pattern})\z"
    groups = [F.regexp_extract(s, full, i) for i in range(groups_of(pattern) + 1)]
    return F.when(s.rlike(full), F.array(*groups)).when(s.isNotNull(), F.array().cast("array<string>"))


def matches(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def scan(s: Column, pattern: str) -> Column:
    """[whole, group 1, ...] of every match."""
    n = groups_of(pattern) + 1
    each = [F.regexp_extract_all(s, F.lit(pattern), F.lit(i)) for i in range(n)]
    return F.transform(each[0], lambda _, i: F.array(*[F.get(g, i) for g in each]))


def is_blank(s: Column) -> Column:
    return s.isNull() | (trim(s) == "")


def to_text(v: Column) -> Column:
    """A scalar as text: null reads `null`, whole doubles have no fraction."""
    text = v.cast("string")
    return F.coalesce(F.regexp_replace(text, r"^(-?\d+)\.0$", "$1"), F.lit("null"))


def interpolate(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else to_text(p) for p in parts])
