"""Column expressions over text with the line and white-space rules of Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that str.isspace and str.splitlines accept, as Java classes.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
#: Size buckets by non-blank lines, and their sampling weights.
SIZE_BUCKETS = (("tiny", 10, 0.35), ("short", 40, 1.0), ("medium", 120, 1.0), ("long", 250, 0.6))
LARGEST_BUCKET = ("huge", 0.25)


def lines(text: Column) -> Column:
    """The lines of text without their ends; a final line end opens no line."""
    parts = F.split(text, BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + r"+\z", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(rstrip(text), r"\A" + SPACE + "+", "")


def closed(text: Column) -> Column:
    """text without trailing white space, ended by one line feed."""
    return F.concat(rstrip(text), F.lit("\n"))


def line_count(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, BREAK), lambda x: x.rlike(NOT_SPACE)))


def token_count(text: Column) -> Column:
    """Runs of other than white space."""
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda x: x != ""))


def size_bucket(loc: Column) -> Column:
    chain = F
    for name, most, _ in SIZE_BUCKETS:
        chain = chain.when(loc <= most, name)
    return chain.otherwise(LARGEST_BUCKET[0])


def sampling_weight(loc: Column, family: Column | None = None) -> Column:
    """The weight of a unit's triples; windows around changed spans always weigh 1."""
    chain = F.when(family == "local_span_triplet", 1.0) if family is not None else F
    for _, most, weight in SIZE_BUCKETS:
        chain = chain.when(loc <= most, weight)
    return chain.otherwise(LARGEST_BUCKET[1])


def json_string(text: Column) -> Column:
    """text as a JSON string, other control characters as lower-case escapes."""
    plain = F.to_json(F.array(text))
    written = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    names = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    for code in range(32):
        written = F.replace(written, F.lit(chr(code)), F.lit("\\" + names.get(code, f"u{code:04x}")))
    odd = text.rlike(r"[\x00-\x07\x0B\x0E-\x1F]")
    return F.when(text.isNull(), "null").when(odd, F.concat(F.lit('"'), written, F.lit('"'))).otherwise(F.substring(plain, F.lit(2), F.length(plain) - 2))


def stable_hash(*parts: Column | str | int | tuple[Column], length: int = 20) -> Column:
    """The first hexadecimal digits of SHA-256 over the JSON array of parts.

    Plain strings and integers are values. A column is a string, unless it comes as a
    one-element tuple, which stands for a number.
    """
    pieces: list[Column] = []
    for k, part in enumerate(parts):
        if k:
            pieces.append(F.lit(","))
        if isinstance(part, str):
            pieces.append(json_string(F.lit(part)))
        elif isinstance(part, int):
            pieces.append(F.lit(str(part)))
        elif isinstance(part, tuple):
            pieces.append(F.coalesce(part[0].cast("string"), F.lit("null")))
        else:
            pieces.append(json_string(part))
    return F.substring(F.sha2(F.concat(F.lit("["), *pieces, F.lit("]")), 256), 1, length)


def hash_split(key: Column) -> Column:
    """train, validation or test, 90 to 5 to 5, by hash."""
    value = F.conv(stable_hash("split", key, length=8), 16, 10).cast("long") % 100
    return F.when(value < 90, "train").when(value < 95, "validation").otherwise("test")


def line_window(text: Column, first: Column, last: Column, radius: int) -> Column:
    """Lines first - radius to last + radius, numbered from 1 and clamped, closed by a line feed."""
    all_lines = lines(text)
    start = F.greatest(F.lit(1), first - radius)
    stop = F.least(F.size(all_lines), last + radius)
    return closed(F.array_join(F.slice(all_lines, start, F.greatest(F.lit(0), stop - start + 1)), "\n"))


def comment_prefix(language: Column) -> Column:
    return F.when(language.isin("python", "ruby"), "#").otherwise("//")


def comment_text(text: Column, language: Column) -> Column:
    """Each line of text behind the language's line comment."""
    prefix = comment_prefix(language)
    marked = F.transform(lines(text), lambda x: F.when(x == "", prefix).otherwise(F.concat(prefix, F.lit(" "), x)))
    return F.concat(F.array_join(marked, "\n"), F.lit("\n"))


def contextualize(focal: Column, imports: Column, class_context: Column, siblings: Column, language: Column) -> Column:
    """focal below its imports, class and sibling signatures, each under a tag."""

    def section(tag: str, body: Column, bare: bool = False) -> Column:
        body = strip(F.coalesce(body, F.lit("")))
        written = F.concat(comment_text(F.lit(tag), language), body) if bare else comment_text(F.concat(F.lit(tag + "\n"), body), language)
        return F.when(body != "", written)

    parts = F.array_compact(
        F.array(section("<imports>", imports, bare=True), section("<class>", class_context), section("<siblings>", siblings), F.concat(comment_text(F.lit("<focal>"), language), rstrip(focal)))
    )
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))


def byte_slice(text: Column, start: Column | int, stop: Column | int) -> Column:
    """The UTF-8 bytes start to stop of text, read as UTF-8."""
    data = F.encode(text, "UTF-8")
    start, stop = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    return F.try_validate_utf8(F.substring(data, start + 1, stop - start).cast("string"))


#: The keys that metadata is kept without.
DROPPED_KEYS = ("solutions", "incorrect_solutions")


def parse_json_maybe(text: Column) -> Column:
    """A JSON text in its shortest form; null where it isn't one."""
    return F.to_json(F.try_parse_json(text))


def scrub_metadata(text: Column) -> Column:
    """A JSON object without DROPPED_KEYS, values that are no text as text; an empty object for anything else."""
    entries = F.from_json(text, "map<string,string>")
    return F.coalesce(F.to_json(F.map_filter(entries, lambda key, _: ~key.isin(*DROPPED_KEYS))), F.lit("{}"))
