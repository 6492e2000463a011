"""Text and code normalisation as Column expressions. They stay in the JVM and can be pushed and pruned.

White space is ASCII throughout (space, tab, line feed, carriage return, form feed, vertical tab).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\f\x0b"
WHITE = BLANK + "\n"
#: The documentation tags that a model's answer is trimmed to.
TAGS = ("@brief", "@param", "@return", "@throws", "@note", "@details")


def strip(c: Column, chars: str = WHITE) -> Column:
    return F.btrim(c, F.lit(chars))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def join_lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_cpp_code(c: Column) -> Column:
    """Comments out, blanks collapsed, punctuation tightened, lines trimmed, empty lines out."""
    c = chain(
        c,
        (r"(?s)/\*.*?\*/", ""),
        (r"//[^\n]*", ""),
        (r"[ \t]+", " "),
        (r" ([<>{}\[\]();,&*:])", "$1"),
        (r"([<>{}\[(:*&]) ", "$1"),
    )
    return join_lines(F.filter(F.transform(lines(c), lambda x: strip(x, BLANK)), lambda x: x != ""))


# The patterns of clean_cpp_code, clean_docstring and clean_comment, whose outcome must match.


def clean_docstring(c: Column) -> Column:
    """Frames, markers and leading stars out, blanks and line feeds collapsed."""
    c = chain(
        c,
        (r"(?md)^[*+-]+$", ""),
        (r"(?md)^/\*\*|\*/", ""),
        (r"(?md)^[ \t\r\n\f]*\* ?", ""),
        (r"(?md)^-+$", ""),
        (r"[ \t]{2,}", " "),
        (r" *\n *", "\n"),
        (r"\n{2,}", "\n"),
        (r"(?md)^[*+-]+$", ""),
        (r"\n{2,}", "\n"),
    )
    return strip(c)


def clean_comment(c: Column) -> Column:
    """Rules and empty comments out, slashes and group marks off, joined by single blanks."""
    kept = F.filter(F.transform(lines(c), lambda x: strip(x, BLANK)), lambda x: (x != "") & ~x.rlike(r"^//[-+=]+[ \t]*$") & ~x.rlike(r"^//[-+]*[ \t]*$"))
    bare = F.transform(kept, lambda x: strip(chain(x, (r"^//[-+]*[ \t]*", ""), (r"@[{}]", "")), BLANK))
    return strip(F.regexp_replace(F.array_join(F.filter(bare, lambda x: x != ""), " "), r"[ \t\r\f]+", " "))


def normalize_indent(c: Column, tab: int = 4, most_feeds: int = 2) -> Column:
    """Right-trimmed lines, no blank lines at the ends, tabs to blanks, at most so many line feeds together.

    P1b, runs of blank lines to one, is most_feeds=2: a blank line is two line feeds.
    """
    c = join_lines(F.transform(lines(c), lambda x: F.rtrim(x, F.lit(BLANK))))
    c = chain(c, (r"^\n+", ""), (r"\n+$", ""))
    return F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" " * tab)), r"\n{%d,}" % (most_feeds + 1), "\n" * most_feeds)


def drop_hash_lines(c: Column) -> Column:
    """P25."""
    return strip(join_lines(F.filter(lines(c), lambda x: ~x.startswith("#"))))


def docstring_blocks(c: Column) -> Column:
    """Docstring blocks joined by line feeds, '' if there are none."""
    pattern = "(\"\"\"[\\s\\S]*?\"\"\"|'''[\\s\\S]*?'''|/\\*\\*[\\s\\S]*?\\*/)"
    return join_lines(F.regexp_extract_all(c, F.lit(pattern), 1))


def strip_reasoning(c: Column, last: bool = False) -> Column:
    """What follows the first (or last) closing tag; all of it without one."""
    tag = "</think>"
    after = F.substring_index(c, tag, -1) if last else F.substring(c, F.locate(tag, c) + len(tag), F.length(c))
    return F.when(F.contains(c, F.lit(tag)), strip(after)).otherwise(c)


def clean_response(c: Column) -> Column:
    """From the first known tag (in order of TAGS) to the last one, each stripped line once, empty lines out."""
    first = F.coalesce(*(F.when(F.contains(c, F.lit(t)), F.locate(t, c)) for t in TAGS), F.lit(1))
    cut = F.substring(c, first, F.length(c))
    ends = [F.when(F.contains(cut, F.lit(t)), F.length(cut) - F.length(F.substring_index(cut, t, -1))) for t in TAGS]
    cut = F.substring(cut, F.lit(1), F.coalesce(F.greatest(*ends), F.length(cut)))
    return join_lines(_once(F.filter(lines(cut), lambda x: strip(x, BLANK) != "")))


def _once(array: Column) -> Column:
    """The first of the elements that are equal when stripped."""
    # variables of a lambda are computed once; written out, all lines would be split and stripped again for each line
    both = F.transform(F.array(array), lambda a: F.struct(a.alias("all"), F.transform(a, lambda x: strip(x, BLANK)).alias("bare")))
    kept = F.transform(both, lambda b: F.filter(b["all"], lambda _, i: F.array_position(b["bare"], F.get(b["bare"], i)) == i + 1))
    return F.get(kept, F.lit(0))


def split_declaration(c: Column) -> Column:
    """struct(declaration, body): what precedes the first brace, and the rest; without a brace all is declaration."""
    at = F.locate("{", c)
    none = at == 0
    return F.struct(
        F.when(none, strip(c)).otherwise(strip(F.substring(c, F.lit(1), at - 1))).alias("declaration"),
        F.when(~none, strip(F.substring(c, at, F.length(c)))).alias("body"),
    )


TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]"


def token_count(c: Column) -> Column:
    """P20 without a tokenizer: words and single other characters. ``sources.model.token_counter`` plugs one in."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN)).cast("long")


def hash_choice(key: Column, n: int) -> Column:
    """A number below n that depends on key only: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def length_bucket(n: Column) -> Column:
    """P32."""
    return F.when(n <= 1500, "short").when(n <= 3000, "medium").otherwise("long")


#: What documentation begins with.
DOCUMENTATION = ("/**", "/*!", "///", "//!")


def classify_comment(c: Column) -> Column:
    """E28."""
    doc = F.lit(False)
    for mark in DOCUMENTATION:
        doc = doc | F.ltrim(c, F.lit(BLANK)).startswith(mark)
    return F.when(doc, "docstring").otherwise("comment")


def is_noteworthy(c: Column) -> Column:
    """A comment longer than 10 characters that is not a rule line."""
    return (F.length(c) > 10) & ~c.rlike(r"^[\s/*=+#~-]*$")
