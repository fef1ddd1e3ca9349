"""Text to lines, line predicates, pattern dialects, and set similarities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_lines(files: DataFrame, key: str, content: str, *carry: str) -> DataFrame:
    """key, carried columns, line_no (from 1 on), line; split at line feeds, empty last line kept."""
    parts = F.split(F.col(content), "\n", -1)
    return files.select(key, *carry, F.posexplode(parts).alias("_p", "line")).select(key, *carry, (F.col("_p") + 1).alias("line_no"), "line")


def split_lines(content: Column) -> Column:
    """Lines as by every line boundary of Unicode (CR, VT, FF, FS, GS, RS, NEL, LS and PS too); no empty last line."""
    parts = F.split(content, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_comment(line: Column) -> Column:
    """Whether a line, blanks apart, begins like a comment."""
    return F.ltrim(line).rlike(r"^(#|//|/\*|\*)")


def line_of(content: Column, position: Column) -> Column:
    """The line number (from 1 on) of a position (from 1 on)."""
    return F.size(F.split(F.substring(content, F.lit(1), position), "\n", -1))


def column_of(content: Column, position: Column) -> Column:
    """The column (from 1 on) of a position (from 1 on)."""
    head = F.substring(content, F.lit(1), position - 1)
    return F.length(F.element_at(F.split(head, "\n", -1), -1)) + 1


def dialect(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with the meaning it has for Python's re with MULTILINE: Unicode classes, and only line feeds end lines."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return f"(?m{'i' if ignore_case else ''}dU)" + pattern.replace(r"\Z", r"\z")


def glob_regex(glob: str) -> str:
    """A whole-match regex of a file glob; a comma list matches any of its members."""
    out = []
    for one in (g.strip() for g in glob.split(",")):
        text, at = "", 0
        while at < len(one):
            c = one[at]
            if one.startswith("**/", at):
                text, at = text + "(?:.*/)?", at + 3
                continue
            if c == "*":
                text += ".*"
            elif c == "?":
                text += "."
            elif c == "[" and (end := one.find("]", at + 2)) > 0:
                inner = one[at + 1 : end]
                text += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
                at = end
            else:
                text += re.escape(c)
            at += 1
        out.append(text)
    return "^(?s:" + "|".join(out) + ")$"


_ABSENCE = re.compile(r"^\^?\(\?!(?:\[\\s\\S\]\*|\.\*)\(?\??:?([^()]*)\)?\)(?:\[\\s\\S\]\*|\.\*)?\$?$")


def absence_words(pattern: str) -> list[str] | None:
    """The words of a pattern that only says that none of them occurs ("not anywhere ahead"), or None."""
    m = _ABSENCE.match(re.sub(r"^\(\?[a-z]+\)", "", pattern))
    if not m or not m.group(1):
        return None
    words = [re.sub(r"\\(.)", r"\1", w) for w in m.group(1).split("|")]
    return words if all(w and not re.search(r"[\[\]{}*+?^$]|\\[a-zA-Z]", raw) for w, raw in zip(words, m.group(1).split("|"), strict=True)) else None


def shingles(lines: DataFrame, key: str, size: int, *order: str) -> DataFrame:
    """The joined text of each run of size lines of a key; lines: key, line_no, line."""
    w = Window.partitionBy(key).orderBy(*(order or ("line_no",)))
    text = F.concat_ws("\n", "line", *(F.lead("line", k).over(w) for k in range(1, size)))
    return lines.withColumn("shingle", text).withColumn("_last", F.lead("line", size - 1).over(w)).where(F.col("_last").isNotNull()).drop("_last")


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters, in time linear in the text: it is split once, then paired with itself."""
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.array(F.split(text, "")), pairs)[0]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def masked_identifiers(line: Column) -> Column:
    """A line with each identifier of three characters or more as VAR."""
    return F.regexp_replace(line, r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b", "VAR")


def contrast(r1, g1, b1, r2, g2, b2) -> Column:
    """The contrast ratio of two colours given by columns of 0 to 255."""

    def channel(c):
        s = c / F.lit(255.0)
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))

    def luminance(r, g, b):
        return 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)

    x, y = luminance(r1, g1, b1), luminance(r2, g2, b2)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
