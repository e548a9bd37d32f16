"""Text functions as column expressions; nothing here leaves the JVM.

Null texts count as empty ones throughout, as in a row-at-a-time engine that reads missing cells as "".
White space is ASCII white space and the ideographic space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{3000}]+"
#: Marks that part the tags of a cell of tags.
TAG_MARKS = "[、；;，,/ ]+"
TAG_JOIN = "、"
#: Words too common to match on.
STOP_WORDS = (
    "下列 有关 说法 正确 不正确 的是 其中 我国 关于 进行 可以 一定 属于 具有 说明 判断 选择 "
    "中考 化学 试卷 题目 选项 中国 年份 过程 物质 实验"
).split()
#: What a token is; headings cut from the end of a stem; what is cut from names.
WORD = "[A-Za-z][A-Za-z0-9]+|[一-龥]{2,}"


STEM_TAILS = (r"\s+[一二三四五六七八九十]+、(?:计算题|实验与探究题|非选择题|选择题).*$", r"\s+[0-9]{4}年.+?参考答案与试题解析.*$")
NAME_BRACKETS = "【[^】]*(?:脚本|录音|定稿|终版|逐字稿|解题)[^】]*】"
NAME_MARKS = r"[\[\]（）()【】《》_+ \x{3000}·•\-—]+"
NAME_WORDS = "(?:脚本|录音稿|逐字稿|定稿|终版|最终稿|不含批注|含题干|解题课|录屏课|新版|新修|副本|复制|[vV][0-9]+)"


def text(c: Column) -> Column:
    """The text, or "" for null."""
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """White space collapsed and trimmed; wide parentheses and colons made narrow."""
    return F.translate(F.trim(F.regexp_replace(text(c), SPACE, " ")), "（）：", "():")


def compact(c: Column) -> Column:
    """``normalize`` without any spaces: the form in which keys are looked for."""
    return F.replace(normalize(c), F.lit(" "), F.lit(""))


def compact_key(key: str) -> str:
    """``compact`` of a literal."""
    return "".join(key.split()).translate(str.maketrans("（）：", "():"))


def clean_stem(c: Column) -> Column:
    """``normalize``, then cut a trailing section heading and a trailing answer-key heading."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize(c), STEM_TAILS[0], ""), STEM_TAILS[1], ""))


def slug(c: Column) -> Column:
    """Runs of anything but letters, digits, ideographs, ``_`` and ``-`` become ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text(c), "[^A-Za-z0-9_一-龥-]+", "_"), "^_+|_+$", "")


def short(c: Column, limit: int = 180) -> Column:
    """``normalize``, and no longer than ``limit`` characters with an ellipsis as the last."""
    t = normalize(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit - 1)), F.lit("…")))


def tokens(c: Column) -> Column:
    """Distinct Latin words and whole runs of ideographs of two and more, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(WORD), F.lit(0)))


def keywords(c: Column) -> Column:
    """``tokens`` without the stop words."""
    return F.array_except(tokens(c), F.array(*map(F.lit, STOP_WORDS)))


def split_tags(c: Column) -> Column:
    """The distinct tags of a cell, in order."""
    return F.array_distinct(F.filter(F.split(text(c), TAG_MARKS), lambda x: x != ""))


def join_tags(tags: Column) -> Column:
    """The distinct non-empty tags of an array as a cell."""
    return F.array_join(F.array_distinct(F.filter(tags, lambda x: x.isNotNull() & (x != ""))), TAG_JOIN)


def first_filled(*columns: Column) -> Column:
    """The first column that isn't blank, trimmed; "" if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def join_filled(sep: str, *columns: Column) -> Column:
    """The columns that aren't blank, trimmed, with ``sep`` between."""
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def name_key(c: Column) -> Column:
    """A file or video name without extension, workflow words in brackets, punctuation and version words."""
    t = F.regexp_replace(text(c), r"\.[A-Za-z0-9]+$", "")
    for cut in (NAME_BRACKETS, NAME_MARKS, NAME_WORDS):
        t = F.regexp_replace(t, cut, "")
    return compact(t)


def block_number(c: Column, most: int = 40) -> Column:
    """The question number a block begins with (or names after a multi-select mark), 1 to ``most``; else null."""
    t = text(c)
    n = F.coalesce(
        F.nullif(F.regexp_extract(t, r"^([0-9]{1,2})[．.、]", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"^[（(]多选[）)]\s*([0-9]{1,2})[．.、]", 1), F.lit("")),
    ).cast("int")
    return F.when(n.between(1, most), n)


def column_number(letters: Column) -> Column:
    """A spreadsheet column's number from its letters (A = 1, AA = 27); null unless all are letters."""
    up = F.upper(letters)
    n = F.aggregate(F.split(up, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(up.rlike("^[A-Z]+$"), n)


def column_letters(number: Column) -> Column:
    """The letters of a spreadsheet column up to 18278 (ZZZ); null beyond and below 1."""
    letter = lambda n: F.char(65 + F.pmod(n - 1, F.lit(26)))
    second = F.floor((number - 1) / 26)
    third = F.floor((second - 1) / 26)
    return (
        F.when((number < 1) | (number > 18278), None)
        .when(number <= 26, letter(number))
        .when(number <= 702, F.concat(letter(second), letter(number)))
        .otherwise(F.concat(letter(third), letter(second), letter(number)))
    )


def escape(c: Column) -> Column:
    """Text for mark-up: ``&``, ``<``, ``>`` and ``"`` escaped."""
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def count_of(c: Column, part: str) -> Column:
    """How often ``part`` occurs in the text, without overlaps."""
    t = text(c)
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("int")


def csv_cell(c: Column) -> Column:
    """Text for a comma-separated line: quoted if it has a comma, quote or line break; null is empty."""
    t = text(c)
    return F.when(t.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
