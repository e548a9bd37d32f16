"""Text that looks the same but is spelled with different characters.

A text is read as words of alphabetic scripts, each with the marks and invisible characters that cling to it, and
single other characters.

1. The spellings of all words are counted over all texts.
2. Words that may be read alike come together by their skeleton, in which every look-alike stands for one letter.
   Each skeleton has a trie of the plain spellings, and a weighted edit automaton walks it for each spelling:
   look-alikes and ignorable characters cost nothing, letters that look alike in some fonts only (weak
   look-alikes) a part of an edit. The canonical spelling is chosen among the words within the budget by frequency:
   a weak look-alike is taken for a letter only where that makes the word many times as frequent.
3. Where the chosen spelling is not the one of the table of look-alikes, it is joined to the texts that have the word.
   All other words, and characters outside words, are normalized by the table.

There is no bound on the vocabulary: skeletons are spread over the executors and nothing is collected or broadcast.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.session import durable

#: Letters of other scripts that look like Latin ones (look-alike letters, then the Latin letters).
_PAIRS = [
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮӀ", "ABESIJKMHOPCTYXGQWYI"),  # Cyrillic capitals
    ("асԁеһіјӏոорԛѕѵԝхуү", "acdehijlnopqsvwxyy"),  # Cyrillic (and one Armenian) small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),  # Greek capitals
    ("αοϲϳνρ", "aocjvp"),  # Greek small letters
    ("ıɑɡ", "iag"),  # other Latin letters
]
#: Letters that look like Latin ones in some fonts only (weak look-alikes, then the Latin letters).
_WEAK_PAIRS = [("кгшпи", "krwnu"), ("κτυωιχγησε", "ktuwixynoe"), ("օսհցզ", "ouhgq"), ("ſƒʋ", "ffv")]
#: What reading a weak look-alike as its letter costs, in edits, and the most a word may cost.
WEAK_COST, BUDGET = 0.3, 0.9
#: How many times as frequent a word has to be for each weak look-alike it is reached by; and how often it has to occur at all.
WEAK_TIMES, WEAK_LEAST = 10, 5
#: Other characters that look alike (by code point, as some can't be told apart in print).
_MARKS = {
    "\u00b5": "\u03bc", "\u2236": ":", "\u2027": "\u00b7", "\u30fb": "\u00b7", "\uff65": "\u00b7", "\u2022": "\u00b7", "\u0387": "\u00b7",
    "\u2010": "-", "\u2011": "-", "\u2212": "-", "\u02d7": "-", "\u223c": "~", "\u301c": "~", "\u2044": "/", "\u2215": "/",
}
#: Radicals without a decomposition that look like an ideograph (radicals, then ideographs).
_RADICALS = ("\u2e9f\u2ea0\u2ec1\u2ec4\u2ec5\u2ec6\u2ec9\u2ecb\u2ed3\u2ed4\u2ed8\u2ed9\u2eda\u2edb\u2edc\u2edd\u2ee2\u2ee3\u2ee4\u2ee5\u2ee6\u2ee8\u2ee9\u2eec\u2eee\u2ef0\u2ef3", "母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙龟")
#: Compatibility forms whose plain form looks the same; raised, lowered, circled and fraction forms do not.
_SAME = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<square>", "<vertical>", "<small>")
#: Characters that are invisible although they are not format or control characters.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

_LETTERS = {a: b for look, plain in [*_PAIRS, _RADICALS] for a, b in zip(look, plain, strict=True)}

_WEAK = {a: b for look, letter in _WEAK_PAIRS for a, b in zip(look, letter, strict=True)}


def is_ignorable(ch: str) -> bool:
    """True for characters a reader cannot see: format and control characters but line breaks, variation selectors, fillers."""
    return ord(ch) in _INVISIBLE or (unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\v\f\r\x85")


@lru_cache(maxsize=1 << 16)
def plain(ch: str) -> str:
    """The plain spelling of one character by the table: decomposed, invisible ones empty, spaces one kind."""
    if is_ignorable(ch):
        return ""
    if ch in "\v\f\r\x85  ":
        return "\n"
    if ch == "\t" or unicodedata.category(ch) == "Zs":
        return " "
    if ch in _LETTERS or ch in _MARKS:
        return _LETTERS.get(ch) or _MARKS[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch
    if parts[0][0] == "<":
        tag = parts.pop(0)
        if tag not in _SAME:
            return ch
    out = "".join(plain(chr(int(p, 16))) for p in parts)
    return ch if out[:1] == " " or (not out) else out


def table_form(token: str) -> str:
    """A token normalized by the table alone, with its marks in canonical order (decomposed)."""
    return unicodedata.normalize("NFD", "".join(map(plain, token)))


@lru_cache(maxsize=1)
def special_characters() -> str:
    """A character class of all characters that are not their own plain form, and of combining marks."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        odd = cp <= sys.maxunicode and not 0xD800 <= cp < 0xE000 and (plain(chr(cp)) != chr(cp) or unicodedata.combining(chr(cp)) > 0) and not 0xAC00 <= cp < 0xD7A4
        if odd and start is None:
            start = cp
        elif not odd and start is not None:
            out.append((start, cp - 1))
            start = None
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


class Trie:
    """A trie of plain (decomposed) spellings with their counts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int = 1) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = (word, count)

    def reach(self, token: str, budget: float = 0.0, edit: float = 1.0, weak: float = WEAK_COST) -> list[tuple[float, int, str]]:
        """``(cost, count, word)`` of every word at a cost of ``budget`` or less.

        The automaton's states are nodes with the least cost to reach each. Reading a character along the
        edge (or edges) of its plain form costs 0, reading an ignorable character costs 0 and stays where it
        is, reading a weak look-alike as its letter (or a letter as its weak look-alike) costs ``weak``; any other
        substitution, insertion or deletion costs ``edit``.
        """
        states = self._insertions({id(self.root): (self.root, 0.0)}, budget, edit)
        for ch in unicodedata.normalize("NFD", token):
            look = plain(ch)
            if not look:
                continue
            new: dict[int, tuple[dict, float]] = {}

            def arrive(node: dict, cost: float, new: dict = new) -> None:
                if cost <= budget + 1e-9 and (id(node) not in new or new[id(node)][1] > cost):
                    new[id(node)] = (node, cost)

            for node, cost in states.values():
                for way in {ch, look}:
                    at: dict | None = node
                    for c in way:
                        at = at.get(c)
                        if at is None:
                            break
                    else:
                        arrive(at, cost)
                if cost + min(edit, weak) <= budget + 1e-9:
                    letter = _WEAK.get(look, look)
                    for c, child in node.items():
                        if c and c not in (ch, look):
                            arrive(child, cost + (weak if _WEAK.get(c, c) == letter else edit))
                    arrive(node, cost + edit)
            if not new:
                return []
            states = self._insertions(new, budget, edit)
        return [(cost, node[""][1], node[""][0]) for node, cost in states.values() if "" in node]

    def match(self, token: str, budget: float = 0.0, edit: float = 1.0) -> str | None:
        """The cheapest word at a cost of ``budget`` or less; of equal ones the most frequent, then the least."""
        ends = [(cost, -count, word) for cost, count, word in self.reach(token, budget, edit)]
        return min(ends)[2] if ends else None

    @staticmethod
    def _insertions(states: dict, budget: float, edit: float) -> dict:
        todo = [s for s in states.values() if s[1] + edit <= budget]
        while todo:
            node, cost = todo.pop()
            for c, child in node.items():
                if c and (id(child) not in states or states[id(child)][1] > cost + edit):
                    states[id(child)] = (child, cost + edit)
                    if cost + 2 * edit <= budget:
                        todo.append(states[id(child)])
        return states


#: Letters and digits of alphabetic scripts, marks, and the common invisible characters: what a word is made of.
_IN_WORD = r"A-Za-z0-9\u00aa-\u02af\u0300-\u052f\u0531-\u0587\u1e00-\u1fff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff"
_WORDS = re.compile(rf"[{_IN_WORD}]+|.", re.S)


_RUN = re.compile(rf"[{_IN_WORD}]+")


def skeleton(token: str) -> str:
    """The table's form of a token with every weak look-alike as its letter: words that may be read alike have one skeleton."""
    return "".join(_WEAK.get(c, c) for c in table_form(token))


def choose(spellings: Iterable[tuple[str, int]]) -> dict[str, str]:
    """The canonical spelling (decomposed) of each of the spellings (with counts) of one skeleton.

    Spellings that differ in look-alikes and ignorables alone are one word, and its plain form is in the trie. The automaton
    reaches for each spelling the words within the budget; the best is the most frequent one after its count is
    divided by ``WEAK_TIMES`` for each weak look-alike, if it occurs ``WEAK_LEAST`` times. Words of one letter stay.
    Spellings are led on until their word is its own best; counts rise on the way, so this ends.
    """
    spellings = list(spellings)
    words: Counter[str] = Counter()
    for token, n in spellings:
        words[table_form(token)] += n
    trie = Trie()
    for word, n in words.items():
        trie.add(word, n)

    def best(token: str) -> str:
        own = table_form(token)
        found = {word: (math.log(n) - cost / WEAK_COST * math.log(WEAK_TIMES), n) for cost, n, word in trie.reach(token, BUDGET if len(own) > 1 else 0.0)}
        able = [(worth, word) for word, (worth, n) in found.items() if word != own and n >= WEAK_LEAST and worth >= math.log(words[own])]
        return min(able, key=lambda x: (-x[0], x[1]))[1] if able else own

    led = {word: best(word) for word in words}
    out = {}
    for token, _ in spellings:
        word = best(token)
        while led[word] != word:
            word = led[word]
        out[token] = word
    return out


class Canonizer:
    """Brings texts to their canonical form by the table, after words with another chosen spelling have got that.

    ``odd`` is the character class of ``special_characters``; a text without such characters is canonical by the table.
    """

    def __init__(self, odd: str) -> None:
        # a stretch of word characters with an odd one in it, or odd characters between words
        self._stretch = re.compile(rf"[A-Za-z0-9]*(?:[{odd}][A-Za-z0-9]*)+")
        self._form = lru_cache(maxsize=1 << 16)(table_form)

    def text(self, text: str | None, chosen: dict[str, str] | None = None) -> str | None:
        """The canonical form of a text; null stays null. ``chosen`` has the words with another spelling than the table's."""
        if text is None:
            return None
        if chosen:
            text = _RUN.sub(lambda m: chosen.get(m.group(), m.group()), text)
        out = self._stretch.sub(lambda m: "".join(map(self._form, _WORDS.findall(m.group()))), text)
        return unicodedata.normalize("NFC", out)


def word_spellings(rows: DataFrame, column: str) -> DataFrame:
    """``(token, n)``: how often each spelling of a word with a letter occurs in the texts of ``column``."""
    words = F.filter(F.regexp_extract_all(F.col(column), F.lit(f"[{_IN_WORD}]+"), F.lit(0)), lambda w: w.rlike("[^0-9]"))
    return rows.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def chosen_spellings(spellings: DataFrame) -> DataFrame:
    """``(token, chosen)``: the words of ``spellings`` whose canonical spelling is not the table's.

    Spellings are shuffled by skeleton; a task walks the tries of its skeletons one after the other.
    """

    @F.pandas_udf(T.StringType())
    def bones(tokens: pd.Series) -> pd.Series:
        return tokens.map(skeleton)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def decided(rows: list[tuple[str, int]]) -> list[tuple[str, str]]:
            return [(t, w) for t, w in choose(rows).items() if w != table_form(t)] if rows else []

        of, rows = None, []
        for b in batches:
            got: list[tuple[str, str]] = []
            for key, token, n in zip(b["bones"], b["token"], b["n"], strict=True):
                if key != of:
                    got += decided(rows)
                    of, rows = key, []
                rows.append((token, int(n)))
            yield pd.DataFrame(got, columns=["token", "chosen"])
        yield pd.DataFrame(decided(rows), columns=["token", "chosen"])

    whole = spellings.withColumn("bones", bones("token")).repartition("bones").sortWithinPartitions("bones", "token")
    return whole.mapInPandas(walk, "token string, chosen string")


def canonical_texts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` with ``field_name``, ``raw`` and ``canonical``, a row per text that is not null.

    Empty texts stay empty; a text of invisible characters alone becomes empty. Case, digits, raised and
    plain characters, and line breaks stay distinct; every kind of space becomes the plain one.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("raw")) for c in columns]))
    rows = df.select(*keys, pair.alias("p")).select(*keys, "p.field_name", "p.raw").where(F.col("raw").isNotNull())
    rows = durable(rows.withColumns({"h1": F.xxhash64("raw"), "h2": F.xxhash64(F.lit("other"), "raw")}), "texts")
    odd = df.sparkSession.sparkContext.broadcast(special_characters())
    other = durable(chosen_spellings(word_spellings(rows, "raw")), "spellings")

    @F.pandas_udf(T.StringType())
    def by_table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Canonizer(odd.value)
        for texts in batches:
            yield texts.map(tool.text)

    @F.pandas_udf(T.StringType())
    def by_choice(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tool = Canonizer(odd.value)
        for texts, tokens, chosen in batches:
            yield pd.Series([tool.text(x, dict(zip(t, c, strict=True)) if t is not None else None) for x, t, c in zip(texts, tokens, chosen, strict=True)])

    # another choice than the table's takes a weak look-alike and a second letter, on either side of the choice; only texts
    # with a word that has one can have such a word
    may = F.col("raw").rlike(f"[{''.join(_WEAK)}{''.join(sorted(set(_WEAK.values())))}]") & F.lit(not other.isEmpty())
    words = rows.where(may).select("h1", "h2", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(f"[{_IN_WORD}]+"), F.lit(0)))).alias("token")).distinct()
    per = words.join(other, "token").groupBy("h1", "h2").agg(F.collect_list(F.struct("token", "chosen")).alias("c"))
    some = rows.where(may).join(per.select("h1", "h2", F.col("c.token").alias("t"), F.col("c.chosen").alias("w")), ["h1", "h2"], "left")
    out = [*keys, "field_name", "raw"]
    return rows.where(~may).select(*out, by_table("raw").alias("canonical")).unionByName(some.select(*out, by_choice("raw", "t", "w").alias("canonical")))


def same_look_pairs(texts: DataFrame, key: str) -> DataFrame:
    """``(field_name, id_a, id_b)``: records whose texts look the same but are not the same characters.

    Texts are first grouped by their exact spelling; only groups of spellings with one canonical form, and
    more than one spelling, are paired. Records with the very same characters are no pair. Texts are compared
    by 128-bit hashes, which are all that is shuffled and kept; the texts are read once.
    """
    two = lambda c: (F.xxhash64(c), F.xxhash64(F.lit("other"), c))
    look, spelling = two(F.concat_ws("\n", "field_name", "canonical")), two(F.col("raw"))
    t = durable(
        texts.select("field_name", F.col(key).alias("id"), look[0].alias("look"), look[1].alias("look2"), spelling[0].alias("raw"), spelling[1].alias("raw2")), "looks"
    )
    look_keys = ["look", "look2"]
    many = t.groupBy(*look_keys).agg(F.min(F.struct("raw", "raw2")).alias("lo"), F.max(F.struct("raw", "raw2")).alias("hi")).where(F.col("lo") != F.col("hi"))
    odd = t.join(many.select(*look_keys), look_keys, "left_semi")
    a = odd.select(*look_keys, "field_name", F.col("id").alias("id_a"), F.struct("raw", "raw2").alias("ra"))
    b = odd.select(*look_keys, F.col("id").alias("id_b"), F.struct("raw", "raw2").alias("rb"))
    hit = (F.col("ra") != F.col("rb")) & (F.col("id_a") < F.col("id_b"))
    return a.join(b, look_keys).where(hit).select("field_name", "id_a", "id_b").distinct()


def look_classes(texts: DataFrame, key: str) -> DataFrame:
    """``(field_name, id, class_id, n_records, n_spellings)``: one row per record and text with the class of texts that look the
    same (named by its least id), the number of records in the class and of different spellings. Records are never paired,
    so a text that a third of all records has costs nothing more.
    """
    t = texts.select("field_name", F.col(key).alias("id"), F.xxhash64("canonical").alias("l1"), F.xxhash64(F.lit("other"), "canonical").alias("l2"), F.xxhash64("raw").alias("r1"), F.xxhash64(F.lit("other"), "raw").alias("r2"))
    t = durable(t.distinct(), "looks")
    look = ["field_name", "l1", "l2"]
    spelled = t.groupBy(*look, "r1", "r2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = spelled.groupBy(*look).agg(F.min("least").alias("class_id"), F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_spellings"))
    return t.join(classes, look).select("field_name", "id", "class_id", "n_records", "n_spellings").distinct()
