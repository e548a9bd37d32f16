"""Relations that many queries start from: one row per record, as its first delivery has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.rules import Case, Rule
from sievemark.functions.text import compact_key
from sievemark.operators.records import first_delivery
from sievemark.session import table


def questions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "exam_record"), "question_id", "imported_at", *columns)


def videos(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "video_record"), "video_id", "imported_at", *columns)


def transcripts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "transcript_record"), "transcript_id", "imported_at", *columns)


def matches(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each match once: its deliveries are alike but for the time they came."""
    return first_delivery(table(spark, d, "match_audit"), "match_id", "ingested_at", *columns)


#: The same relations in SQL.
Q = "q AS (SELECT DISTINCT ON (question_id) * FROM exam_record WHERE question_id IS NOT NULL ORDER BY question_id, imported_at)"
V = "v AS (SELECT DISTINCT ON (video_id) * FROM video_record WHERE video_id IS NOT NULL ORDER BY video_id, imported_at)"
T = "t AS (SELECT DISTINCT ON (transcript_id) * FROM transcript_record WHERE transcript_id IS NOT NULL ORDER BY transcript_id, imported_at)"
M = "m AS (SELECT DISTINCT ON (match_id) * FROM match_audit WHERE match_id IS NOT NULL ORDER BY match_id, ingested_at)"


# --- text functions and rules in SQL -------------------------------------------------------------


def sql_normalize(x: str) -> str:
    return rf"translate(trim(regexp_replace(coalesce({x}, ''), '[\s\x{{3000}}]+', ' ', 'g')), '（）：', '():')"


def sql_compact(x: str) -> str:
    return f"replace({sql_normalize(x)}, ' ', '')"


def sql_clean(x: str) -> str:
    a = rf"regexp_replace({sql_normalize(x)}, '\s+[一二三四五六七八九十]+、(?:计算题|实验与探究题|非选择题|选择题).*$', '')"
    return rf"trim(regexp_replace({a}, '\s+[0-9]{{4}}年.+?参考答案与试题解析.*$', ''))"


def sql_split(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(coalesce({x}, ''), '[、；;，,/ ]+')), lambda z: z <> '')"


def sql_quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_has_any(raw: str, packed: str, keys: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({raw}, {sql_quote(k)})" if "\\" in k or ".*" in k else f"contains({packed}, {sql_quote(compact_key(k))})" for k in keys) + ")"


def sql_fires(rule: Rule, raw: str, packed: str) -> str:
    if rule.fold:
        tests = ["(" + " OR ".join(f"contains(lower({raw}), {sql_quote(k.lower())})" for k in rule.keys) + ")"]
    else:
        tests = [sql_has_any(raw, packed, rule.keys)] if rule.keys else []
    tests += [sql_has_any(raw, packed, g) for g in rule.all_of]
    tests += [f"NOT {sql_has_any(raw, packed, rule.none_of)}"] if rule.none_of else []
    return " AND ".join(tests)


def sql_case(case: Case, raw: str, packed: str) -> str:
    """Whether a row of a cascade holds."""
    tests = [sql_has_any(raw, packed, case.any_of)]
    tests += [sql_has_any(raw, packed, case.also)] if case.also else []
    tests += [f"NOT {sql_has_any(raw, packed, case.none_of)}"] if case.none_of else []
    tests += [f"length({raw}) > {case.longer}"] if case.longer is not None else []
    some = [f"contains({raw}, {sql_quote(n)})" for n in case.named] + ([f"length({raw}) < {case.shorter}"] if case.shorter is not None else [])
    tests += ["(" + " OR ".join(some) + ")"] if some else []
    return " AND ".join(tests)


def sql_first_case(cases: list[Case], raw: str, packed: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_case(c, raw, packed)} THEN {sql_quote(c.result)}" for c in cases) + f" ELSE {default} END"


def sql_tags(rules: list[Rule], raw: str, packed: str) -> str:
    """A list of the names of the rules that fire, in rule order."""
    cases = ", ".join(f"CASE WHEN {sql_fires(r, raw, packed)} THEN {sql_quote(r.name)} END" for r in rules)
    return f"list_filter([{cases}], lambda z: z IS NOT NULL)"


def sql_cell(names: str) -> str:
    """A list of distinct names, in the order of their first places, as a cell."""
    return f"array_to_string(list_filter({names}, lambda z, i: list_position({names}, z) = i), '、')"


__all__ = ["F", "M", "Q", "T", "V", "matches", "questions", "transcripts", "videos"]
