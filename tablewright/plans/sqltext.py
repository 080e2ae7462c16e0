"""Small builders for the SQL twins of violation queries."""

from __future__ import annotations

import sys

# Letters whose upper case is several letters, such as the sharp s.  SQL's own upper() leaves them single.
LONG_UPPER = {c: c.upper() for c in map(chr, range(sys.maxunicode + 1)) if len(c.upper()) > 1}


def sql_text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def violation_sql(
    rule_id: str,
    row: str,
    field: str,
    value: str,
    source: str,
    bad: str,
    expected: str | None = None,
    code: str | None = None,
    message: str | None = None,
    severity: str = "error",
) -> str:
    message = message or f"'{rule_id} (got: ' || coalesce({value}, '') || ')'"
    return f"""SELECT '{rule_id}' AS rule_id, '{rule_id}' AS rule_name, '{severity}' AS severity,
        CAST({row} AS BIGINT) AS row_number, {sql_text(field)} AS field, {value} AS value,
        {message} AS message, {sql_text(expected)} AS expected,
        '{code or 'BR_' + rule_id.upper() + '_FIELD'}' AS issue_code, 'row' AS level
        FROM {source} WHERE {bad}"""


def union_all(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def upper_sql(text: str) -> str:
    """Full upper case as Spark and Python write it, where SQL's upper() maps letter by letter."""
    replaced = text
    for letter, upper in LONG_UPPER.items():
        replaced = f"replace({replaced}, '{letter}', '{upper}')"
    return f"upper(CASE WHEN regexp_matches({text}, '[{''.join(LONG_UPPER)}]') THEN {replaced} ELSE {text} END)"


def rounded_sql(x: str, digits: int) -> str:
    """A double rounded half away from zero by the decimal that it is written as, without a binary product in between.

    What does not fit the decimal is not finite or has no such digits.
    """
    return f"coalesce(CAST(CAST(round(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,24)), {digits}) AS VARCHAR) AS DOUBLE), {x})"
