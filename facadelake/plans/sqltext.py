"""SQL text of the shared fixed tables, for the equivalent queries."""

from __future__ import annotations

from facadelake.functions import rules


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value)


def case_map(expr: str, table: dict, default=None) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"(CASE {expr} {arms} ELSE {quote(default)} END)"


def case_bands(expr: str, table: list[tuple], pick: int, op: str = "<=") -> str:
    arms = " ".join(f"WHEN {expr} {op} {quote(row[0])} THEN {quote(row[pick])}" for row in table if row[0] is not None)
    return f"(CASE {arms} ELSE {quote(table[-1][pick])} END)"


def values_table(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({names})"


SEVERITY4 = "(CASE WHEN width_mm < 0.2 THEN 'hairline' WHEN width_mm < 1 THEN 'fine' WHEN width_mm < 5 THEN 'medium' ELSE 'wide' END)"
SEVERITY5 = "(CASE WHEN width_mm < 0.1 THEN 'hairline' WHEN width_mm < 0.3 THEN 'minor' WHEN width_mm < 1 THEN 'moderate' WHEN width_mm < 2 THEN 'severe' ELSE 'critical' END)"

DEFECT_VI = f"""(
  {case_map('type', rules.DEFECT_WEIGHTS, 0.5)}
  * {case_map(SEVERITY4, rules.SEVERITY_MULTIPLIERS, 0.5)}
  * area_cm2
  * (CASE WHEN type LIKE '%shear%' THEN 2.5::DOUBLE WHEN type LIKE '%corrosion%' THEN 2.0::DOUBLE
          WHEN type LIKE '%compression%' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN member_type LIKE '%column%' THEN 3.0::DOUBLE WHEN member_type LIKE '%beam%' THEN 2.0::DOUBLE
          WHEN coalesce(member_type, 'slab') LIKE '%slab%' THEN 1.0::DOUBLE WHEN member_type LIKE '%wall%' THEN 0.5::DOUBLE
          ELSE 1.0::DOUBLE END)
  * (CASE WHEN exposure_condition IN ('extreme', 'coastal', 'severe') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)
  * {case_map('member_type', rules.MEMBER_WEIGHTS, 1.0)}
  * {case_map('crack_subtype', rules.SUBTYPE_WEIGHTS, 1.0)})"""
