"""Rates for records that state none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base rate by category, multiplier by level.
BASE = {
    "HR": 45, "INFORMATION-TECHNOLOGY": 70, "BUSINESS-DEVELOPMENT": 55, "ADVOCATE": 60, "CHEF": 30, "ENGINEERING": 65, "ACCOUNTANT": 50, "FITNESS": 30, "FINANCE": 60, "SALES": 45, "AVIATION": 55, "HEALTHCARE": 50,
    "CONSULTANT": 75, "BANKING": 55, "CONSTRUCTION": 45, "PUBLIC-RELATIONS": 50, "DESIGNER": 50, "ARTS": 35, "TEACHER": 35, "APPAREL": 40, "DIGITAL-MEDIA": 50, "AGRICULTURE": 35, "AUTOMOBILE": 40, "BPO": 25,
    "Java Developer": 65, "Database": 60, "Data Science": 75, "Advocate": 60, "Automation Testing": 55, "DevOps Engineer": 70, "Hadoop": 65, "DotNet Developer": 60, "Testing": 45, "Arts": 35, "Health and fitness": 30,
    "Civil Engineer": 50, "Business Analyst": 60, "SAP Developer": 70, "Python Developer": 65, "Mechanical Engineer": 50, "Sales": 45, "Electrical Engineering": 50, "Network Security Engineer": 70, "ETL Developer": 65,
    "Blockchain": 80, "Web Designing": 50, "Operations Manager": 55, "PMO": 60,
}
OTHER_BASE = 50
MULTIPLIER = {"intern": 0.5, "junior": 0.7, "mid": 1.0, "senior": 1.3, "lead": 1.5, "principal": 1.6, "manager": 1.4, "director": 1.7, "executive": 2.0}
LOWEST, HIGHEST = 15, 250


def _lookup(values: dict, key: Column, otherwise: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(otherwise))


def synthetic(category: Column, name: Column, level: Column) -> Column:
    """Base of the category times the multiplier of the level times a draw from 0.8 to 1.2 that the name fixes."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("rate:"), name), 256), 1, 8), 16, 10).cast("bigint") / F.lit(float(0xFFFFFFFF))
    raw = _lookup(BASE, category, OTHER_BASE) * _lookup(MULTIPLIER, level, 1.0) * (F.lit(0.8) + F.lit(0.4) * draw)
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.bround(raw, 0))).cast("bigint")


def base_sql(category: str) -> str:
    return f"case {category} " + " ".join(f"when '{k}' then {v}" for k, v in BASE.items()) + f" else {OTHER_BASE} end"


def multiplier_sql(level: str) -> str:
    return f"(case {level} " + " ".join(f"when '{k}' then {v}" for k, v in MULTIPLIER.items()) + " else 1.0 end)::double"
