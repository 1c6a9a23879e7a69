"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written as plain SQL over the pre-registered test views from the rules the
operators state, by other means where there are any (joins to value lists,
grouping in place of DISTINCT and of ranked rows). Named CTEs declare their
dependencies; ``sql(body, *needs)`` emits the closure.
"""

from __future__ import annotations

from tallyframe.functions.categories import EXPENSE_CATEGORY, EXPENSE_CATEGORY_OTHER
from tallyframe.operators.clean import RAW_TO_DETAIL
from tallyframe.plans.ledger import DENIED_DEPARTMENTS

_AMT = """CASE WHEN x % 97 = 0 THEN 'N/A'
         WHEN x % 89 = 0 THEN ''
         WHEN x % 83 = 0 THEN '-5'
         WHEN x % 73 = 0 THEN CAST(x AS VARCHAR) || '.50'
         WHEN x % 7 = 0 AND x >= 1000 THEN CAST(CAST((x - x % 1000) / 1000 AS BIGINT) AS VARCHAR) || ','
              || lpad(CAST(x % 1000 AS VARCHAR), 3, '0')
         ELSE CAST(x AS VARCHAR) END"""

_BASE = """SELECT l.*, o.o_orderstatus, o.o_orderpriority, p.p_name, p.p_brand, p.p_type, p.p_size,
         s.s_suppkey, s.s_name, n.n_nationkey, n.n_name, n.n_regionkey,
         CAST(FLOOR(l.l_extendedprice) AS BIGINT) AS x,
         lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS dcode
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey"""

_RAW0 = f"""SELECT
    CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS SORDER,
    dcode AS DEPARTMENT,
    CASE WHEN l_orderkey % 79 = 0 THEN 'New General Appropriations'
         WHEN l_linenumber % 5 = 0 THEN '  ' || lower(n_name || ' (N' || dcode || ')') || ' '
         ELSE n_name || ' (N' || dcode || ')' END AS UACS_DPT_DSC,
    CAST(s_suppkey AS VARCHAR) AS AGENCY,
    CASE WHEN l_orderkey % 71 = 0 THEN NULL ELSE s_name END AS UACS_AGY_DSC,
    CAST(l_partkey AS VARCHAR) AS PREXC_FPAP_ID,
    CAST(p_size AS VARCHAR) AS PREXC_LEVEL,
    p_name AS DSC,
    o_orderstatus AS OPERUNIT,
    'Unit ' || o_orderstatus AS UACS_OPER_DSC,
    lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS UACS_REG_ID,
    CAST(l_linenumber AS VARCHAR) AS UACS_OPERDIV_ID,
    'Division ' || CAST(l_linenumber AS VARCHAR) AS UACS_DIV_DSC,
    substr(o_orderpriority, 1, 1) AS FUNDCD,
    o_orderpriority AS UACS_FUNDSUBCAT_DSC,
    l_returnflag || l_linestatus AS UACS_EXP_CD,
    CASE WHEN l_returnflag = 'R' THEN 'Personnel Services'
         WHEN l_returnflag = 'A' THEN 'Maintenance and Other Operating Expenses'
         WHEN l_linestatus = 'F' THEN 'Capital Outlays'
         ELSE 'Financial Expenses' END AS UACS_EXP_DSC,
    p_brand AS UACS_OBJ_CD,
    p_type AS UACS_OBJ_DSC,
    {_AMT} AS AMT
  FROM base"""

# Amount in thousands: text read as a decimal, half away from zero; what is no number has none. A single
# underscore between digits is a separator.
_KILO = "TRY_CAST(ROUND(TRY_CAST(regexp_replace({c}, '([0-9])_([0-9])', '\\1\\2', 'g') AS DECIMAL(38,10))) AS BIGINT)"

_TYPES = {"sort_order": "BIGINT", "program_level": "INTEGER"}


def _column(source: str, target: str) -> str:
    if target == "amount_thousands":
        return f"kilo AS {target}"
    if target in _TYPES:
        return f"{source}::{_TYPES[target]} AS {target}"
    return f"trim({source}) AS {target}"


# Admission: a positive amount and a department that is neither blank nor on the deny list.
_PARSED = f"SELECT *, {_KILO.format(c='AMT')} AS kilo, trim(UACS_DPT_DSC) AS dept FROM raw"
_ADMITTED = f"""SELECT p.* FROM parsed p ANTI JOIN (VALUES {", ".join(f"('{d}')" for d in DENIED_DEPARTMENTS)}) x(denied)
    ON p.dept = x.denied
  WHERE kilo >= 1 AND length(dept) >= 1"""
_DETAIL0 = "SELECT " + ", ".join(_column(*pair) for pair in RAW_TO_DETAIL) + " FROM admitted GROUP BY ALL"

# The text between the first opening and the next closing bracket, else the whole name.
_BRACKETED = "'^[^(]*\\(([^)]*)\\)'"
SHORT_SQL = f"CASE WHEN regexp_matches({{c}}, {_BRACKETED}) THEN regexp_extract({{c}}, {_BRACKETED}, 1) ELSE {{c}} END"

_CLASSES = ", ".join(f"('{c}', '{code}')" for c, code in EXPENSE_CATEGORY.items())
_DETAIL = f"""SELECT d.*, 1000 * d.amount_thousands AS amount_php,
    coalesce(m.code, '{EXPENSE_CATEGORY_OTHER}') AS expense_category,
    {SHORT_SQL.format(c='d.department_name')} AS department_short
  FROM detail0 d LEFT JOIN (VALUES {_CLASSES}) m(class, code) ON m.class = d.expense_class"""

M = "CAST(SUM({e}) AS DECIMAL(38,0))"


def _rollup(keys: str, split: bool = False, **distinct: str) -> str:
    """Totals of the detail by ``keys``; ``split`` adds one total for each expense class, and
    ``distinct`` numbers of different values, counted in a subquery of key and value pairs."""
    out = [keys, "COUNT(*) AS line_items", f"{M.format(e='amount_php')} AS total_php"]
    if split:
        out += [f"coalesce(SUM(amount_php) FILTER (expense_category = '{code}'), 0)::DECIMAL(38,0) AS {code.lower()}_php"
                for code in EXPENSE_CATEGORY.values()]
    out += [f"len(list_distinct(list({column}) FILTER ({column} IS NOT NULL))) AS {name}" for name, column in distinct.items()]
    return f"SELECT {', '.join(out)} FROM detail GROUP BY {keys}"


_DEPARTMENT = "department_code, department_name, department_short"
_AGG_DEPT = _rollup(_DEPARTMENT, True, agency_count="agency_code")
_AGG_EXP = _rollup("expense_category, expense_class")
_AGG_AGY = _rollup(f"{_DEPARTMENT}, agency_code, agency_name, expense_category")
_AGG_REG = _rollup("region_id", True, department_count="department_short", agency_count="agency_name")

_WBASE = """SELECT b.*, r.r_name FROM base b JOIN region r ON b.n_regionkey = r.r_regionkey"""

_WRAW0 = f"""SELECT
    CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id,
    CASE WHEN l_linenumber % 5 = 0 THEN '  ' || lower(n_name) || ' '
         WHEN l_linenumber % 3 = 0 THEN lower(n_name)
         ELSE n_name END AS department,
    CASE WHEN l_orderkey % 71 = 0 THEN NULL
         WHEN l_orderkey % 67 = 0 THEN ''
         WHEN l_linenumber % 4 = 0 THEN s_name || ' '
         ELSE s_name END AS agency,
    {_AMT} AS amount,
    CASE WHEN l_returnflag = 'R' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'personnel services' ELSE 'Personnel Services' END)
         WHEN l_returnflag = 'A' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'mooe' ELSE 'MOOE' END)
         WHEN l_linestatus = 'F' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'CAPITAL OUTLAYS' ELSE 'Capital Outlays' END)
         WHEN l_orderkey % 13 = 0 THEN NULL
         WHEN l_linenumber % 3 = 0 THEN 'Financial Expenses '
         ELSE 'Financial Expenses' END AS category,
    CASE WHEN l_orderkey % 61 = 0 THEN ''
         WHEN l_linenumber % 2 = 0 THEN lower(r_name)
         ELSE r_name END AS region
  FROM wbase"""

# Workshop cleaning: blanks are missing, missing text has a stand-in, categories follow their beginnings.
_TRIMMED = "SELECT " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in
                                 ("id", "department", "agency", "amount", "category", "region")) + " FROM wraw"
_WSTAGED = """SELECT t.id::BIGINT AS id, coalesce(upper(t.department), '') AS department,
    ifnull(t.agency, 'Unspecified Agency') AS agency,
    ifnull(TRY_CAST(replace(t.amount, ',', '') AS DOUBLE), 0)::DECIMAL(18,2) AS amount,
    coalesce(m.standard, t.category, 'Uncategorized') AS category,
    ifnull(upper(t.region), 'UNASSIGNED') AS region
  FROM wtrimmed t LEFT JOIN (VALUES ('PERSONNEL%', 'Personnel Services'), ('MOOE', 'MOOE'), ('CAPITAL%', 'Capital Outlays'))
    m(beginning, standard) ON upper(t.category) LIKE m.beginning"""

# One row for each business key: the smallest id, and of its rows the smallest region.
_WCLEAN = """SELECT min(id) AS id, department, agency, amount, category, arg_min(region, (id, region)) AS region
  FROM wstaged GROUP BY department, agency, amount, category"""

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "base": (_BASE, ()),
    "raw0": (_RAW0, ("base",)),
    "raw": ("SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE SORDER LIKE '%01'", ("raw0",)),
    "parsed": (_PARSED, ("raw",)),
    "admitted": (_ADMITTED, ("parsed",)),
    "detail0": (_DETAIL0, ("admitted",)),
    "detail": (_DETAIL, ("detail0",)),
    "agg_department": (_AGG_DEPT, ("detail",)),
    "agg_expense": (_AGG_EXP, ("detail",)),
    "agg_agency": (_AGG_AGY, ("detail",)),
    "agg_region": (_AGG_REG, ("detail",)),
    "wbase": (_WBASE, ("base",)),
    "wraw0": (_WRAW0, ("wbase",)),
    "wraw": ("SELECT * FROM wraw0 UNION ALL SELECT * FROM wraw0 WHERE id LIKE '%01'", ("wraw0",)),
    "wtrimmed": (_TRIMMED, ("wraw",)),
    "wstaged": (_WSTAGED, ("wtrimmed",)),
    "wclean": (_WCLEAN, ("wstaged",)),
}


def define(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, tuple(deps))


def sql(body: str, *needs: str) -> str:
    """``WITH <closure of needs> <body>``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n  {CTES[n][0]}\n)" for n in order) + "\n" + body


# Report rounding, same rule as tallyframe.functions.money.dround.
def dround(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def pct(part: str, total: str, digits: int = 1) -> str:
    return dround(f"CAST({part} AS DOUBLE) * 100.0 / NULLIF(CAST({total} AS DOUBLE), 0.0)", digits)


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DECIMAL(38,{digits})))"


def thousands(expr: str) -> str:
    v = f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), 3) AS DECIMAL(38,3))"
    places = f"rtrim(printf('%03d', CAST((abs({v}) - floor(abs({v}))) * 1000 AS BIGINT)), '0')"
    return (f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || format('{{:,}}', CAST(floor(abs({v})) AS HUGEINT))"
            f" || CASE WHEN {places} = '' THEN '' ELSE '.' || {places} END)")


def abbrev(expr: str, decimals=(2, 2, 1, 0)) -> str:
    """SQL twin of tallyframe.functions.format.abbrev."""
    v = f"CAST({expr} AS DOUBLE)"
    units = (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "K"))
    arms = [f"WHEN {v} >= {s} THEN '₱' || {fixed(f'{v} / {s}', d)} || '{u}'"
            for (s, u), d in zip(units, decimals) if d is not None]
    return f"(CASE {' '.join(arms)} ELSE '₱' || {thousands(v)} END)"
