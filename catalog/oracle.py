"""DuckDB SQL with the same result as each registered query, over whole tables."""

from __future__ import annotations

from itertools import combinations

from catalog.inputs import COLUMNS, DATASET_SQL, INPUT_SQL

LINEITEM = COLUMNS["lineitem"]
NUMERIC = ("bigint", "int", "double")
NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# texts of one count go by this
DIGESTED = "CASE WHEN strlen({c}) > 64 THEN '#' || sha256({c}) ELSE {c} END"
KEYS_AND_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", *NUMBERS]


def _with(inputs: list[str], body: str, **ctes: str) -> str:
    names = list(dict.fromkeys((["lineitem_nulls"] if "lineitem_const" in inputs else []) + inputs))
    parts = [f"{n} AS ({INPUT_SQL[n]})" for n in names] + [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _exact_summary() -> str:
    """Order statistics by row number, interpolated and written out as decimals."""
    columns = {
        "key": "CAST(l_orderkey + 9007199254740992 AS DECIMAL(24, 2))",
        "price": "CAST(CAST(l_extendedprice AS DECIMAL(20, 2)) + 1000000000000000 AS DECIMAL(24, 2))",
        "l_linenumber": "CAST(l_linenumber AS DECIMAL(24, 2))",
    }
    shares = {"min": 0, "p5": 5, "p25": 25, "p50": 50, "p75": 75, "p95": 95, "max": 100}

    def at(q: int) -> str:
        low, high, part = f"(n - 1) * {q} // 100", f"((n - 1) * {q} + 99) // 100", f"(n - 1) * {q} % 100"
        a, b = (f"max(CASE WHEN i = {x} THEN v END)" for x in (low, high))
        return f"{a} + ({b} - {a}) * CAST(max({part}) AS DECIMAL(3, 0)) * CAST(0.01 AS DECIMAL(3, 2))"

    placed = "SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM"
    parts = []
    for c, sql in columns.items():
        values = f"(SELECT {sql} AS v FROM lineitem)"
        found = ", ".join(f"{at(q)} AS \"{name}\"" for name, q in shares.items())
        distances = f"(SELECT abs(v - (SELECT {at(50)} FROM ({placed} {values}))) AS v FROM {values})"
        for name in (*shares, "mad"):
            source = f"(SELECT {at(50)} AS mad FROM ({placed} {distances}))" if name == "mad" else f"(SELECT {found} FROM ({placed} {values}))"
            parts.append(f"SELECT '{c}' AS \"column\", '{name}' AS statistic, "
                         f"regexp_replace(CAST(\"{name}\" AS VARCHAR), '\\.?0+$', '') AS exact FROM {source}")
    return _union(parts)


def _per_column(table: str, columns, select: str, where: str = "") -> str:
    """One SELECT per column; {c} is the column, {p} its place in `columns`, {t} its type."""
    types = {c: t for cols in COLUMNS.values() for c, t in cols.items()}
    return _union(
        [f"SELECT {select.format(c=c, p=p, t=types.get(c, 'double'))} FROM {table} {where}" for p, c in enumerate(columns)]
    )


def _in_schema(table: str, columns, select: str) -> str:
    positions = {c: p for p, c in enumerate(COLUMNS["lineitem"])}
    return _union([f"SELECT {select.format(c=c, p=positions[c])} FROM {table}" for c in columns])


def _frequencies(table: str, columns) -> str:
    return _union(
        [
            f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {table} "
            f"WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in columns
        ]
    )


RANKED = "SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rk FROM f"


def _corr(x: str, y: str) -> str:
    """Pearson over complete pairs, NULL when undefined."""
    return f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END"


def _profile_oracles() -> dict[str, str]:
    nulls = ["lineitem_nulls"]
    out = {}
    out["schema_profile"] = _with(nulls, _per_column(
        "lineitem_nulls", LINEITEM,
        "'{c}' AS \"column\", {p} AS position, '{t}' AS dtype, count(*) AS n_rows, "
        "count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_unique",
    ))
    out["missing_by_column"] = _with(nulls, _per_column(
        "lineitem_nulls", LINEITEM,
        "'{c}' AS \"column\", {p} AS position, count(*) AS n_rows, count(*) - count({c}) AS missing",
    ))
    out["missing_top20"] = _with(
        nulls,
        'SELECT "column", missing, round(missing / greatest(n, 1) * 100.0, 6) AS percent FROM m '
        "ORDER BY missing DESC, position LIMIT 20",
        m=_per_column(
            "lineitem_nulls", LINEITEM,
            "'{c}' AS \"column\", {p} AS position, count(*) AS n, count(*) - count({c}) AS missing",
        ),
    )
    total = " + ".join(f"count(*) - count({c})" for c in LINEITEM)
    out["missing_total"] = _with(nulls, f"SELECT CAST({total} AS BIGINT) AS missing_total FROM lineitem_nulls")
    out["shape"] = f"SELECT count(*) AS rows, CAST({len(LINEITEM)} AS BIGINT) AS cols FROM lineitem"
    out["duplicate_rows"] = _with(
        ["lineitem_dups"],
        "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM "
        "(SELECT count(*) AS n FROM lineitem_dups GROUP BY l_returnflag, l_linestatus, l_linenumber)",
    )
    out["duplicate_rows_text"] = (
        "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM "
        "(SELECT count(*) AS n FROM documents GROUP BY text, lang)"
    )
    distinct = "'{c}' AS \"column\", count(DISTINCT {c}) AS n_unique"
    out["n_unique"] = _per_column("lineitem", LINEITEM, distinct)
    out["n_unique_text"] = _per_column("documents", ["doc_id", "text", "lang", "source", "n_chars"], distinct)
    out["value_frequencies"] = _with(
        ["orders_nulls"], 'SELECT col AS "column", value, cnt FROM f',
        f=_frequencies("orders_nulls", ["o_orderstatus", "o_orderpriority"]),
    )
    out["column_roles"] = _with(nulls, _union([
        f"SELECT '{c}' AS \"column\", {p} AS position, '{t}' AS dtype, {t in NUMERIC} AS \"numeric\", "
        f"{t == 'string'} AS categorical, {t == 'timestamp_ntz'} AS datetime, "
        f"count(DISTINCT {c}) > 20 AND count(DISTINCT {c}) / greatest(count(*), 1) > 0.9 AS id_like "
        "FROM lineitem_nulls"
        for p, (c, t) in enumerate(LINEITEM.items())
    ]))
    parsed = "count(try_strptime({c}, '%Y-%m-%d')) > 0.7 * count({c})"
    out["datetime_roles"] = _with(["orders_strdate"], _union([
        f"SELECT '{c}' AS \"column\", "
        + (parsed.format(c=c) if t == "string" or c == "o_orderdate" else "false")
        + " AS datetime FROM orders_strdate HAVING count(*) >= 0"
        for c, t in COLUMNS["orders"].items()
    ]))
    first = "(SELECT {c} FROM orders_strdate WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 50)"
    out["datetime_roles_probe"] = _with(["orders_strdate"], _union([
        f"SELECT '{c}' AS \"column\", "
        + (parsed.format(c=c) if t == "string" or c == "o_orderdate" else "false")
        + f" AS datetime FROM {first.format(c=c)} HAVING count(*) >= 0"
        for c, t in COLUMNS["orders"].items()
    ]))
    unique = "'{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(*) AS n_rows"
    out["id_like_columns"] = _with(
        [], 'SELECT * FROM u WHERE n_unique > 20 AND n_unique / greatest(n_rows, 1) > 0.9',
        u=_per_column("customer", COLUMNS["customer"], unique),
    )
    out["id_like_categorical"] = _with(
        [], "SELECT * FROM u WHERE n_unique / greatest(n_rows, 1) >= 0.9",
        u=_per_column("region", COLUMNS["region"], unique),
    )
    out["dataset_type"] = _union([
        f"SELECT '{d}' AS dataset, '{_kind(d)}' AS dataset_type FROM {d} HAVING count(*) >= 0" for d in DATASET_SQL
    ])
    top = 'SELECT col AS "column", value, cnt, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= {k}'
    text = _frequencies("orders_nulls", ["o_orderstatus", "o_orderpriority"])
    out["top_categoricals"] = _with(["orders_nulls"], top.format(k=5), f=text, r=RANKED)
    out["categorical_top10"] = _with(
        ["orders_nulls"],
        'SELECT col AS "column", (SELECT count(*) FROM f WHERE f.col = r.col) AS n_unique, value, cnt, '
        "CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10",
        f=text, r=RANKED,
    )
    out["numeric_summary"] = _with(nulls, _per_column(
        "lineitem_nulls", KEYS_AND_NUMBERS,
        "'{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        "round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max",
    ))
    out["sample_rows"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"
    missing = " + ".join(f"count(*) - count({c})" for c in LINEITEM)
    out["snapshot_skip"] = (
        f"SELECT 'snapshot' AS pack, 'No missing values.' AS skipped FROM lineitem HAVING {missing} <= 0"
    )
    return out


def _kind(dataset: str) -> str:
    types = set(COLUMNS[dataset].values())
    return "timeseries" if "timestamp_ntz" in types else "tabular"


def _categorical_oracles() -> dict[str, str]:
    out = {}
    out["categorical_id_insights"] = (
        "SELECT \"column\", 'info' AS severity, 'Column ''' || \"column\" || ''' looks like an identifier' AS title, "
        "'Unique ratio ≈ ' || u || '/' || n AS evidence, "
        "'Exclude from categorical distribution charts and most modeling features.' AS recommendation FROM ("
        + _per_column("customer", ["c_name", "c_mktsegment"],
                      "'{c}' AS \"column\", count(DISTINCT {c}) AS u, count(*) AS n")
        + ") WHERE u / n >= 0.9"
    )
    out["categorical_chart_columns"] = (
        'SELECT "column" FROM ('
        + _per_column("customer", ["c_name", "c_mktsegment"],
                      "'{c}' AS \"column\", {p} AS p, count(DISTINCT {c}) AS u, count(*) AS n")
        + ") WHERE u / n < 0.9"
    )
    out["categorical_distribution"] = _with(
        ["orders_nulls"],
        'SELECT col AS "column", value, cnt, round(cnt / sum(cnt) OVER (PARTITION BY col) * 100.0, 6) AS pct, '
        "round(cnt / (SELECT sum(cnt) FROM f WHERE f.col = r.col) * 100.0, 6) AS pct_of_non_null "
        "FROM r WHERE rk <= 10",
        f=_frequencies("orders_nulls", ["o_orderstatus", "o_orderpriority"]), r=RANKED,
    )
    out["categorical_summary"] = (
        "SELECT CAST(2 AS BIGINT) AS n_cols, 'c_name,c_mktsegment' AS cols_used, "
        "CAST((count(DISTINCT c_name) / count(*) < 0.9)::INT + (count(DISTINCT c_mktsegment) / count(*) < 0.9)::INT "
        "AS BIGINT) AS n_charts FROM customer"
    )
    out["categorical_notes"] = (
        "SELECT 'info' AS severity, 'No categorical charts rendered' AS title, "
        "'All candidate columns look like identifiers or have no values.' AS evidence, "
        "'Check categorical role detection or allow ''top N + Other'' for high-cardinality columns.' "
        "AS recommendation FROM region HAVING count(DISTINCT r_name) / count(*) >= 0.9"
    )
    return out


def _numeric_oracles() -> dict[str, str]:
    nulls = ["lineitem_nulls"]
    out = {}
    out["numeric_usable_columns"] = (
        'SELECT "column", position FROM ('
        + _per_column("lineitem", KEYS_AND_NUMBERS,
                      "'{c}' AS \"column\", {p} AS position, count(DISTINCT {c}) AS u, count(*) AS n")
        + ") WHERE NOT (u > 20 AND u / n > 0.9)"
    )
    out["numeric_basic_stats"] = _with(nulls, _per_column(
        "lineitem_nulls", KEYS_AND_NUMBERS,
        "'{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        "round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max",
    ))
    out["sample_rows_n"] = (
        "SELECT least(500, count(*)) AS n, least(500, count(DISTINCT o_orderkey)) AS n_keys FROM orders"
    )
    out["corr_columns"] = _with(
        nulls,
        'SELECT "column", non_null, CAST(row_number() OVER (ORDER BY non_null DESC, p) AS INTEGER) AS rank FROM m',
        m=_per_column("lineitem_nulls", KEYS_AND_NUMBERS, "'{c}' AS \"column\", {p} AS p, count({c}) AS non_null"),
    )
    out["variance_rank"] = _with(
        nulls,
        'SELECT "column", round(v, 3) AS variance, CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, p) AS INTEGER) '
        "AS rank FROM m",
        m=_per_column("lineitem_nulls", NUMBERS, "'{c}' AS \"column\", {p} AS p, var_samp({c}) AS v"),
    )
    columns = [*NUMBERS, "k"]
    out["correlation_matrix"] = _with(["lineitem_const"], _union([
        f"SELECT '{x}' AS x, '{y}' AS y, round(coalesce({_corr(x, y)}, 0.0), 8) AS corr FROM lineitem_const"
        for x in columns for y in columns
    ]))
    # span 49 of 1..50 allows steps of 2 within 30 bins; 50 belongs to the last of 25
    out["numeric_histogram"] = (
        "SELECT 'l_quantity' AS \"column\", b * 2.0::DOUBLE AS bin_start, (b + 1) * 2.0::DOUBLE AS bin_end, "
        "count(*) AS cnt FROM (SELECT least(floor(l_quantity / 2), 24) AS b FROM lineitem) GROUP BY b"
    )
    return out


def _hypothesis_oracles() -> dict[str, str]:
    nulls = ["lineitem_nulls"]
    out = {}
    out["hyp_missingness"] = _with(nulls, _union([
        f"SELECT {i} AS hyp_id, 'missingness' AS kind, '{c}' AS col, true AS verified, "
        f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM lineitem_nulls"
        for i, c in enumerate(["l_tax", "l_returnflag", "l_quantity"], start=1)
    ]))
    flags = ["l_returnflag", "l_linestatus"]
    share = "cnt / (SELECT sum(cnt) FROM f WHERE f.col = r.col)"
    out["hyp_category_dominance"] = _with(
        nulls,
        "SELECT CASE col WHEN 'l_returnflag' THEN 1 ELSE 2 END AS hyp_id, 'category_dominance' AS kind, col, "
        f"true AS verified, value AS top_value, round({share}, 6) AS top_share FROM r WHERE rk = 1",
        f=_frequencies("lineitem_nulls", flags), r=RANKED,
    )
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    out["hyp_correlation"] = _with(nulls, _union([
        f"SELECT {i} AS hyp_id, 'correlation' AS kind, '{x}' AS x, '{y}' AS y, true AS verified, "
        f"round(corr({x}, {y}), 8) AS pearson_corr, regr_count({x}, {y})::BIGINT AS n FROM lineitem_nulls"
        for i, (x, y) in enumerate(pairs, start=1)
    ]))

    def row(i: int, kind: str, statement: str, col: str = "", x: str = "", y: str = "", verified: str = "false",
            rate: str = "", value: str = "", share_: str = "", corr: str = "", n: str = "", error: str = "",
            source: str = "lineitem_nulls", tail: str = "HAVING count(*) >= 0") -> str:
        def text(v: str) -> str:
            return f"'{v}'" if v else "CAST(NULL AS VARCHAR)"

        def number(v: str, t: str) -> str:
            return v or f"CAST(NULL AS {t})"

        return (
            f"SELECT {i} AS hyp_id, '{kind}' AS kind, '{statement}' AS statement, {text(col)} AS col, {text(x)} AS x, "
            f"{text(y)} AS y, {verified} AS verified, {number(rate, 'DOUBLE')} AS missing_rate, "
            f"{number(value, 'VARCHAR')} AS top_value, {number(share_, 'DOUBLE')} AS top_share, "
            f"{number(corr, 'DOUBLE')} AS pearson_corr, {number(n, 'BIGINT')} AS n, {text(error)} AS verify_error "
            f"FROM {source} {tail}"
        )

    out["verify_hypotheses"] = _with(
        nulls,
        _union([
            row(1, "missingness", "tax is incomplete", col="l_tax", verified="true",
                rate="round(avg(CASE WHEN l_tax IS NULL THEN 1.0 ELSE 0.0 END), 6)"),
            row(2, "missingness", "no such column", col="l_nothing"),
            row(3, "category_dominance", "one flag dominates", col="l_returnflag", verified="true", value="value",
                share_=f"round({share}, 6)", source="r", tail="WHERE rk = 1"),
            row(4, "correlation", "quantity moves price", x="l_quantity", y="l_extendedprice", verified="true",
                corr="round(corr(l_quantity, l_extendedprice), 8)",
                n="regr_count(l_quantity, l_extendedprice)::BIGINT"),
            row(5, "correlation", "flag against tax", x="l_returnflag", y="l_tax",
                error="Column ''l_returnflag'' is not numeric."),
            row(6, "seasonality", "unknown kind", col="l_shipdate"),
        ]),
        f=_frequencies("lineitem_nulls", ["l_returnflag"]), r=RANKED,
    )
    return out


def _time_oracles() -> dict[str, str]:
    gaps = ["events_gaps"]
    daily = "SELECT CAST(ts AS DATE) AS day, avg(value) AS value FROM events_gaps GROUP BY 1 HAVING avg(value) IS NOT NULL"
    whole = "SELECT CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1 HAVING avg(value) IS NOT NULL"
    listed = "SELECT day, round(value, 6) AS value FROM d"
    ends = "SELECT arg_min(value, day) AS f, arg_max(value, day) AS l FROM d HAVING count(*) >= 2"
    out = {}
    out["ts_valid_rows"] = _with(
        ["orders_strdate"],
        "SELECT o_orderkey, CAST(try_strptime(o_orderdate, '%Y-%m-%d') AS DATE) AS day FROM orders_strdate "
        "WHERE try_strptime(o_orderdate, '%Y-%m-%d') IS NOT NULL",
    )
    out["ts_points"] = _with(
        ["orders_strdate"], "SELECT count(try_strptime(o_orderdate, '%Y-%m-%d')) AS n_points FROM orders_strdate"
    )
    out["daily_mean"] = _with(gaps, listed, d=daily)
    out["daily_mean_offsets"] = (
        "SELECT CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INTEGER) AS day, round(avg(o_totalprice), 6) AS o_totalprice "
        "FROM orders GROUP BY 1 HAVING avg(o_totalprice) IS NOT NULL"
    )
    out["daily_mean_by_key"] = _with(
        gaps,
        "SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events_gaps "
        "GROUP BY 1, 2 HAVING avg(value) IS NOT NULL",
    )
    out["daily_head"] = _with(gaps, listed + " ORDER BY day LIMIT 10", d=daily)
    by_key = ("SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events_gaps "
              "GROUP BY 1, 2 HAVING avg(value) IS NOT NULL")
    for side, order in (("head", "day"), ("tail", "day DESC")):
        out[f"daily_{side}_by_key"] = _with(
            gaps, "SELECT event_type, day, round(value, 6) AS value FROM d "
            f"QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {order}) <= 4", d=by_key)
    out["daily_tail"] = _with(gaps, listed + " ORDER BY day DESC LIMIT 10", d=daily)
    out["daily_line"] = (
        "SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 6) AS value FROM orders "
        "GROUP BY 1 HAVING avg(o_totalprice) IS NOT NULL"
    )
    out["rolling_7d"] = _with(
        gaps,
        "SELECT day, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS rolling FROM d "
        "WHERE (SELECT count(*) FROM d) >= 14 "
        "WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
        d=daily,
    )
    out["trend_first_last"] = _with(
        [], "SELECT 'value' AS col, round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS delta FROM e",
        d=whole, e=ends,
    )
    direction = "CASE WHEN l - f > 0 THEN 'increased' WHEN l - f < 0 THEN 'decreased' ELSE 'stayed flat' END"
    out["trend_insight"] = _with(
        [],
        f"SELECT 'value' AS col, {direction} AS direction, 'info' AS severity, "
        f"'''value'' ' || {direction} || ' over the observed period' AS title, "
        "printf('First=%.4g, Last=%.4g, Delta=%.4g', f, l, l - f) AS evidence FROM e",
        d=whole, e=ends,
    )
    return out


# --- catalogue over several datasets ----------------------------------------

PACKS = (
    ("snapshot", "Baseline dataset overview.", None),
    ("categorical", "Categorical distribution overview.", "string"),
    ("timeseries", "Datetime + numeric indicates time trend analysis.", "timestamp_ntz"),
    ("numeric", "Numeric columns detected; show distributions and correlations.", "number"),
)


def _profile_cte() -> str:
    parts = []
    for d, t in DATASET_SQL.items():
        for p, (c, kind) in enumerate(COLUMNS[d].items()):
            variance = f"var_samp({c})" if kind in NUMERIC else "NULL"
            parts.append(
                f"SELECT '{d}' AS dataset, {p} AS p, '{c}' AS c, '{'number' if kind in NUMERIC else kind}' AS kind, "
                f"count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS u, "
                f"CAST({variance} AS DOUBLE) AS variance FROM {t}"
            )
    return (
        "SELECT *, u > 20 AND u / greatest(n, 1) > 0.9 AS id_like, u / greatest(n, 1) >= 0.9 AS id_any FROM ("
        + _union(parts) + ")"
    )


def _days_cte() -> str:
    parts = []
    for d, t in DATASET_SQL.items():
        times = [c for c, kind in COLUMNS[d].items() if kind == "timestamp_ntz"]
        first = next((c for c, kind in COLUMNS[d].items() if kind in NUMERIC), None)
        if times and first:
            parts.append(
                f"SELECT dataset, c, count(*) AS days, arg_min(v, day) AS f, arg_max(v, day) AS l FROM ("
                f"SELECT '{d}' AS dataset, '{first}' AS c, CAST({times[0]} AS DATE) AS day, avg({first}) AS v "
                f"FROM {t} GROUP BY 3) GROUP BY 1, 2"
            )
    return _union(parts)


CATALOGUE_INPUTS = ["lineitem_nulls", "orders_nulls", "events_gaps"]


def _catalogue(body: str, **ctes: str) -> str:
    return _with(CATALOGUE_INPUTS, body, p=_profile_cte(), days=_days_cte(), **ctes)


CHARTS = """
    SELECT dataset, pack, CAST(row_number() OVER (PARTITION BY dataset ORDER BY po, k) AS INTEGER) AS seq,
           id, title, priority, tags, mark
    FROM (
        SELECT dataset, 1 AS po, k, 'snapshot' AS pack, 'missing_' || lower(unit) AS id,
               'Missing values (Top 20) — ' || unit AS title, 95 AS priority, 'quality,snapshot' AS tags, 'bar' AS mark
        FROM (SELECT dataset FROM p GROUP BY dataset HAVING sum(missing) > 0),
             (VALUES (1, 'Count'), (2, 'Percent')) AS units(k, unit)
        UNION ALL
        SELECT dataset, 2, k, 'categorical', 'cat_top_' || k, 'Top categories: ' || c, CAST(75 - 5 * k AS INTEGER),
               'categorical,distribution', 'bar'
        FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p) AS k
              FROM p WHERE kind = 'string' AND NOT id_any)
        WHERE u > 0
        UNION ALL
        SELECT dataset, 3, 1, 'timeseries', 'ts_daily_line', 'Daily trend — ' || c, 85, 'timeseries,trend', 'line'
        FROM days
        UNION ALL
        SELECT dataset, 3, 2, 'timeseries', 'ts_rolling_7d', 'Rolling average (7D) — ' || c, 80,
               'timeseries,smoothing', 'line'
        FROM days WHERE days >= 14
        UNION ALL
        SELECT DISTINCT dataset, 4, 0, 'numeric', 'numeric_corr', 'Correlation heatmap', 95, 'numeric', 'rect'
        FROM p WHERE kind = 'number' AND NOT id_like
        UNION ALL
        SELECT dataset, 4, k, 'numeric', 'numeric_hist_' || k, 'Histogram: ' || c, 80, 'numeric', 'bar'
        FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY variance DESC NULLS LAST, p) AS k
              FROM p WHERE kind = 'number' AND NOT id_like)
    )
"""

RUN_LOG = """
    SELECT dataset, pack, CASE WHEN reason IS NULL THEN 'done' ELSE 'skipped' END AS status,
           coalesce(reason, 'OK') AS detail
    FROM (
        SELECT dataset, 'snapshot' AS pack,
               CASE WHEN sum(missing) = 0 THEN 'No missing values.' END AS reason FROM p GROUP BY dataset
        UNION ALL
        SELECT DISTINCT dataset, 'categorical', NULL FROM p WHERE kind = 'string'
        UNION ALL
        SELECT dataset, 'timeseries', NULL FROM days
        UNION ALL
        SELECT dataset, 'numeric', CASE WHEN bool_and(id_like)
               THEN 'No usable numeric columns (numeric columns look like IDs).' END
        FROM p WHERE kind = 'number' GROUP BY dataset
    )
"""


def _pairs_cte() -> str:
    parts = []
    for d, t in DATASET_SQL.items():
        numbers = [(p, c) for p, (c, kind) in enumerate(COLUMNS[d].items()) if kind in NUMERIC]
        for (px, x), (py, y) in combinations(numbers, 2):
            parts.append(
                f"SELECT '{d}' AS dataset, {px} AS px, {py} AS py, '{x}' AS x, '{y}' AS y, {_corr(x, y)} AS corr, "
                f"regr_count({x}, {y})::BIGINT AS n FROM {t}"
            )
    return _union(parts)


CANDIDATES = """
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ko, o1, o2, o3) AS hyp
    FROM (
        SELECT dataset, 1 AS ko, -missing AS o1, p AS o2, 0 AS o3, 'missingness' AS kind, c AS col,
               'Column ''' || c || ''' has missing values.' AS statement,
               NULL AS x, NULL AS y, missing / n AS metric, n AS sample FROM p WHERE missing > 0
        UNION ALL
        SELECT dataset, 2, p, 0, 0, 'category_dominance', c, 'One value dominates column ''' || c || '''.',
               NULL, NULL, NULL, n FROM p WHERE kind = 'string'
        UNION ALL
        SELECT dataset, 3, -abs(corr), px, py, 'correlation', NULL, '''' || x || ''' and ''' || y || ''' are correlated.',
               x, y, corr, n
        FROM pairs
        WHERE corr IS NOT NULL
          AND (dataset, x) IN (SELECT (dataset, c) FROM p WHERE NOT id_like)
          AND (dataset, y) IN (SELECT (dataset, c) FROM p WHERE NOT id_like)
    )
"""


def _tops_cte() -> str:
    parts = []
    for d, t in DATASET_SQL.items():
        for c, kind in COLUMNS[d].items():
            if kind == "string":
                parts.append(
                    f"(SELECT '{d}' AS dataset, '{c}' AS col, {c} AS value, "
                    f"count(*) / (SELECT count({c}) FROM {t}) AS share FROM {t} WHERE {c} IS NOT NULL "
                    f"GROUP BY {c} ORDER BY count(*) DESC, {DIGESTED.format(c=c)} LIMIT 1)"
                )
    return _union(parts)


ADVICE = {
    "id": "Exclude from categorical distribution charts and most modeling features.",
    "chart": "Check categorical role detection or allow ''top N + Other'' for high-cardinality columns.",
    "trend": "Consider checking seasonality or outliers using weekly/monthly aggregation.",
    "missing": "Consider imputation or filtering.",
    "dominance": "Check whether rare values need grouping.",
    "corr": "Validate correlation with additional data.",
}

CONFIDENCE = "CAST(CASE WHEN {n} < 30 THEN 0.3 WHEN {n} < 1000 THEN 0.6 ELSE 0.9 END AS DOUBLE)"


def _insights_cte() -> str:
    direction = "CASE WHEN l - f > 0 THEN 'increased' WHEN l - f < 0 THEN 'decreased' ELSE 'stayed flat' END"
    first_time = _union([
        f"SELECT '{d}' AS dataset, '{c}' AS ts"
        for d in DATASET_SQL for c, kind in COLUMNS[d].items() if kind == "timestamp_ntz"
    ])
    return f"""
    SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY so, k) AS INTEGER) AS seq, title, description,
           severity, {CONFIDENCE.format(n='sample')} AS confidence, evidence_type, source_pack, columns, metrics, action
    FROM (
        SELECT dataset, 1 AS so, p AS k, 'Column ''' || c || ''' looks like an identifier' AS title,
               'Unique ratio ≈ ' || u || '/' || n AS description, 'info' AS severity, n AS sample,
               'distribution' AS evidence_type, 'categorical' AS source_pack, c AS columns,
               '{{"n_rows":"' || n || '","n_unique":"' || u || '"}}' AS metrics, '{ADVICE["id"]}' AS action
        FROM p WHERE kind = 'string' AND id_any
        UNION ALL
        SELECT dataset, 2, 0, 'No categorical charts rendered',
               'All candidate columns look like identifiers or have no values.', 'info', max(n), 'distribution',
               'categorical', string_agg(c, ',' ORDER BY p), '{{}}', '{ADVICE["chart"]}'
        FROM p WHERE kind = 'string' GROUP BY dataset HAVING bool_and(id_any)
        UNION ALL
        SELECT dataset, 2, 0, 'No categorical columns', '', 'info', max(n), 'distribution', 'categorical', '',
               '{{}}', ''
        FROM p GROUP BY dataset HAVING bool_and(kind <> 'string')
        UNION ALL
        SELECT days.dataset, 3, 0, '''' || days.c || ''' ' || {direction} || ' over the observed period',
               printf('First=%.4g, Last=%.4g, Delta=%.4g', f, l, l - f), 'info', n - missing, 'trend', 'timeseries',
               ts || ',' || days.c, '{{"direction":"' || {direction} || '"}}', '{ADVICE["trend"]}'
        FROM days JOIN ({first_time}) t ON t.dataset = days.dataset JOIN p ON p.dataset = days.dataset AND p.c = ts
        WHERE days >= 2
        UNION ALL
        SELECT dataset, 4, hyp, statement, 'Missing rate ' || printf('%.4g', metric),
               CASE WHEN metric > 0.3 THEN 'risk' ELSE 'warning' END, sample, 'stat', 'hypothesis_verify', col,
               '{{"missing_rate":"' || printf('%.6f', metric) || '"}}', '{ADVICE["missing"]}'
        FROM cand WHERE kind = 'missingness'
        UNION ALL
        SELECT cand.dataset, 4, hyp, statement,
               'Top value ''' || value || ''' holds ' || printf('%.4g', share) || ' of the values',
               CASE WHEN share > 0.9 THEN 'warning' ELSE 'info' END, sample, 'distribution', 'hypothesis_verify',
               cand.col,
               '{{"top_share":"' || printf('%.6f', share) || '","top_value":' || to_json(value) || '}}',
               '{ADVICE["dominance"]}'
        FROM cand JOIN tops ON cand.dataset = tops.dataset AND cand.col = tops.col WHERE kind = 'category_dominance'
        UNION ALL
        SELECT dataset, 4, hyp, statement,
               'Pearson correlation ' || printf('%.4g', metric) || ' over ' || sample || ' rows',
               CASE WHEN abs(metric) >= 0.8 THEN 'opportunity' ELSE 'info' END, sample, 'correlation',
               'hypothesis_verify', x || ',' || y,
               '{{"pearson_corr":"' || printf('%.6f', metric) || '","sample_size":"' || sample || '"}}',
               '{ADVICE["corr"]}'
        FROM cand WHERE kind = 'correlation' AND sample >= 10
    )
    """


RELABELLED = """
    SELECT dataset, seq, 'I' || seq AS id, title, evidence_type,
           CASE WHEN severity = 'warning' THEN 'RISK' WHEN evidence_type = 'trend' THEN 'bogus'
                WHEN evidence_type = 'correlation' THEN NULL ELSE severity END AS severity,
           CASE WHEN evidence_type <> 'correlation' THEN confidence END AS confidence FROM i
"""

NORMAL = "CASE WHEN lower(severity) IN ('risk', 'warning', 'opportunity', 'info') THEN lower(severity) ELSE 'info' END"


def _plan() -> str:
    """The plan of every table out of the types its columns really have."""
    typed = _union([
        f"SELECT '{d}' AS dataset, {p} AS position, '{c}' AS c, typeof(any_value({c})) AS t FROM {d}"
        for d in DATASET_SQL for p, c in enumerate(COLUMNS[d])
    ])
    rules = ", ".join(f"({i}, '{pack}', '{why}', '{role}')" for i, (pack, why, role) in enumerate(
        [(pack, why, {None: "any", "string": "categorical", "timestamp_ntz": "datetime", "number": "numeric"}[kind])
         for pack, why, kind in PACKS]))
    return f"""
    WITH typed AS ({typed}), kinds AS (
        SELECT *, CASE WHEN t = 'VARCHAR' THEN 'categorical' WHEN t LIKE 'TIMESTAMP%' OR t = 'DATE' THEN 'datetime'
                       WHEN t LIKE '%INT' OR t IN ('INTEGER', 'DOUBLE', 'FLOAT', 'BOOLEAN') OR t LIKE 'DECIMAL%' THEN 'numeric'
                  END AS kind FROM typed
    ), tables AS (
        SELECT dataset, count(*) AS columns, coalesce(bool_or(kind = 'datetime'), false) AS dated,
               coalesce(bool_or(kind IN ('numeric', 'categorical')), false) AS plain,
               coalesce(list(c ORDER BY position) FILTER (kind = 'categorical'), []) AS categorical,
               coalesce(list(c ORDER BY position) FILTER (kind = 'numeric'), []) AS numeric,
               list(c ORDER BY position) FILTER (kind = 'datetime') AS datetime
        FROM kinds GROUP BY dataset
    ), rules(place, pack, why, role) AS (VALUES {rules})
    SELECT CAST(row_number() OVER (PARTITION BY dataset ORDER BY place) AS INTEGER) AS step, pack, why,
           CASE WHEN dated AND len(numeric) > 0 THEN 'timeseries' WHEN plain THEN 'tabular' ELSE 'unknown' END AS dataset_type,
           CASE role WHEN 'any' THEN '{{}}' WHEN 'categorical' THEN CAST(to_json({{'cols': categorical}}) AS VARCHAR)
                     WHEN 'numeric' THEN CAST(to_json({{'cols': numeric}}) AS VARCHAR)
                     ELSE CAST(to_json({{'ts_col': datetime[1], 'cols': numeric}}) AS VARCHAR) END AS params,
           'Rule-based plan over ' || columns || ' columns.' AS notes, dataset
    FROM tables, rules
    WHERE role = 'any' OR role = 'categorical' AND len(categorical) > 0 OR role = 'numeric' AND len(numeric) > 0
       OR role = 'datetime' AND dated
    """


def _catalogue_oracles() -> dict[str, str]:
    out = {}
    out["analysis_plan"] = _plan()
    out["pack_run_log"] = _catalogue(RUN_LOG)
    out["skipped_reasons"] = _catalogue(
        "SELECT dataset, pack || ': ' || detail AS reason FROM log WHERE status = 'skipped'", log=RUN_LOG
    )
    out["run_packs"] = _catalogue(
        "SELECT dataset, pack, status, detail FROM log WHERE dataset = 'orders' AND pack IN ('snapshot', 'numeric') "
        "UNION ALL SELECT 'orders', 'timeseries', 'skipped', 'Error: Column ''o_orderstatus'' is not numeric.' "
        "UNION ALL SELECT 'orders', 'forecast', 'skipped', 'Unknown pack: forecast'",
        log=RUN_LOG,
    )
    best = "CAST(row_number() OVER (PARTITION BY {by} ORDER BY priority DESC, seq) AS INTEGER) AS rank"
    out["charts_normalize"] = _catalogue(
        "SELECT dataset, pack, seq, "
        "CASE WHEN id = 'ts_daily_line' THEN 'timeseries_vega' WHEN pack = 'snapshot' THEN 'snapshot_chart_' || "
        "row_number() OVER (PARTITION BY dataset, pack ORDER BY seq) ELSE id END AS id, "
        "CASE WHEN id = 'ts_daily_line' OR pack = 'snapshot' THEN pack ELSE title END AS title, "
        "CASE WHEN id = 'ts_daily_line' OR pack = 'categorical' THEN 50 ELSE priority END AS priority, "
        "CASE WHEN id = 'ts_daily_line' OR pack = 'categorical' THEN pack ELSE tags END AS tags, mark FROM ch",
        ch=CHARTS,
    )
    out["charts_flatten"] = _catalogue(f"SELECT *, {best.format(by='dataset')} FROM ch", ch=CHARTS)
    out["charts_top3_per_pack"] = _catalogue(
        f"SELECT *, {best.format(by='dataset, pack')} FROM ch QUALIFY rank <= 3", ch=CHARTS
    )
    out["charts_top12"] = _catalogue(
        f"SELECT *, {best.format(by='dataset')} FROM c3 QUALIFY rank <= 12", ch=CHARTS,
        c3="SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY dataset, pack ORDER BY priority DESC, seq) <= 3",
    )
    words = "list_contains(string_split(tags, ',') || [pack], '{}')"
    filters = {
        "all": "true",
        "quality": f"{words.format('quality')} OR {words.format('snapshot')}",
        "categorical": words.format("categorical"),
        "numeric": words.format("numeric"),
        "time": f"{words.format('time')} OR {words.format('timeseries')}",
    }
    out["charts_by_tag"] = _catalogue(
        _union([f"SELECT *, '{tag}' AS filter FROM ch WHERE {test}" for tag, test in filters.items()]), ch=CHARTS
    )
    ctes = {"pairs": _pairs_cte(), "cand": CANDIDATES, "tops": _tops_cte(), "i": _insights_cte()}
    out["hypothesis_candidates"] = _catalogue(
        "SELECT CAST(hyp AS INTEGER) AS hyp_id, kind, statement, col, x, y FROM cand WHERE dataset = 'lineitem'",
        pairs=ctes["pairs"], cand=CANDIDATES,
    )
    out["hypotheses_from_json"] = out["hypothesis_candidates"]
    out["insights_table"] = _catalogue(
        "SELECT dataset, seq, 'I' || seq AS id, title, description, severity, confidence, "
        "action AS recommended_action, evidence_type, source_pack, columns, metrics FROM i", **ctes,
    )
    ctes["s"] = RELABELLED
    out["insights_normalize"] = _catalogue(
        f"SELECT dataset, id, title, {NORMAL} AS severity, confidence FROM s", **ctes
    )
    orders = {
        "insights_by_confidence": "coalesce(confidence, -1) DESC",
        "insights_by_confidence_asc": "coalesce(confidence, -1)",
        "insights_by_severity": f"CASE {NORMAL} WHEN 'risk' THEN 0 WHEN 'warning' THEN 1 WHEN 'opportunity' THEN 2 "
                                "ELSE 3 END",
    }
    for key, order in orders.items():
        out[key] = _catalogue(
            "SELECT dataset, id, title, severity, confidence, CAST(row_number() OVER "
            f"(PARTITION BY dataset ORDER BY {order}, seq) AS INTEGER) AS rank FROM s", **ctes,
        )
    out["insights_by_severity_filter"] = _catalogue(
        f"SELECT dataset, id, title, severity FROM s WHERE {NORMAL} = 'risk'", **ctes
    )
    impact = "CASE WHEN {s} > 0.3 THEN 'high' WHEN {s} > 0.05 THEN 'medium' ELSE 'low' END"
    dups = "(SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)"
    out["data_quality_notes"] = _catalogue(
        "SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY missing DESC, p) AS INTEGER) AS seq, "
        f"'Missing values detected' AS issue, c AS columns, {impact.format(s='missing / n')} AS impact, "
        "'Consider imputation or filtering' AS suggestion FROM p WHERE missing > 0 "
        "UNION ALL SELECT 'flags', 1, 'Duplicate rows detected', '', "
        f"{impact.format(s='sum(n - 1) / sum(n)')}, 'Remove repeated rows before aggregating' FROM {dups}",
    )
    out["overview_metrics"] = (
        "SELECT 'flags' AS dataset, CAST(sum(n) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS cols, "
        "CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(2 AS BIGINT) AS insights, CAST(0 AS BIGINT) AS errors, "
        f"'clean' AS status FROM {dups}"
    )
    metrics = (
        "SELECT 'rows' AS metric, count(*) AS v FROM {t} UNION ALL SELECT 'cols', {n} UNION ALL "
        "SELECT 'duplicate_rows', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {t} GROUP BY {cols}) "
        "UNION ALL SELECT 'insights_count', {i}"
    )
    out["compare_metrics"] = _catalogue(
        "SELECT coalesce(a.metric, b.metric) AS metric, CAST(a.v AS BIGINT) AS a, CAST(b.v AS BIGINT) AS b, "
        "CASE WHEN a.metric <> 'duplicate_rows' THEN CAST(coalesce(b.v, 0) - coalesce(a.v, 0) AS BIGINT) END AS diff "
        "FROM a FULL JOIN b ON a.metric = b.metric",
        **{k: v for k, v in ctes.items() if k != "s"},
        a=metrics.format(t="orders_nulls", n=6, cols=", ".join(COLUMNS["orders"]),
                         i="count(*) FROM i WHERE dataset = 'orders'"),
        b=metrics.format(t="lineitem", n=3, cols="l_returnflag, l_linestatus, l_linenumber", i="2"),
    )
    ranked = (
        "SELECT CAST(row_number() OVER (ORDER BY missing DESC, p) AS INTEGER) AS rank, c, missing FROM p "
        "WHERE dataset = '{d}' QUALIFY rank <= 10"
    )
    out["compare_top_missing"] = _catalogue(
        "SELECT coalesce(a.rank, b.rank) AS rank, a.c AS column_a, a.missing AS missing_a, b.c AS column_b, "
        "b.missing AS missing_b FROM a FULL JOIN b ON a.rank = b.rank",
        a=ranked.format(d="orders"), b=ranked.format(d="lineitem"),
    )
    out["compare_errors"] = (
        "SELECT * FROM (VALUES ('orders', 'pack_error[timeseries]: Column ''o_orderstatus'' is not numeric.'), "
        "('events', 'pack_error[timeseries]: Column ''event_type'' is not numeric.')) AS e(dataset, error)"
    )
    return out


def _source_oracles() -> dict[str, str]:
    out = {}
    out["load_dispatch"] = (
        "SELECT suffix, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders, "
        "(VALUES ('CSV'), ('jsonl'), ('ndjson'), ('parquet')) AS s(suffix) GROUP BY suffix"
    )
    out["scan_csv"] = "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"
    out["scan_csv_latin1"] = "SELECT c_custkey, translate(c_name, 'Cue', 'Çüé') AS c_name FROM customer"
    out["scan_parquet"] = "SELECT * FROM orders"
    out["scan_csv_multiline"] = (
        "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n, lang FROM documents")
    out["scan_jsonl"] = "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"
    out["scan_json_document"] = "SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier"
    out["scan_json_columns"] = "SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier"
    out["scan_jsonl_bad_line"] = "SELECT count(*) || ' lines' AS broken FROM customer WHERE c_custkey % 7 = 3"
    out["scan_csv_mixed_headers"] = (
        "SELECT CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_regionkey END AS BIGINT) AS a, "
        "CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE n_nationkey END AS BIGINT) AS b FROM nation")
    out["csv_na_tokens"] = _with(
        ["lineitem_nulls"],
        "SELECT 'bigint' AS type_l_orderkey, 'bigint' AS type_l_linenumber, 'double' AS type_l_tax, "
        "'string' AS type_l_returnflag, count(l_orderkey) AS n_l_orderkey, count(l_linenumber) AS n_l_linenumber, "
        "count(l_tax) AS n_l_tax, count(l_returnflag) AS n_l_returnflag, round(sum(l_tax), 2) AS sum_tax "
        "FROM lineitem_nulls",
    )
    out["normalize_columns"] = (
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
    )
    out["normalize_missing"] = _with(
        ["lineitem_nulls"],
        "SELECT count(l_tax) AS l_tax, count(l_discount) AS l_discount, count(l_quantity) AS l_quantity "
        "FROM lineitem_nulls",
    )
    out["sanitize_json"] = (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 1) THEN NULL ELSE o_totalprice END AS price FROM orders"
    )
    out["chart_csv"] = _with(
        ["orders_nulls"], 'SELECT col AS "column", value, cnt FROM r WHERE rk <= 10',
        f=_frequencies("orders_nulls", ["o_orderstatus", "o_orderpriority"]), r=RANKED,
    )
    out["write_profile"] = (
        "SELECT 'o_totalprice' AS \"column\", count(o_totalprice) AS count, min(o_totalprice) AS min, "
        "max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders"
    )
    return out


def _deep_oracles() -> dict[str, str]:
    nulls = ["lineitem_nulls"]
    out = {}
    total = " + ".join(f"count(*) - count({c})" for c in LINEITEM)
    kinds = {"numeric": 8, "boolean": 0, "datetime": 1, "categorical": 2, "text": 0, "url": 0, "unsupported": 0}
    typed = ", ".join(f"CAST({n} AS BIGINT) AS n_{k}" for k, n in kinds.items())
    out["deep_overview"] = _with(
        nulls,
        "SELECT rows, columns, missing_cells, round(missing_cells / (rows * columns) * 100.0, 6) AS missing_pct, "
        f"duplicate_rows, round(duplicate_rows / rows * 100.0, 6) AS duplicate_pct, {typed} FROM ("
        f"SELECT count(*) AS rows, CAST({len(LINEITEM)} AS BIGINT) AS columns, "
        f"CAST({total} AS BIGINT) AS missing_cells, (SELECT CAST(sum(n - 1) AS BIGINT) FROM "
        f"(SELECT count(*) AS n FROM lineitem_nulls GROUP BY {', '.join(LINEITEM)})) "
        "AS duplicate_rows FROM lineitem_nulls)",
    )
    text = (
        "CASE WHEN count(*) FILTER (regexp_matches({c}, '^https?://')) = count({c}) AND count({c}) > 0 THEN 'url' "
        "WHEN count(DISTINCT {c}) <= 50 AND (count(DISTINCT {c}) / count({c}) <= 0.5 OR count(DISTINCT {c}) = 1) "
        "THEN 'categorical' ELSE 'text' END"
    )
    tables = {
        "pages": {"page_id": "'numeric'", "url": text, "html": text},
        "documents": {"doc_id": "'numeric'", "text": text, "lang": text, "source": text, "n_chars": "'numeric'"},
        "embeddings": {"vec_id": "'numeric'", "embedding": "'unsupported'", "label": "'numeric'"},
        "events": {"event_id": "'numeric'", "ts": "'datetime'", "user_id": "'numeric'", "event_type": text,
                   "value": "'numeric'", "props": text},
    }
    out["deep_variable_types"] = _union([
        f"SELECT '{t}' AS dataset, '{c}' AS \"column\", {kind.format(c=c)} AS type FROM {t} HAVING count(*) >= 0"
        for t, columns in tables.items() for c, kind in columns.items()
    ])

    def numeric(c: str) -> str:
        d = f"CAST({c} AS DOUBLE)"
        q = {p: f"quantile_cont({d}, {p})" for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
        return (
            f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, "
            f"count(DISTINCT {c}) AS n_unique, CAST(0 AS BIGINT) AS n_infinite, "
            f"count(*) FILTER ({c} = 0) AS n_zeros, count(*) FILTER ({c} < 0) AS n_negative, "
            f"round(avg({d}), 4) AS mean, round(stddev_samp({d}), 4) AS std, round(var_samp({d}), 2) AS variance, "
            f"round(stddev_samp({d}) / avg({d}), 4) AS cv, round(min({d}), 4) AS min, round(max({d}), 4) AS max, "
            f"round(max({d}) - min({d}), 4) AS range, round(sum({d}), 2) AS sum, round({q[0.05]}, 4) AS p5, "
            f"round({q[0.25]}, 4) AS p25, round({q[0.5]}, 4) AS median, round({q[0.75]}, 4) AS p75, "
            f"round({q[0.95]}, 4) AS p95, round({q[0.75]} - {q[0.25]}, 4) AS iqr, "
            f"round((SELECT quantile_cont(abs({d} - (SELECT {q[0.5]} FROM lineitem_nulls)), 0.5) FROM lineitem_nulls), 4) "
            f"AS mad, round(skewness({d}), 4) AS skewness, round(kurtosis({d}), 4) AS kurtosis FROM lineitem_nulls"
        )

    out["deep_numeric"] = _with(nulls, _union([numeric(c) for c in NUMBERS]))
    out["deep_histogram"] = (
        "SELECT 'l_quantity' AS \"column\", round(lo + b * w, 6) AS bin_start, round(lo + (b + 1) * w, 6) AS bin_end, "
        "count(*) AS cnt FROM (SELECT least(floor((l_quantity - lo) / w), 49) AS b, lo, w FROM lineitem, "
        "(SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 50 AS w FROM lineitem)) GROUP BY b, lo, w"
    )
    out["deep_common_values"] = _with(
        nulls,
        'SELECT col AS "column", value, cnt, round(cnt / (SELECT sum(cnt) FROM f WHERE f.col = r.col), 6) AS share, '
        "CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10",
        f=_frequencies("lineitem_nulls", ["l_returnflag", "l_linestatus", "l_linenumber"]), r=RANKED,
    )
    out["deep_common_texts"] = _union([
        f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt, "
        f"round(count(*) / (SELECT count({c}) FROM documents), 6) AS share, CAST(row_number() OVER "
        f"(ORDER BY count(*) DESC, {DIGESTED.format(c=c)}) AS INTEGER) AS rank FROM documents WHERE {c} IS NOT NULL "
        f"GROUP BY {c} QUALIFY rank <= 5)"
        for c in ("text", "lang")
    ])
    out["deep_duplicate_texts"] = (
        "SELECT text, lang, count(*) AS n_duplicates FROM documents GROUP BY text, lang HAVING count(*) > 1 "
        f"ORDER BY 3 DESC, {DIGESTED.format(c='text')}, lang LIMIT 10"
    )
    extremes = []
    for c in ("l_quantity", "l_extendedprice", "l_tax"):
        for side, order in (("smallest", "ASC"), ("largest", "DESC")):
            extremes.append(
                f"(SELECT '{c}' AS \"column\", '{side}' AS side, CAST(row_number() OVER (ORDER BY {c} {order}) AS INTEGER) "
                f"AS rank, {c} AS value, count(*) AS cnt FROM lineitem_nulls WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY {c} {order} LIMIT 10)"
            )
    out["deep_extreme_values"] = _with(nulls, _union(extremes))
    out["deep_extreme_integers"] = _with([], _union([
        f"(SELECT '{c}' AS \"column\", '{side}' AS side, CAST(row_number() OVER (ORDER BY {c} {order}) AS INTEGER) "
        f"AS rank, CAST({c} AS VARCHAR) AS exact, count(*) AS cnt FROM typed GROUP BY {c} ORDER BY {c} {order} LIMIT 10)"
        for c in ("key", "price")
        for side, order in (("smallest", "ASC"), ("largest", "DESC"))
    ]), typed="SELECT l_orderkey + 9007199254740992 AS key, CAST(l_extendedprice AS DECIMAL(20, 2)) AS price FROM lineitem")
    out["exact_summary"] = _exact_summary()
    out["deep_text_length"] = _per_column(
        "documents", ["text", "lang"],
        "'{c}' AS \"column\", count({c}) AS count, min(length({c})) AS min, max(length({c})) AS max, "
        "round(avg(length({c})), 6) AS mean, quantile_cont(CAST(length({c}) AS DOUBLE), 0.5) AS median, "
        "CAST(sum(length({c})) AS BIGINT) AS total",
    )
    punctuation = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    out["deep_word_counts"] = (
        "SELECT 'text' AS \"column\", word, count(*) AS cnt FROM (SELECT trim(w, '" + punctuation + "') AS word FROM "
        "(SELECT unnest(regexp_split_to_array(lower(text), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+')) AS w "
        "FROM documents)) WHERE word <> '' GROUP BY word"
    )
    out["deep_char_counts"] = (
        "SELECT 'text' AS \"column\", char, count(*) AS cnt FROM "
        "(SELECT unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents) GROUP BY char"
    )
    out["deep_datetime_text"] = _with(
        ["orders_strdate"],
        "SELECT 'o_orderdate' AS \"column\", count(d) AS count, min(d) AS min, max(d) AS max, "
        "round(date_diff('second', min(d), max(d)) / 86400.0, 6) AS range_days "
        "FROM (SELECT try_strptime(o_orderdate, '%Y-%m-%d') AS d FROM orders_strdate)",
    )
    cells = ("SELECT o_custkey AS a, o_orderstatus AS b, count(*) AS o FROM orders "
             "WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2")
    out["deep_cramers_v_keys"] = (
        f"WITH c AS ({cells}), t AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS ro, "
        "sum(o) OVER (PARTITION BY b) AS co FROM c), "
        "u AS (SELECT sum(o * o / (ro * co)) AS s, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS r, "
        "count(DISTINCT b) AS k FROM t) "
        "SELECT 'o_custkey' AS x, 'o_orderstatus' AS y, round(sqrt(greatest(0, s - 1 - (r - 1) * (k - 1) / (n - 1)) / "
        "least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1)), 8) AS v, n FROM u"
    )
    out["deep_datetime"] = (
        "SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS count, min(o_orderdate) AS min, "
        "max(o_orderdate) AS max, round(date_diff('second', min(o_orderdate), max(o_orderdate)) / 86400.0, 6) "
        "AS range_days FROM orders"
    )
    out["deep_datetime_histogram"] = (
        "SELECT 'o_orderdate' AS \"column\", CAST(date_trunc('month', o_orderdate) AS DATE) AS start, count(*) AS cnt "
        "FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 2"
    )
    parts = {
        "scheme": "regexp_extract(url, '^([a-z]+)://', 1)",
        "host": "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)",
        "path": "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)",
    }
    out["deep_url_parts"] = _union([
        f"SELECT 'url' AS \"column\", '{part}' AS part, {e} AS value, count(*) AS cnt FROM pages GROUP BY 3"
        for part, e in parts.items()
    ])
    pairs = combinations(["l_quantity", "l_extendedprice", "l_discount"], 2)
    out["deep_spearman"] = _with(nulls, _union([
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr(rx, ry), 8) AS corr, count(*) AS n FROM ("
        f"SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, "
        f"rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM lineitem_nulls "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
        for x, y in pairs
    ]))
    flags = list(combinations(["l_returnflag", "l_linestatus", "l_linenumber"], 2))
    cells = _union([
        f"SELECT '{x}' AS x, '{y}' AS y, CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b, count(*) AS o "
        f"FROM lineitem_nulls WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}"
        for x, y in flags
    ])
    out["deep_cramers_v"] = _with(
        nulls,
        "SELECT x, y, round(sqrt(greatest(0, s - 1 - (r - 1) * (k - 1) / (n - 1)) / "
        "least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1)), 8) AS v, n FROM "
        "(SELECT x, y, sum(o * o / (ro * co)) AS s, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS r, "
        "count(DISTINCT b) AS k FROM m GROUP BY x, y)",
        c=cells,
        m="SELECT *, CAST(sum(o) OVER (PARTITION BY x, y, a) AS DOUBLE) AS ro, "
          "CAST(sum(o) OVER (PARTITION BY x, y, b) AS DOUBLE) AS co FROM c",
    )
    # 1..50 and 1..7 in eight bins each
    out["deep_interactions"] = (
        "SELECT 'l_quantity' AS x, 'l_linenumber' AS y, 1 + i * 6.125::DOUBLE AS x_start, 1 + j * 0.75::DOUBLE AS y_start, "
        "count(*) AS cnt FROM (SELECT least(floor((l_quantity - 1) / 6.125), 7) AS i, "
        "least(floor((l_linenumber - 1) / 0.75), 7) AS j FROM lineitem) GROUP BY i, j"
    )
    missing = ["l_discount", "l_tax", "l_returnflag"]
    out["deep_nullity_corr"] = _with(nulls, _union([
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr(({x} IS NULL)::INT, ({y} IS NULL)::INT), 8) AS corr FROM lineitem_nulls"
        for x in missing for y in missing
    ]))
    flags_sql = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in LINEITEM)
    count_sql = " + ".join(f"({c} IS NULL)::INT" for c in LINEITEM)
    out["deep_nullity_patterns"] = _with(
        nulls,
        f"SELECT concat_ws(',', {flags_sql}) AS missing_columns, CAST({count_sql} AS INTEGER) AS n_missing, "
        "count(*) AS cnt FROM lineitem_nulls GROUP BY 1, 2",
    )
    out["deep_samples"] = (
        "(SELECT *, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 10) UNION ALL "
        "(SELECT *, 'tail' AS part FROM orders ORDER BY o_orderkey DESC LIMIT 10)"
    )
    out["deep_duplicate_groups"] = (
        "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_duplicates FROM lineitem GROUP BY 1, 2, 3 "
        "HAVING count(*) > 1 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10"
    )
    rules = [
        f"SELECT '{c}' AS \"column\", 'missing' AS alert, round((count(*) - count({c})) / count(*), 6) AS value "
        f"FROM lineitem_const HAVING (count(*) - count({c})) / count(*) > 0.05"
        for c in LINEITEM
    ]
    rules += [
        f"SELECT '{c}', 'zeros', round(count(*) FILTER ({c} = 0) / count({c}), 6) FROM lineitem_const "
        f"HAVING count(*) FILTER ({c} = 0) / count({c}) > 0.1"
        for c in [*KEYS_AND_NUMBERS, "k"]
    ]
    rules += [
        f"SELECT '{c}', 'constant', 1.0 FROM lineitem_const HAVING count(DISTINCT {c}) = 1" for c in [*LINEITEM, "k"]
    ]
    rules += [
        f"SELECT '{c}', 'unique', CAST(count(*) AS DOUBLE) FROM lineitem_const HAVING count(DISTINCT {c}) = count(*)"
        for c in LINEITEM
    ]
    rules += [
        f"SELECT '{c}', 'imbalance', v FROM (SELECT round(1 - (-sum(q * ln(q))) / ln(count(*)), 6) AS v FROM "
        f"(SELECT count(*) / (SELECT count({c}) FROM lineitem_const) AS q FROM lineitem_const WHERE {c} IS NOT NULL "
        f"GROUP BY {c})) WHERE v > 0.5"
        for c in ("l_returnflag", "l_linestatus")
    ]
    rules += [
        f"SELECT '{x},{y}', 'high_correlation', v FROM (SELECT round({_corr(x, y)}, 6) AS v FROM lineitem_const) "
        "WHERE abs(v) > 0.9"
        for x, y in (sorted(pair) for pair in combinations([*KEYS_AND_NUMBERS, "k"], 2))
    ]
    out["deep_alerts"] = _with(["lineitem_const"], _union(rules))
    return out


def all_oracles() -> dict[str, str]:
    return (
        _profile_oracles()
        | _categorical_oracles()
        | _numeric_oracles()
        | _hypothesis_oracles()
        | _time_oracles()
        | _catalogue_oracles()
        | _source_oracles()
        | _deep_oracles()
    )
