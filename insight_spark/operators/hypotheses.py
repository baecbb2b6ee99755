"""Check simple hypotheses (missingness, dominance, correlation) against a table.

Plans and results on the driver grow with the hypotheses given, not with the rows; the evidence of each kind comes from one distributed pass over the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from insight_spark.functions.columns import col, fields_of, is_numeric, normalize_missing, per_column
from insight_spark.functions.tables import small_table
from insight_spark.operators.frequency import top_values
from insight_spark.operators.numeric import pair_correlations

MIN_PAIRS = 10

CANDIDATE_SCHEMA = "hyp_id int, kind string, statement string, col string, x string, y string"
RESULT_SCHEMA = (
    CANDIDATE_SCHEMA + ", verified boolean, missing_rate double, top_value string, top_share double, "
    "pearson_corr double, n bigint, verify_error string"
)


def _first(hyps: DataFrame | Sequence[dict], k: int | None) -> list[dict]:
    if isinstance(hyps, DataFrame):
        ordered = hyps.orderBy("hyp_id")
        return [r.asDict() for r in (ordered if k is None else ordered.limit(k)).collect()]
    return [{"hyp_id": i, **h} for i, h in enumerate(hyps, start=1)][:k]


@dataclass
class Evidence:
    """Evidence already at hand, so that no pass over the data is made twice."""

    missing_rate: dict[str, float | None] = field(default_factory=dict)
    dominance: dict[str, tuple[str, float]] = field(default_factory=dict)
    correlation: dict[tuple[str, str], tuple[float | None, int]] = field(default_factory=dict)


def missing_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, missing_rate); NULL on an empty table."""
    df = normalize_missing(df)
    wanted = [(p, f.name, col(f.name)) for p, f in fields_of(df, cols)]
    rate = {"missing_rate": lambda c: F.avg(c.isNull().cast("double"))}
    return per_column(df, wanted, rate, fields=2).select("column", "missing_rate")


def dominance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, top_value, top_share) over the non-missing values."""
    top = top_values(df, cols, 1).filter("rank = 1")
    return top.select(
        "column", F.col("value").alias("top_value"), (F.col("cnt") / F.col("non_null")).alias("top_share")
    )


def verify_hypotheses(df: DataFrame, hyps: DataFrame | Sequence[dict], known: Evidence | None = None,
                      k: int | None = None) -> DataFrame:
    """All (or the first k) hypotheses with `verified` and the evidence of their kind.

    An unknown kind, a missing column or fewer than 10 complete pairs leave a
    hypothesis unverified; a pair that is not numeric also sets `verify_error`.
    """
    df = normalize_missing(df)
    known = known or Evidence()
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = _first(hyps, k)

    def about(kind: str, *keys: str) -> list[dict]:
        return [h for h in rows if h.get("kind") == kind and all(h.get(k) in types for k in keys)]

    missing = about("missingness", "col")
    dominant = about("category_dominance", "col")
    paired = about("correlation", "x", "y")

    rates = dict(known.missing_rate)
    rates |= {r.column: r.missing_rate for r in _rows(missing_rates, df, {h["col"] for h in missing} - set(rates))}
    tops = dict(known.dominance)
    tops |= {
        r.column: (r.top_value, r.top_share) for r in _rows(dominance, df, {h["col"] for h in dominant} - set(tops))
    }
    pairs = list(dict.fromkeys((h["x"], h["y"]) for h in paired))
    numeric = [(x, y) for x, y in pairs if is_numeric(types[x]) and is_numeric(types[y])]
    corrs = {pair: known.correlation[pair] for pair in numeric if pair in known.correlation}
    corrs |= pair_correlations(df, [pair for pair in numeric if pair not in corrs])
    complete = _complete_rows(df, [pair for pair in pairs if pair not in corrs])

    out = []
    for h in rows:
        verified, rate, value, share, corr, n, error = False, None, None, None, None, None, None
        if h in missing:
            rate = rates[h["col"]]
            verified = True
        elif h in dominant and h["col"] in tops:
            value, share = tops[h["col"]]
            verified = True
        elif h in paired:
            pair = h["x"], h["y"]
            if pair in corrs:
                if corrs[pair][1] >= MIN_PAIRS:
                    corr, n = corrs[pair]
                    verified = True
            elif complete[pair] >= MIN_PAIRS:
                wrong = next(c for c in pair if not is_numeric(types[c]))
                error = f"Column '{wrong}' is not numeric."
        out.append(
            (h["hyp_id"], h.get("kind"), h.get("statement"), h.get("col"), h.get("x"), h.get("y"),
             verified, rate, value, share, corr, n, error)
        )
    return small_table(df.sparkSession, out, RESULT_SCHEMA)


def _rows(evidence, df: DataFrame, cols: set[str]) -> list:
    """Evidence of the columns in question, on the driver."""
    return evidence(df, [c for c in df.columns if c in cols]).collect() if cols else []


def _complete_rows(df: DataFrame, pairs: list[tuple[str, str]]) -> dict:
    if not pairs:
        return {}
    counts = df.agg(
        *[F.count_if(col(x).isNotNull() & col(y).isNotNull()).alias(str(i)) for i, (x, y) in enumerate(pairs)]
    ).first()
    return {pair: counts[i] for i, pair in enumerate(pairs)}


def hyp_missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    hyps = [{"kind": "missingness", "col": c} for c in cols]
    return verify_hypotheses(df, hyps).select("hyp_id", "kind", "col", "verified", "missing_rate")


def hyp_category_dominance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    hyps = [{"kind": "category_dominance", "col": c} for c in cols]
    return verify_hypotheses(df, hyps).select("hyp_id", "kind", "col", "verified", "top_value", "top_share")


def hyp_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    hyps = [{"kind": "correlation", "x": x, "y": y} for x, y in pairs]
    return verify_hypotheses(df, hyps).select("hyp_id", "kind", "x", "y", "verified", "pearson_corr", "n")


def hypothesis_candidates(df: DataFrame, roles: DataFrame, k: int | None = None) -> DataFrame:
    """All (or the first k) hypotheses worth checking, from roles and correlations.

    Columns with missing values (most first), then categorical columns, then pairs
    of usable numeric columns by absolute correlation.
    """
    table = roles.orderBy("position").collect()  # one row per column
    rows, _ = propose(table, lambda names: pair_correlations(df, list(combinations(names, 2))), k)
    return small_table(df.sparkSession, rows, CANDIDATE_SCHEMA)


def corr_candidates(roles: Sequence[Row]) -> list[str]:
    """Usable numeric columns in schema order."""
    return [r.column for r in sorted(roles, key=lambda r: r.position) if r.numeric and not r.id_like]


def propose(roles: Sequence[Row], correlate: Callable[[list[str]], dict],
            k: int | None = None) -> tuple[list[tuple], Evidence]:
    """Candidate rows and the evidence that choosing them took.

    `correlate` gives (Pearson, rows) per pair of the named columns and is only
    called when pairs can still be among the first k.
    """
    known = Evidence({r.column: r.missing / r.n_rows if r.n_rows else None for r in roles})
    out = [
        ("missingness", f"Column '{r.column}' has missing values.", r.column, None, None)
        for r in sorted(roles, key=lambda r: -r.missing)
        if r.missing > 0
    ]
    out += [
        ("category_dominance", f"One value dominates column '{r.column}'.", r.column, None, None)
        for r in roles
        if r.categorical
    ]
    names = corr_candidates(roles)
    if (k is None or len(out) < k) and len(names) > 1:
        known.correlation = correlate(names)
        at = {c: i for i, c in enumerate(names)}
        found = [(pair, corr) for pair, (corr, _) in known.correlation.items() if corr is not None and pair[0] != pair[1]]
        found.sort(key=lambda f: (-abs(f[1]), at[f[0][0]], at[f[0][1]]))
        out += [("correlation", f"'{x}' and '{y}' are correlated.", None, x, y) for (x, y), _ in found]
    return [(i, *h) for i, h in enumerate(out[:k], start=1)], known


JSON_ITEM = "array<struct<kind: string, statement: string, col: string, x: string, y: string>>"


def hypotheses_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Hypotheses of JSON arrays, one array per row, numbered in order; other text gives none."""
    items = texts.select(F.posexplode(F.from_json(col(column), JSON_ITEM)).alias("at", "h"))
    return items.select((F.col("at") + 1).alias("hyp_id"), "h.kind", "h.statement", "h.col", "h.x", "h.y")
