"""The wave queries in DuckDB SQL."""

from __future__ import annotations

AS_OF = "TIMESTAMP '1997-06-30 00:00:00'"


def bars(symbol: str = "n_name") -> str:
    joined = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey" if symbol == "n_name" else "lineitem"
    return f"""
ticks AS (SELECT {symbol} AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_extendedprice}} AS k FROM {joined}),
plain AS (SELECT symbol, '1wk' AS "interval", CAST(date_trunc('week', ts) AS TIMESTAMP) AS bar_ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY ALL),
bars AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS INTEGER) AS bar_idx FROM plain)"""


BARS = bars()
SWINGS = f"""{BARS},
cuts AS (SELECT *, sum(CASE WHEN high <= ph THEN 1 ELSE 0 END) OVER w AS rise, sum(CASE WHEN low >= pl THEN 1 ELSE 0 END) OVER w AS fall
    FROM (SELECT *, lag(high) OVER v AS ph, lag(low) OVER v AS pl FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY bar_idx)) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
runs AS (SELECT *, max(bar_idx) OVER (PARTITION BY symbol, rise) AS rise_end, max(bar_idx) OVER (PARTITION BY symbol, fall) AS fall_end FROM cuts),
swing AS (SELECT symbol, "interval", bar_idx AS s, low AS slow, high AS shigh, CASE WHEN lead(high) OVER w > low THEN lead(rise_end) OVER w ELSE bar_idx END AS ue, CASE WHEN lead(low) OVER w < high THEN lead(fall_end) OVER w ELSE bar_idx END AS de
    FROM runs WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
edges AS (SELECT w.symbol, w.s, true AS up, ue AS e, slow AS low, CASE WHEN ue = w.s THEN slow ELSE b.high END AS high FROM swing w JOIN bars b ON b.symbol = w.symbol AND b.bar_idx = ue
    UNION ALL SELECT w.symbol, w.s, false, de, CASE WHEN de = w.s THEN shigh ELSE b.low END, shigh FROM swing w JOIN bars b ON b.symbol = w.symbol AND b.bar_idx = de),
waves AS (SELECT symbol, up, s, e, low, high, abs(high - low) AS length, e - s AS duration, CASE WHEN up THEN s ELSE e END AS low_idx, CASE WHEN up THEN e ELSE s END AS high_idx FROM edges)"""


def chain(dirs: list[bool], label: str) -> str:
    cols = ", ".join(f"w{i}" if i <= len(dirs) else f"NULL AS w{i}" for i in range(1, 6))
    joins = " ".join(f"JOIN waves w{i} ON w{i}.symbol = w1.symbol AND w{i}.s = w{i - 1}.e AND w{i}.up = {str(up).lower()}" for i, up in enumerate(dirs[1:], 2))
    return f"SELECT w1.symbol AS symbol, w1.s AS start, w{len(dirs)}.e AS fin, '{label}' AS rule_name, {cols} FROM waves w1 {joins} WHERE w1.up = {str(dirs[0]).lower()}"


IMPULSE, BEARISH, CORRECTIVE, TD = [True, False, True, False, True], [False, True, False, True, False], [False, True, False], [True, False]
MOTIVE = ["w2.length >= 0.2 * w1.length", "9 * w2.duration > w1.duration", "NOT (w3.length < w5.length AND w3.length < w1.length)", "w3.length >= w1.length / 3", "w3.length > w2.length", "7 * w3.duration > w1.duration", "w4.length > w2.length / 3", "w5.length < 2 * w1.length"]
RULES = {
    "impulse": [*MOTIVE, "w2.low > w1.low", "w3.high > w1.high", "w4.low > w1.high", "w5.high > w3.high"],
    "bearish_impulse": [*MOTIVE, "w2.high < w1.high", "w3.low < w1.low", "w4.high < w1.low", "w5.low < w3.low"],
    "Corrective": ["w1.high > w2.high", "w1.low > w3.low", "w1.length > w2.length", "w2.duration < 10 * w1.duration", "0.6 * w1.length < w3.length", "w3.length < 2.61 * w1.length", "0.35 * w1.length < w2.length", "w2.length < 0.618 * w1.length", "w3.duration < 10 * w1.duration"],
    "td": ["0.59 * w1.length < w2.length", "w2.length < 0.64 * w1.length", "9 * w2.duration > w1.duration"],
}
CORRECTION_NAMES = ["b_below_start", "c_below_a", "a_longer_than_b", "b_lasts_under_ten_a", "c_over_0.6_a", "c_under_2.61_a", "b_over_0.35_a", "b_under_0.618_a", "c_lasts_under_ten_a"]
SLOPE = "(CASE WHEN {a}.{i} <> {b}.{i} THEN ({b}.{v} - {a}.{v}) / ({b}.{i} - {a}.{i}) END)"
RULES["leading_diagonal"] = [
    *[x for x in RULES["impulse"] if x != "w4.low > w1.high"], SLOPE.format(a="w2", b="w4", i="low_idx", v="low") + " > " + SLOPE.format(a="w1", b="w3", i="high_idx", v="high"),
    SLOPE.format(a="w1", b="w3", i="high_idx", v="high") + " > 0", "w4.low < w1.high", "w5.length > 0.7 * w1.length", "w5.length < w3.length",
]


def holding(name: str) -> str:
    return " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in RULES[name])


def closest(r: str, ratios: tuple[float, ...]) -> str:
    return "least(" + ", ".join(f"abs({r} - {x})" for x in ratios) + ")"


def fib_distance(r: str) -> str:
    return f"(CASE WHEN {r} <= 0 THEN 999.0 ELSE {closest(r, (0.382, 0.5, 0.618, 1.0, 1.272, 1.618, 2.618))} END)"


L1, L2, L3, L5 = "w1.length", "w2.length", "w3.length", "w5.length"
D = closest(f"{L2} / {L1}", (0.382, 0.5, 0.618))
RETRACE = f"(CASE WHEN {L1} > 0 THEN CASE WHEN {D} < 0.05 THEN 1.0 WHEN {D} < 0.15 THEN 0.8 WHEN {D} < 0.25 THEN 0.5 ELSE 0.2 END ELSE 0.0 END)"
X = f"abs({L3} / {L1} - 1.618)"
EXTEND = f"(CASE WHEN {L1} > 0 THEN CASE WHEN {L3} / {L1} < 1 THEN 0.0 WHEN {X} < 0.1 THEN 1.0 WHEN {X} < 0.3 THEN 0.8 WHEN {X} < 0.5 THEN 0.6 ELSE 0.4 END ELSE 0.0 END)"
ONE = "(CASE WHEN {d} < 0.1 THEN 1.0 ELSE greatest(0.3, 1 - {d}) END)"
FIFTH = f"(CASE WHEN {L1} > 0 AND {L3} > 0 THEN greatest({ONE.format(d=f'abs({L5} / {L1} - 1)')}, {ONE.format(d=f'abs({L5} / {L3} - 0.618)')}) ELSE 0.5 END)"
C = closest(f"{L3} / {L1}", (1.0, 0.618))
FIB = f"(CASE WHEN w5 IS NOT NULL THEN (CAST({RETRACE} AS DOUBLE) + CAST({EXTEND} AS DOUBLE) + CAST({FIFTH} AS DOUBLE)) / 3 ELSE CASE WHEN {L1} > 0 THEN CASE WHEN {C} < 0.1 THEN 0.9 WHEN {C} < 0.2 THEN 0.7 ELSE 0.5 END ELSE 0.5 END END)"
T = "CAST(greatest(0.3, 1 - {d}) AS DOUBLE)"
TIME = f"(CASE WHEN w1.duration > 0 THEN ({T.format(d=fib_distance('(w2.duration / w1.duration)'))} + {T.format(d=fib_distance('(w3.duration / w1.duration)'))}) / 2 ELSE 0.5 END)"
RULE = "(CASE rule_name " + " ".join(f"WHEN '{n}' THEN ({holding(n)}) / {float(len(RULES[n]))}" for n in ("impulse", "bearish_impulse", "Corrective")) + " END)"
PATTERNS = f"""{SWINGS},
chains AS ({chain(IMPULSE, "impulse")} AND w1.length > 0 UNION ALL {chain(BEARISH, "bearish_impulse")} AND w1.length > 0 UNION ALL {chain(CORRECTIVE, "Corrective").replace("NULL AS w4, NULL AS w5", "NULL, NULL")} AND w1.length > 0),
parts AS (SELECT *, CAST({FIB} AS DOUBLE) AS fib_score, CAST({TIME} AS DOUBLE) AS time_score, CAST({RULE} AS DOUBLE) AS rule_score FROM chains),
patterns AS (SELECT p.*, greatest(0.0, least(1.0, fib_score * 0.5 + rule_score * 0.3 + time_score * 0.1 + 0.95 * 0.1)) AS ensemble_score, rule_score = 1.0 AS passes, a.bar_ts AS date_start, b.bar_ts AS date_end
    FROM parts p JOIN bars a ON a.symbol = p.symbol AND a.bar_idx = p.start JOIN bars b ON b.symbol = p.symbol AND b.bar_idx = p.fin)"""


def of(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def r(*cols: str, n: int = 6) -> str:
    return ", ".join(f'round({c}, {n}) AS "{c.split(".")[-1]}"' for c in cols)


def as_is(*cols: str) -> str:
    return ", ".join(f'"{c}"' for c in cols)


BAR = f"symbol, \"interval\", bar_ts, {as_is('open', 'high', 'low', 'close', 'volume')}, bar_idx"


def waves(n: int) -> str:
    """The columns of five waves, of which the first n exist."""
    fields = {"idx_start": ("s", "INTEGER"), "idx_end": ("e", "INTEGER"), "low": ("low", "DOUBLE"), "high": ("high", "DOUBLE"), "length": ("length", "DOUBLE"), "duration": ("duration", "INTEGER")}
    one = lambda i, c, t: f"NULL::{t}" if i > n else f"w{i}.{c}"
    return ", ".join(f"{one(i, *fields[f])} AS {f}{i}" for i in range(1, 6) for f in fields)


DIRTY = """
dirty AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN o % 3 = 0 THEN '1h' ELSE '1d' END AS "interval", CAST(l_shipdate AS TIMESTAMP) AS bar_ts, CASE WHEN o % 89 <> 0 THEN p END AS open,
    CASE WHEN o % 31 = 0 THEN p * 0.9 ELSE p * 1.01 END AS high, CASE WHEN o % 37 = 0 THEN p * 1.005 ELSE p * 0.99 END AS low, CASE WHEN o % 41 = 0 THEN -p WHEN o % 43 = 0 THEN p * 30 ELSE p END AS close,
    CASE WHEN o % 47 = 0 THEN -1.0 ELSE l_quantity END AS volume, l_returnflag AS source_category, o, l_linenumber AS l, {'a': o, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_shipdate, 'f': l_extendedprice} AS ord
    FROM (SELECT *, l_orderkey AS o, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS p FROM lineitem))"""
FAULTY = f"symbol, \"interval\", bar_ts, {as_is('close', 'volume')}, o, l"
MISSING = "(open IS NULL)"
BAD_PRICE = "least(open, high, low, close) <= 0"
BAD_OHLC = "CASE WHEN high < low THEN 'high_below_low' WHEN high < greatest(open, close) THEN 'high_below_open_close' WHEN low > least(open, close) THEN 'low_above_open_close' END"
CHECKED = f"""{DIRTY},
c1 AS (SELECT *, CASE WHEN {MISSING} THEN 'missing' WHEN bar_ts > {AS_OF} THEN 'datetime' END AS r1 FROM dirty),
c2 AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN row_number() OVER (PARTITION BY symbol, "interval", bar_ts, r1 IS NULL ORDER BY ord) > 1 THEN 'duplicate' WHEN {BAD_PRICE} THEN 'price' WHEN volume < 0 THEN 'volume' ELSE {BAD_OHLC} END AS r2 FROM c1),
c3 AS (SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN abs(close / lag(close) OVER (PARTITION BY symbol, "interval", r2 IS NULL ORDER BY bar_ts) - 1) > 10 THEN 'outlier' END AS r3 FROM c2),
c4 AS (SELECT *, CASE WHEN r3 IS NOT NULL THEN r3 WHEN count(*) OVER (PARTITION BY symbol, "interval", r3 IS NULL) < 50 THEN 'min_bars' END AS reason FROM c3)"""
SYMBOLS = "(SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)"
LOWS = f"""{BARS},
marked AS (SELECT symbol, bar_idx, low, min(low) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS least, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
lowest AS (SELECT symbol, arg_min(bar_idx, {{'a': low, 'b': bar_idx}}) AS start FROM bars GROUP BY symbol),
starts AS (SELECT symbol, bar_idx AS start FROM marked WHERE low = least AND bar_idx >= 5 AND bar_idx < n - 5 UNION SELECT symbol, start FROM lowest)"""
NEXT = f"""{SWINGS},
first AS (SELECT w.symbol, w.s, w.e AS e0, w.high AS v0, b.low AS l0 FROM waves w JOIN bars b ON b.symbol = w.symbol AND b.bar_idx = w.e WHERE w.up),
later AS (SELECT f.*, list({{'j': b.bar_idx, 'h': b.high}} ORDER BY b.bar_idx)[1:2] AS c FROM first f JOIN bars b ON b.symbol = f.symbol AND b.bar_idx > f.e0 AND b.high >= f.v0 GROUP BY ALL),
decided AS (SELECT *, c[1].h = v0 AND (v0 = l0 OR coalesce(c[2].h = v0, false)) AS stall, CASE WHEN v0 <> l0 AND c[1].h = v0 THEN c[2].j ELSE c[1].j END AS j FROM later),
next AS (SELECT d.symbol, d.s, CASE WHEN stall THEN e0 ELSE r.rise_end END AS e, CASE WHEN stall THEN v0 ELSE t.high END AS value, NOT stall AS progress
    FROM decided d JOIN runs r ON r.symbol = d.symbol AND r.bar_idx = d.j JOIN bars t ON t.symbol = d.symbol AND t.bar_idx = r.rise_end JOIN (SELECT symbol, max(bar_idx) AS last FROM bars GROUP BY symbol) m ON m.symbol = d.symbol WHERE stall OR r.rise_end < m.last)"""
KEY = "symbol, start, rule_name"


def quartile(col: str, p: float) -> str:
    v = f"list({col} ORDER BY {col})"
    at = f"((count(*) + 1) * {p})"
    return f"CASE WHEN count(*) < 4 THEN {'min' if p < 0.5 else 'max'}({col}) ELSE {v}[CAST(floor({at}) AS BIGINT)] + ({at} - floor({at})) * ({v}[CAST(least(floor({at}) + 1, count(*)) AS BIGINT)] - {v}[CAST(floor({at}) AS BIGINT)]) END"


def distribution(col: str, prefix: str = "") -> str:
    parts = {"min": f"min({col})", "max": f"max({col})", "mean": f"avg({col})", "median": f"median({col})", "stdev": f"coalesce(stddev_samp({col}), 0)", "q25": quartile(col, 0.25), "q75": quartile(col, 0.75)}
    return ", ".join(f"round({x}, 6) AS {prefix}{name}" for name, x in parts.items())


DAYS = "date_diff('day', CAST(date_start AS DATE), CAST(date_end AS DATE))"
TIER = "CASE WHEN ensemble_score >= 0.85 THEN 'excellent' WHEN ensemble_score >= 0.7 THEN 'good' WHEN ensemble_score >= 0.5 THEN 'fair' ELSE 'poor' END"
UP = [("w2_above_start", "w2.low > w1.low"), ("w3_not_shortest", "NOT (w3.length < w1.length AND w3.length < w5.length)"), ("w3_over_w1", "w3.high > w1.high"), ("w5_over_w3", "w5.high > w3.high"), ("w3_longer_than_w2", "w3.length > w2.length"), ("w4_above_w1", "w4.low > w1.high")]
DOWN = [("w2_below_start", "w2.high < w1.high"), UP[1], ("w3_under_w1", "w3.low < w1.low"), ("w5_under_w3", "w5.low < w3.low"), UP[4], ("w4_below_w1", "w4.high < w1.low")]
THREE = [("b_below_start", "w2.high < w1.high"), ("c_below_a", "w3.low < w1.low")]


def listed(rules: list[tuple[str, str]], holds: bool) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {'' if holds else 'NOT '}({x}) THEN '{n}' END" for n, x in rules) + "], lambda x: x IS NOT NULL)"


VALIDATED = f"""{PATTERNS},
validated AS (SELECT *, CASE WHEN len(violations) > 0 THEN 'invalid' ELSE 'valid' END AS verdict FROM (SELECT *, CASE rule_name WHEN 'impulse' THEN {listed(UP, False)} WHEN 'bearish_impulse' THEN {listed(DOWN, False)} ELSE {listed(THREE, False)} END AS violations,
    CASE rule_name WHEN 'impulse' THEN {listed(UP, True)} WHEN 'bearish_impulse' THEN {listed(DOWN, True)} ELSE {listed(THREE, True)} END AS good FROM patterns))"""
LONG = f"""{BARS},
stretch AS (SELECT b.symbol, bar_idx AS start, bar_idx + 23 AS fin, CASE WHEN bar_idx % 2 = 0 THEN 'impulse' ELSE 'Corrective' END AS rule_name, CASE WHEN bar_idx % 2 = 0 THEN 5 ELSE 3 END AS parts FROM bars b JOIN (SELECT symbol, max(bar_idx) AS last FROM bars GROUP BY symbol) m ON m.symbol = b.symbol WHERE bar_idx + 23 <= last),
segments AS (SELECT s.symbol, start, rule_name, CAST(part AS INTEGER) AS part, min(low) AS low, max(high) AS high FROM stretch s, unnest(range(1, parts + 1)) AS t(part) JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN start + (part - 1) * (24 // parts) AND least(fin, start + part * (24 // parts)) GROUP BY ALL)"""
WIDE = f"""{LONG},
wide AS (SELECT symbol, start, rule_name, {", ".join(f"max(CASE WHEN part = {i} THEN {c} END) AS {c}{i}" for i in range(1, 6) for c in ("low", "high"))} FROM segments GROUP BY ALL)"""


def margin(a: str, b: str) -> str:
    return f"100 * ({a} - {b}) / abs({b})"


FIVE = "rule_name <> 'Corrective'"
MARGINS = {"w2_margin": (FIVE, margin("low2", "low1")), "w4_margin": (FIVE, margin("low4", "high1")), "w3_margin": (FIVE, margin("high3", "high1")), "w5_margin": (FIVE, margin("high5", "high3")), "b_margin": (f"NOT ({FIVE})", margin("high1", "high2")), "c_margin": (f"NOT ({FIVE})", margin("low1", "low3"))}


def fib_quality(name: str, a: str, b: str, ideal: tuple[float, float], fair: tuple[float, float]) -> str:
    ratio = f"({a}.length / nullif({b}.length, 0))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {b}.length = 0 THEN 'unknown' WHEN {ratio} BETWEEN {ideal[0]} AND {ideal[1]} THEN 'ideal' WHEN {ratio} BETWEEN {fair[0]} AND {fair[1]} THEN 'acceptable' ELSE 'poor' END AS {name}_quality"


TRADES = f"""{PATTERNS},
entries AS (SELECT p.symbol, p.start, rule_name, fin AS entry_idx, date_end AS entry_ts, close AS entry_price FROM patterns p JOIN bars b ON b.symbol = p.symbol AND b.bar_idx = p.fin WHERE rule_name = 'impulse'),
held AS (SELECT e.*, b.bar_idx, b.bar_ts, b.close, CASE WHEN b.high >= entry_price * (1 + 0.1) THEN entry_price * (1 + 0.1) WHEN b.low <= entry_price * (1 - 0.05) THEN entry_price * (1 - 0.05) END AS hit FROM entries e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx > entry_idx AND b.bar_idx <= entry_idx + 20),
exits AS (SELECT symbol, rule_name, start, entry_ts, entry_price, coalesce(arg_min({{'t': bar_ts, 'p': hit}}, bar_idx) FILTER (hit IS NOT NULL), arg_max({{'t': bar_ts, 'p': close}}, bar_idx)) AS x FROM held GROUP BY ALL),
trades AS (SELECT symbol, rule_name, start, entry_ts AS entry_date, x.t AS exit_date, entry_price, x.p AS exit_price, 1000.0::DOUBLE AS position_size, 100 * (x.p / entry_price - 1) AS return_pct, 1000.0::DOUBLE * (x.p / entry_price - 1) AS profit_loss FROM exits)"""
SCORED_TRADES = TRADES.replace("entries AS (SELECT p.symbol,", "entries AS (SELECT p.symbol, p.ensemble_score,").replace("exits AS (SELECT symbol,", "exits AS (SELECT symbol, ensemble_score,").replace("trades AS (SELECT symbol,", "trades AS (SELECT symbol, ensemble_score,")
LOGGED = {"entry_price": 2, "exit_price": 2, "position_size": 2, "ensemble_score": 3, "return_pct": 2, "profit_loss": 2}


def fixed(col: str, n: int) -> str:
    """A number as text with n decimals, half up by its decimal digits; small negative ones keep their sign."""
    text = f"printf('%.{n}f', CAST(round(CAST(CAST({col} AS VARCHAR) AS DECIMAL(38, 20)), {n}) AS DOUBLE))"
    return f"CASE WHEN {col} < 0 AND {text} = '{0:.{n}f}' THEN '-{0:.{n}f}' ELSE {text} END"


def edges(max_skip: int, symbol: str = "n_name") -> str:
    """Monowaves of both directions with 0 to max_skip skips: the down side is the up side of mirrored prices."""
    return f"""{bars(symbol)},
px AS (SELECT symbol, true AS up, bar_idx AS i, low AS lo, high AS hi FROM bars UNION ALL SELECT symbol, false, bar_idx, -high, -low FROM bars),
runs0 AS (SELECT *, count(*) OVER (PARTITION BY symbol, up) AS n, sum(CASE WHEN hi > ph THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, up ORDER BY i) AS run FROM (SELECT *, lag(hi) OVER (PARTITION BY symbol, up ORDER BY i) AS ph FROM px)),
ahead AS (SELECT p.symbol, p.up, p.i, min(q.i) FILTER (q.hi >= p.hi) AS not_less, min(q.i) FILTER (q.hi > p.hi) AS greater, min(q.i) FILTER (q.hi >= p.lo) AS reach, min(q.i) FILTER (q.lo < p.lo) AS below
    FROM px p LEFT JOIN px q ON q.symbol = p.symbol AND q.up = p.up AND q.i > p.i GROUP BY ALL),
nx AS (SELECT r.*, max(r.i) OVER (PARTITION BY r.symbol, r.up, run) AS run_end, not_less, greater, reach, below FROM runs0 r JOIN ahead a ON a.symbol = r.symbol AND a.up = r.up AND a.i = r.i),
walked AS (
    SELECT a.symbol, a.up, a.i AS s, 0 AS skip, CASE WHEN b.hi > a.lo THEN b.run_end ELSE a.i END AS e, CASE WHEN b.hi > a.lo THEN t.hi ELSE a.lo END AS v, CASE WHEN b.hi > a.lo THEN b.run_end ELSE a.i END AS need
    FROM nx a LEFT JOIN nx b ON b.symbol = a.symbol AND b.up = a.up AND b.i = a.i + 1 LEFT JOIN nx t ON t.symbol = b.symbol AND t.up = b.up AND t.i = b.run_end
    UNION ALL
    SELECT symbol, up, s, skip + 1, CASE WHEN stall THEN e ELSE fin END, CASE WHEN stall THEN v ELSE top END, greatest(need, CASE WHEN stall THEN decided ELSE fin + 1 END)
    FROM (
        SELECT w.*, o.below, o.n, j.hi = w.v AND (w.e = w.s OR w.v = a.lo OR coalesce(k.hi = w.v, false)) AS stall, CASE WHEN w.e = w.s OR w.v = a.lo THEN j.i ELSE k.i END AS decided,
            CASE WHEN j.hi = w.v THEN k.run_end ELSE j.run_end END AS fin, t.hi AS top
        FROM walked w JOIN nx a ON a.symbol = w.symbol AND a.up = w.up AND a.i = w.e JOIN nx o ON o.symbol = w.symbol AND o.up = w.up AND o.i = w.s
        JOIN nx j ON j.symbol = w.symbol AND j.up = w.up AND j.i = CASE WHEN w.e = w.s THEN a.reach ELSE a.not_less END
        LEFT JOIN nx k ON k.symbol = w.symbol AND k.up = w.up AND k.i = CASE WHEN j.hi = w.v THEN j.not_less END
        LEFT JOIN nx t ON t.symbol = w.symbol AND t.up = w.up AND t.i = CASE WHEN j.hi = w.v THEN k.run_end ELSE j.run_end END
        WHERE w.skip < {max_skip}
    ) WHERE stall OR (fin + 1 < n AND (up OR below IS NULL OR below >= fin))
),
edges AS (SELECT w.symbol, w.up, w.s, w.skip, w.e, CASE WHEN w.up THEN o.lo ELSE -w.v END AS low, CASE WHEN w.up THEN w.v ELSE -o.lo END AS high, w.need AS need_idx, CASE WHEN a.hi > w.v THEN w.e ELSE coalesce(a.greater, a.n) END AS turn
    FROM walked w JOIN nx o ON o.symbol = w.symbol AND o.up = w.up AND o.i = w.s JOIN nx a ON a.symbol = w.symbol AND a.up = w.up AND a.i = w.e),
waves AS (SELECT symbol, up, s, skip, e, low, high, abs(high - low) AS length, e - s AS duration, CASE WHEN up THEN s ELSE e END AS low_idx, CASE WHEN up THEN e ELSE s END AS high_idx, need_idx, turn FROM edges)"""


def options(up_to: int, n: int, k: int = 300) -> str:
    names = "abcde"[:n]
    total = " + ".join(names)
    return f"(SELECT row_number() OVER (ORDER BY {total} DESC, {', '.join(names)}) AS rank, {', '.join(names)} FROM {', '.join(f'range({up_to}) AS x{c}({c})' for c in names)} QUALIFY rank <= {k})"


def skipping(dirs: list[bool], up_to: int) -> str:
    """Chains over the top options, with nulls for the waves that a family of three lacks."""
    n = len(dirs)
    joins = " ".join(f"JOIN waves w{i} ON w{i}.symbol = w1.symbol AND w{i}.s = w{i - 1}.e AND w{i}.up = {str(up).lower()}" for i, up in enumerate(dirs[1:], 2))
    on = " AND ".join(f"o.{c} = w{i}.skip" for i, c in enumerate("abcde"[:n], 1))
    cols = ", ".join(f"w{i}" if i <= n else "NULL" for i in range(1, 6))
    config, needs = "[" + ", ".join(f"w{i}.skip" for i in range(1, n + 1)) + "]", [f"w{i}.need_idx" for i in range(1, n + 1)]
    return f"SELECT w1.symbol AS symbol, w1.s AS start, rank, {config} AS config, {cols}, greatest({', '.join(needs)}) AS need, greatest({', '.join(needs[:-1])}) AS before FROM waves w1 {joins} JOIN {options(up_to, n)} o ON {on} WHERE w1.up = {str(dirs[0]).lower()}"


GUARD = "(w5 IS NULL OR (w4.e > w2.e AND w2.turn >= w4.e AND (w5.e = w4.e OR w4.turn >= w5.e)))"


def ruled(source: str, extra: str = "") -> str:
    """Candidates from a table of chains with their family (fam 0 to 2): rule, scores, end."""
    holds = lambda name: " AND ".join(f"({x})" for x in RULES[name])
    rule = f"CASE WHEN fam = 0 AND {holds('impulse')} THEN 'impulse' WHEN fam = 0 AND {holds('leading_diagonal')} THEN 'leading_diagonal' WHEN fam = 1 AND {holds('bearish_impulse')} THEN 'bearish_impulse' WHEN fam = 2 AND {holds('Corrective')} THEN 'Corrective' END"
    prices = ", ".join(f"w{i}.{c}" for i in range(1, 6) for c in ("low", "high"))
    return f"""SELECT *, greatest(0.0, least(1.0, fib_score * 0.5 + 1.0 * 0.3 + time_score * 0.1 + 0.95 * 0.1)) AS ensemble_score
    FROM (SELECT *, coalesce(w5.e, w3.e) AS fin, [{prices}] AS prices, CAST({FIB} AS DOUBLE) AS fib_score, CAST({TIME} AS DOUBLE) AS time_score FROM (SELECT *, {rule} AS rule_name FROM {source} WHERE {GUARD}{extra}) WHERE rule_name IS NOT NULL)"""


def found(up_to: int, symbol: str = "n_name") -> str:
    """Chains of all families and the candidates among them."""
    cols = "symbol, start, rank, config, w1, w2, w3, w4, w5, need, before"
    return f"""{edges(up_to - 1, symbol)},
all_chains({cols}, fam) AS MATERIALIZED (SELECT *, 0 FROM ({skipping(IMPULSE, up_to)}) UNION ALL SELECT *, 1 FROM ({skipping(BEARISH, up_to)}) UNION ALL SELECT *, 2 FROM ({skipping(CORRECTIVE, up_to)})),
cand AS ({ruled("all_chains")} QUALIFY row_number() OVER (PARTITION BY symbol, start, need, fam, prices ORDER BY rank) = 1)"""


SLIDING = "SELECT symbol, i AS start_row, least(104, n - i) AS window_len, i + least(104, n - i) - 1 AS last FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), unnest(range(0, n - 20 + 1, 8)) AS t(i)"
EVERY = SLIDING.replace(", 8))", ", 1))")


def scanned(up_to: int, windows: str, symbol: str = "n_name") -> str:
    """hits: the candidates of each window, those that its end cuts short among them."""
    cut_last = "{{'symbol': w.symbol, 'up': w.up, 's': w.s, 'skip': w.skip, 'e': last, 'low': CASE WHEN w.up THEN w.low ELSE low_last END, 'high': CASE WHEN w.up THEN high_last ELSE w.high END, 'length': abs(CASE WHEN w.up THEN high_last - w.low ELSE w.high - low_last END), 'duration': last - w.s, 'low_idx': CASE WHEN w.up THEN w.s ELSE last END, 'high_idx': CASE WHEN w.up THEN last ELSE w.s END, 'need_idx': last, 'turn': w.turn}}".replace("{{", "{").replace("}}", "}")
    short = lambda i: cut_last.replace("w.", f"w{i}.")
    pick = "symbol, start_row, window_len, last, start, extrema"
    return f"""{found(up_to, symbol)},
windows AS ({windows}),
moves AS (SELECT *, sum(CASE WHEN d * ld = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x, min(low) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS least_near
    FROM (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY bar_idx) AS ld FROM (SELECT symbol, bar_idx, low, high, sign(low - lag(low) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS d FROM bars))),
lows AS (SELECT symbol, bar_idx AS i FROM moves WHERE low = least_near),
nexts AS (SELECT a.symbol, a.i, min(b.i) AS then_i FROM lows a JOIN lows b ON b.symbol = a.symbol AND b.i >= a.i + 10 GROUP BY ALL),
taken AS (
    SELECT w.symbol, start_row, last, min(i) AS i FROM windows w JOIN lows l ON l.symbol = w.symbol AND i >= start_row + 5 AND i <= last - 5 GROUP BY ALL
    UNION ALL SELECT t.symbol, start_row, last, then_i FROM taken t JOIN nexts n ON n.symbol = t.symbol AND n.i = t.i WHERE then_i <= last - 5
),
lowest_of AS (SELECT w.symbol, start_row, last, arg_min(bar_idx, {{'a': low, 'b': bar_idx}}) AS i FROM windows w JOIN bars b ON b.symbol = w.symbol AND bar_idx BETWEEN start_row AND last GROUP BY ALL),
picked AS (SELECT symbol, start_row, last, i FROM taken UNION SELECT symbol, start_row, last, i FROM lowest_of),
numbered AS (SELECT b.*, l.i AS least_i, count(*) OVER w AS c, row_number() OVER (w ORDER BY b.i) AS nth FROM picked b JOIN lowest_of l ON l.symbol = b.symbol AND l.start_row = b.start_row AND l.last = b.last WINDOW w AS (PARTITION BY b.symbol, b.start_row, b.last)),
starts AS (SELECT w.*, s.i AS start, e.low AS low_last, e.high AS high_last, greatest(0, coalesce(e.x - f.x, 0)) AS extrema FROM numbered s JOIN windows w ON w.symbol = s.symbol AND w.start_row = s.start_row AND w.last = s.last
    JOIN moves e ON e.symbol = w.symbol AND e.bar_idx = w.last LEFT JOIN moves f ON f.symbol = w.symbol AND f.bar_idx = s.i + 1 WHERE c <= 10 OR nth <= 9 OR i = least_i),
met AS (SELECT c.* EXCLUDE (w3, w5), CASE WHEN fam = 2 THEN {short(3)} ELSE w3 END AS w3, CASE WHEN fam <> 2 THEN {short(5)} END AS w5, {pick.replace("symbol", "s.symbol AS of_symbol").replace(" start,", " s.start AS of_start,")}
    FROM starts s JOIN all_chains c ON c.symbol = s.symbol AND c.start = s.start WHERE before <= last AND config[-1] = 0 AND coalesce(c.w5.s, c.w3.s) < last AND coalesce(c.w5.e, c.w3.e) > last),
hits AS (SELECT s.symbol, start_row, window_len, s.start, extrema, rule_name, rank, config, fam, prices, fin, fib_score, ensemble_score, w1 FROM starts s JOIN cand c ON c.symbol = s.symbol AND c.start = s.start WHERE need <= last AND (fam > 0 OR extrema >= 4)
    UNION ALL SELECT symbol, start_row, window_len, start, extrema, rule_name, rank, config, fam, prices, fin, fib_score, ensemble_score, w1 FROM ({ruled("met")}) WHERE fam > 0 OR extrema >= 4)"""


BEST = "ensemble_score DESC, fin DESC"
ONE = f"SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY symbol, start_row ORDER BY {BEST}, start, fam, rank) = 1"
THREE = f"""SELECT *, CAST(row_number() OVER (PARTITION BY symbol, start_row ORDER BY {BEST}, start, fam, rank) AS INTEGER) AS nth FROM (
    SELECT * FROM (SELECT * FROM (SELECT * FROM (SELECT * FROM hits
        QUALIFY row_number() OVER (PARTITION BY symbol, start_row, start, fam, prices ORDER BY rank) = 1)
        QUALIFY row_number() OVER (PARTITION BY symbol, start_row, start, fam ORDER BY {BEST}, rank) <= 6)
        QUALIFY row_number() OVER (PARTITION BY symbol, start_row, start ORDER BY {BEST}, fam, rank) <= 3)
    QUALIFY row_number() OVER (PARTITION BY symbol, start_row, fam, prices ORDER BY start, {BEST}, rank) = 1
) QUALIFY nth <= 3"""


def ahead(up_to: int, symbol: str = "n_name", geometry: tuple[int, int, int] = (20, 104, 8)) -> str:
    shortest, longest, slide = geometry
    return f"""{scanned(up_to, EVERY.replace("104", str(longest)).replace("20 + 1", f"{shortest} + 1"), symbol)},
best AS MATERIALIZED ({ONE}),
sizes AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol),
steps AS (
    SELECT symbol, 0::BIGINT AS i FROM sizes WHERE n >= {shortest}
    UNION ALL SELECT t.symbol, coalesce(b.fin, t.i) + {slide} FROM steps t JOIN sizes z ON z.symbol = t.symbol LEFT JOIN best b ON b.symbol = t.symbol AND b.start_row = t.i WHERE z.n - (coalesce(b.fin, t.i) + {slide}) >= {shortest}
),
ahead_hits AS (SELECT b.* FROM steps t JOIN best b ON b.symbol = t.symbol AND b.start_row = t.i)"""


def recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


GEO = "(SELECT symbol, '1wk' AS \"interval\", CAST(count(*) AS INTEGER) AS n FROM bars GROUP BY symbol)"

ORACLE_SQL: dict[str, str] = {
    "s1_weekly_bars": of(BARS, f"SELECT {BAR} FROM bars"),
    "s5_normalize": "SELECT CAST(ts AS TIMESTAMP) AS bar_ts, CAST(user_id AS VARCHAR) AS symbol, value AS open, value AS high, value AS low, value AS close FROM events",
    "s6_select_symbols": of(BARS, f"SELECT {BAR} FROM bars WHERE symbol IN ('NATION_3', 'NATION_7', 'NATION_12')"),
    "s6_select_symbol_table": of(BARS, f"SELECT {BAR} FROM bars WHERE symbol IN (SELECT n_name FROM nation WHERE n_regionkey = 3)"),
    "s7_last_days": of(BARS, f"SELECT {BAR} FROM bars WHERE bar_ts >= {AS_OF} - INTERVAL 90 DAY AND bar_ts <= {AS_OF}"),
    "s11_trade_log": of(SCORED_TRADES, f"""SELECT symbol, CAST(CAST(entry_date AS DATE) AS VARCHAR) AS entry_date, CAST(CAST(exit_date AS DATE) AS VARCHAR) AS exit_date, {", ".join(f"{fixed(c, n)} AS {c}" for c, n in LOGGED.items())}, rule_name FROM trades"""),
    "s13_pending": of(BARS, "SELECT DISTINCT symbol, \"interval\" FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars WHERE volume >= 20)"),
    "s14_dataset_stats": "SELECT event_type AS source_category, 'tick' AS \"interval\", count(*) AS n, count(DISTINCT user_id) AS symbols FROM events GROUP BY event_type",
    "c1_drop_missing": of(DIRTY, f"SELECT {FAULTY} FROM dirty WHERE NOT {MISSING}"),
    "c2_valid_datetime": of(DIRTY, f"SELECT {FAULTY} FROM dirty WHERE bar_ts <= {AS_OF}"),
    "c3_dedup_bars": of(DIRTY, f"SELECT {FAULTY} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, \"interval\", bar_ts ORDER BY ord) AS n FROM dirty) WHERE n = 1"),
    "c4_valid_prices": of(DIRTY, f"SELECT {FAULTY} FROM dirty WHERE NOT {BAD_PRICE}"),
    "c5_valid_volume": of(DIRTY, f"SELECT {FAULTY} FROM dirty WHERE volume >= 0"),
    "c6_valid_ohlc": of(DIRTY, f"SELECT {FAULTY} FROM dirty WHERE {BAD_OHLC} IS NULL"),
    "c7_drop_outliers": of(BARS, f"SELECT {BAR} FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) AS before FROM bars) WHERE before IS NULL OR abs(close / before - 1) <= 10"),
    "c8_min_bars": of(DIRTY, f"SELECT {FAULTY} FROM (SELECT *, count(*) OVER (PARTITION BY symbol, \"interval\") AS n FROM dirty) WHERE n >= 200"),
    "c9_validate_bars": of(CHECKED, "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM c4 GROUP BY 1"),
    "c9_clean_bars": of(CHECKED, f"SELECT {FAULTY} FROM c4 WHERE reason IS NULL"),
    "c10_quality_report": of(DIRTY, f"""SELECT "interval", count(*) AS n, count(DISTINCT symbol) AS symbols, round(100 * avg(CASE WHEN {MISSING} THEN 1 ELSE 0 END), 4) AS missing_pct, round(100 * avg(CASE WHEN open IS NOT NULL AND {BAD_OHLC} IS NULL THEN 1 ELSE 0 END), 4) AS valid_ohlc_pct,
        round(100 * avg(CASE WHEN least(open, high, low, close) > 0 THEN 1 ELSE 0 END), 4) AS positive_price_pct, round(100 * avg(CASE WHEN volume >= 0 THEN 1 ELSE 0 END), 4) AS valid_volume_pct, round(count(*) / count(DISTINCT symbol), 4) AS bars_per_symbol, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts FROM dirty GROUP BY 1"""),
    "c11_filter_patterns": of(PATTERNS, f"SELECT {KEY}, {r('ensemble_score')} FROM patterns WHERE ensemble_score >= 0.6 AND rule_name = 'impulse'"),
    "c12_cap_history": of(DIRTY, f"SELECT {FAULTY} FROM dirty WHERE \"interval\" <> '1h' OR bar_ts >= {AS_OF} - INTERVAL 730 DAY"),
    "w1_resample_4h": f"""SELECT CAST(user_id AS VARCHAR) AS symbol, '4h' AS "interval", time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS bar_ts, arg_min(value, {{'a': ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {{'a': ts, 'b': event_id}}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3""",
    "w2_index_bars": of(bars("CAST(l_suppkey AS VARCHAR)"), "SELECT symbol, bar_ts, bar_idx FROM bars"),
    "w3_window_config": of(BARS, "SELECT DISTINCT symbol, \"interval\", 20 AS min_len, 104 AS max_len, 4 AS slide FROM bars"),
    "w4_sliding_windows": of(BARS, f"SELECT symbol, \"interval\", CAST(i AS INTEGER) AS start_row, CAST(least(104, n - i) AS INTEGER) AS window_len FROM {GEO}, unnest(range(0, n - 20 + 1, 8)) AS t(i)"),
    "w5_adaptive_windows": of(BARS, f"SELECT symbol, \"interval\", CAST(i AS INTEGER) AS start_row, CAST(k AS INTEGER) AS window_len FROM {GEO}, unnest(range(0, n - 20 + 1, 8)) AS t(i), unnest(range(20, least(104, n - i) + 1, 7)) AS u(k)"),
    "w6_local_lows": of(LOWS, "SELECT symbol, start FROM starts"),
    "w7_select_starts": of(LOWS, "SELECT symbol, start FROM (SELECT s.*, row_number() OVER (PARTITION BY s.symbol ORDER BY s.start) AS n, l.start AS least, count(*) OVER (PARTITION BY s.symbol) AS all_n FROM starts s JOIN lowest l ON l.symbol = s.symbol) WHERE all_n <= 8 OR n <= 7 OR start = least"),
    "w6_spaced_lows": recursive(f"""{LOWS},
        low AS (SELECT symbol, bar_idx AS i FROM marked WHERE low = least AND bar_idx >= 5 AND bar_idx < n - 5),
        then_low AS (SELECT a.symbol, a.i, min(b.i) AS j FROM low a JOIN low b ON b.symbol = a.symbol AND b.i >= a.i + 10 GROUP BY ALL),
        taken AS (SELECT symbol, min(i) AS i FROM low GROUP BY symbol UNION ALL SELECT t.symbol, j FROM taken t JOIN then_low n ON n.symbol = t.symbol AND n.i = t.i)""",
        "SELECT symbol, start, bool_or(lowest) AS lowest FROM (SELECT symbol, i AS start, false AS lowest FROM taken UNION ALL SELECT symbol, start, true FROM lowest) GROUP BY ALL"),
    "w8_count_extrema": of(BARS, "SELECT symbol, CAST(sum(CASE WHEN d * lag_d = -1 THEN 1 ELSE 0 END) AS BIGINT) AS extrema FROM (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY bar_idx) AS lag_d FROM (SELECT symbol, bar_idx, sign(low - lag(low) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS d FROM bars)) GROUP BY symbol"),
    "w9_base_score": of(BARS, "SELECT symbol, bar_idx, round(0.4 * stddev_pop(low) OVER w + 0.3 * (max(high) OVER w - min(low) OVER w) / (low + 1e-9), 4) AS base_score FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"),
    "w10_absolute_low": of(BARS, "SELECT symbol, arg_min(bar_idx, {'a': low, 'b': bar_idx}) AS bar_idx, min(low) AS low FROM bars GROUP BY symbol"),
    "m1_first_swing_up": of(SWINGS, "SELECT symbol, s, e, high AS value FROM edges WHERE up"),
    "m2_first_swing_down": of(SWINGS, "SELECT symbol, s, e, low AS value FROM edges WHERE NOT up"),
    "m3_next_swing": of(NEXT, "SELECT symbol, s, e, value, progress FROM next"),
    "m4_next_swing_down": of(bars().replace("bars AS", "true_bars AS") + ",\nbars AS (SELECT * REPLACE (-high AS low, -low AS high) FROM true_bars)" + NEXT[len(BARS):], "SELECT symbol, s, e, -value AS value, progress FROM next"),
    "m5_monowaves_one_skip": recursive(edges(1), "SELECT symbol, s, up, skip, e, low, high, need_idx FROM edges"),
    "m6_monowaves": recursive(edges(4), "SELECT symbol, s, up, skip, e, low, high, need_idx, turn FROM edges"),
    "m8_roll_up": of(PATTERNS, f"SELECT {KEY}, start AS idx_start, fin AS idx_end, low, high, abs(high - low) AS length, fin - start AS duration, 2 AS degree FROM (SELECT *, CASE WHEN w5 IS NULL THEN w3.low ELSE w1.low END AS low, CASE WHEN w5 IS NULL THEN w1.high ELSE w5.high END AS high FROM patterns)"),
    "p3_impulse_chains": of(SWINGS, f"SELECT symbol, start, {waves(5)} FROM ({chain(IMPULSE, 'i')}) c WHERE w2.low <= (SELECT min(low) FROM bars b WHERE b.symbol = c.symbol AND bar_idx >= w2.e AND bar_idx < w4.e) AND coalesce(w4.low <= (SELECT min(low) FROM bars b WHERE b.symbol = c.symbol AND bar_idx >= w4.e AND bar_idx < w5.e), true)"),
    "p4_bearish_chains": of(SWINGS, f"SELECT symbol, start, {waves(5)} FROM ({chain(BEARISH, 'i')}) c WHERE w2.high >= (SELECT max(high) FROM bars b WHERE b.symbol = c.symbol AND bar_idx >= w2.e AND bar_idx < w4.e) AND coalesce(w4.high >= (SELECT max(high) FROM bars b WHERE b.symbol = c.symbol AND bar_idx >= w4.e AND bar_idx < w5.e), true)"),
    "p5_corrective_chains": of(SWINGS, f"SELECT symbol, start, {waves(3)} FROM ({chain(CORRECTIVE, 'c')})"),
    "p6_td_chains": of(SWINGS, f"SELECT symbol, start, {waves(2)} FROM ({chain(TD, 't')})"),
    "p7_cycles": of(SWINGS, f"SELECT i.symbol, i.start, {', '.join(f'i.w{n}.length AS l{n}' for n in range(1, 6))}, {', '.join(f'c.w{n}.length AS l{n + 5}' for n in range(1, 4))} FROM ({chain(IMPULSE, 'i')}) i JOIN ({chain(CORRECTIVE, 'c')}) c ON c.symbol = i.symbol AND c.start = i.fin"),
    "p9_rank_patterns": of(PATTERNS, f"SELECT {KEY}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ensemble_score DESC, fin DESC, rule_name, CASE WHEN w5 IS NULL THEN 3 ELSE 5 END, start) AS INTEGER) AS nth, {r('ensemble_score')} FROM patterns QUALIFY nth <= 3"),
    "p10_scan_candidates": recursive(found(3), "SELECT symbol, start, rule_name, rank, array_to_string(config, ',') AS config, fin, need AS need_idx, round(fib_score, 6) AS fib_score, round(ensemble_score, 6) AS ensemble_score FROM cand"),
    "p11_best_per_window": recursive(scanned(3, SLIDING), f"SELECT symbol, start_row, window_len, rule_name, w1.s AS idx_start, fin AS idx_end, round(ensemble_score, 6) AS ensemble_score, round(fib_score, 6) AS fib_score FROM ({ONE})"),
    "p12_skip_ahead_scan": recursive(ahead(3), "SELECT symbol, start_row, window_len, start, rule_name, array_to_string(config, ',') AS config, round(ensemble_score, 6) AS ensemble_score, fin, NULL::VARCHAR AS error FROM ahead_hits"),
    "p13_supplier_scan": recursive(ahead(2, "CAST(l_suppkey AS VARCHAR)"), "SELECT symbol, '1wk' AS \"interval\", start_row, rule_name, array_to_string(config, ',') AS config, fin, NULL::VARCHAR AS error FROM ahead_hits UNION ALL SELECT DISTINCT symbol, '1mo', NULL::BIGINT, NULL, NULL, NULL::INTEGER, 'KeyError(''1mo'')' FROM bars WHERE CAST(symbol AS INTEGER) % 10 = 0"),
    "p14_scan_grid": recursive(scanned(2, SLIDING), f"SELECT symbol, start_row, window_len, start, rule_name, array_to_string(config, ',') AS config, round(ensemble_score, 6) AS ensemble_score, nth FROM ({THREE})"),
    "p15_dedup_patterns": of(PATTERNS, f"SELECT {KEY}, {r('ensemble_score')} FROM (SELECT *, row_number() OVER (PARTITION BY rule_name, round(w1.low, 2), round(w3.high, 2), coalesce(round(w5.high, 2), 0) ORDER BY ensemble_score DESC, symbol, start) AS n FROM patterns) WHERE n = 1"),
    "p16_hybrid_summary": of(PATTERNS, "SELECT \"interval\", rule_name, count(*) AS n FROM (SELECT '1wk' AS \"interval\", rule_name FROM patterns) GROUP BY ROLLUP (\"interval\", rule_name)"),
    "p18_polyline": of(PATTERNS, f"""SELECT {KEY}, nth, v.idx, v.value, v.label, v.ratio FROM (
        SELECT {KEY}, [{{'idx': w1.s, 'value': CASE WHEN w1.low_idx = w1.s THEN w1.low ELSE w1.high END, 'label': '', 'ratio': NULL::DOUBLE}}, {", ".join(f"CASE WHEN w{i} IS NOT NULL THEN {{'idx': w{i}.e, 'value': CASE WHEN w{i}.high_idx > w{i}.low_idx THEN w{i}.high ELSE w{i}.low END, 'label': CASE WHEN w5 IS NULL THEN '{'ABC'[i - 1] if i < 4 else ''}' ELSE '{i}' END, 'ratio': {f"CASE WHEN {'w5 IS NULL' if i == 2 else 'w5 IS NOT NULL'} OR {'true' if i == 2 else 'false'} THEN CASE WHEN w1.length > 0 THEN round(w{i}.length / w1.length, 3) END END" if i in (2, 3) else 'NULL::DOUBLE'}}} END" for i in range(1, 6))}] AS all_v FROM patterns
    ), unnest(range(0, 6)) AS t(nth), (SELECT all_v[nth + 1] AS v) WHERE v IS NOT NULL"""),
    "p17_reconstruct": of(PATTERNS, f"SELECT {KEY}, true AS found, passes OR (rule_name = 'impulse' AND false) AS passes FROM patterns"),
    "r1_impulse": of(PATTERNS, f"SELECT symbol, start, {holding('impulse')} = {len(RULES['impulse'])} AS passes, {holding('impulse')} AS holding FROM patterns WHERE rule_name = 'impulse'"),
    "r2_bearish_impulse": of(PATTERNS, f"SELECT symbol, start, {holding('bearish_impulse')} = {len(RULES['bearish_impulse'])} AS passes, {holding('bearish_impulse')} AS holding FROM patterns WHERE rule_name = 'bearish_impulse'"),
    "r3_correction": of(PATTERNS, f"SELECT symbol, start, {holding('Corrective')} = {len(RULES['Corrective'])} AS passes, {holding('Corrective')} AS holding FROM patterns WHERE rule_name = 'Corrective'"),
    "r4_td": of(PATTERNS, f"SELECT symbol, start, {holding('td')} = {len(RULES['td'])} AS passes, {holding('td')} AS holding FROM patterns WHERE rule_name = 'impulse'"),
    "r5_leading_diagonal": of(PATTERNS, f"SELECT symbol, start, {holding('leading_diagonal')} = {len(RULES['leading_diagonal'])} AS passes, {holding('leading_diagonal')} AS holding FROM patterns WHERE rule_name = 'impulse'"),
    "r6_first_violation": of(PATTERNS, "SELECT symbol, start, CASE " + " ".join(f"WHEN NOT ({x}) THEN '{n}'" for n, x in zip(CORRECTION_NAMES, RULES["Corrective"], strict=True)) + " END AS violation FROM patterns WHERE rule_name = 'Corrective'"),
    "r7_score_rule": of(PATTERNS, "SELECT symbol, start, round((" + " + ".join(f"least(1.0, CASE WHEN {x} THEN 1.0 ELSE 0.0 END + {'CASE WHEN w1.length > 0 AND w2.length > 0 THEN greatest(0.0, 0.3 - abs(w1.length - w2.length) / greatest(w1.length, w2.length)) ELSE 0.0 END' if n == 'a_longer_than_b' else '0.0'})" for n, x in zip(CORRECTION_NAMES, RULES["Corrective"], strict=True)) + ") / 9, 6) AS score FROM patterns WHERE rule_name = 'Corrective'"),
    "e1_e8_scores": of(PATTERNS, f"SELECT {KEY}, round(CAST({fib_distance('(w2.length / w1.length)')} AS DOUBLE), 6) AS fib_distance, CAST({RETRACE} AS DOUBLE) AS retracement, CAST({EXTEND} AS DOUBLE) AS extension, CASE WHEN w5 IS NOT NULL THEN round(CAST({FIFTH} AS DOUBLE), 6) END AS wave5, round(CAST(CASE WHEN start <= 0 THEN 1.0 WHEN start <= 10 THEN 1 - 0.05 * start ELSE greatest(0.3, 0.5 - 0.01 * (start - 10)) END AS DOUBLE), 6) AS complexity_at_start, round(fib_score, 6) AS fib, round(time_score, 6) AS time, round(rule_score, 6) AS rule, round(ensemble_score, 6) AS ensemble FROM patterns"),
    "a1_score_distribution": of(PATTERNS, f"SELECT rule_name, count(*) AS n, {distribution('ensemble_score')} FROM patterns GROUP BY rule_name"),
    "a2_score_stats": of(PATTERNS, "SELECT round(avg(ensemble_score), 6) AS mean, round(median(ensemble_score), 6) AS median, round(stddev_pop(ensemble_score), 6) AS std, round(min(ensemble_score), 6) AS min, round(max(ensemble_score), 6) AS max, round(quantile_cont(ensemble_score, 0.25), 6) AS q25, round(quantile_cont(ensemble_score, 0.75), 6) AS q75 FROM patterns"),
    "a3_quality_tiers": of(PATTERNS, f"SELECT tier, coalesce(n, 0) AS n, round(coalesce(100 * n / sum(n) OVER (), 0), 4) AS pct FROM (SELECT unnest(['excellent', 'good', 'fair', 'poor']) AS tier) LEFT JOIN (SELECT {TIER} AS tier, count(*) AS n FROM patterns GROUP BY 1) USING (tier)"),
    "a4_type_counts": of(PATTERNS, "SELECT lower(rule_name) AS rule, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM patterns GROUP BY 1"),
    "a5_by_symbol": of(PATTERNS, f"SELECT symbol, count(*) AS n, {distribution('ensemble_score')}, {distribution('fib_score', 'fib_')}, count(*) FILTER (rule_name = 'impulse') AS impulses FROM patterns GROUP BY symbol"),
    "a6_symbol_coverage": of(PATTERNS, "SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max FROM (SELECT symbol, count(*) AS n FROM patterns GROUP BY symbol)"),
    "a6_extreme_symbols": of(f"{PATTERNS}, per AS (SELECT symbol, count(*) AS n FROM patterns GROUP BY symbol)", "(SELECT symbol, n, 'top' AS side FROM per ORDER BY n DESC, symbol LIMIT 10) UNION ALL (SELECT symbol, n, 'bottom' FROM per ORDER BY n, symbol LIMIT 10)"),
    "a8_temporal_stats": of(PATTERNS, f"SELECT CAST(year(date_start) AS INTEGER) AS year, count(*) AS n, round(avg({DAYS}), 6) AS mean_days, round(median({DAYS}), 6) AS median_days, CAST(min({DAYS}) AS INTEGER) AS min_days, CAST(max({DAYS}) AS INTEGER) AS max_days FROM patterns GROUP BY 1"),
    "a9_scores_by_type": of(PATTERNS, "SELECT CASE WHEN rule_name = 'Corrective' THEN 'corrective' ELSE 'impulse' END AS family, count(*) AS n, round(avg(ensemble_score), 6) AS mean, round(median(ensemble_score), 6) AS median FROM patterns GROUP BY 1"),
    "a10_basic_stats": of(PATTERNS, "SELECT count(*) AS patterns, count(DISTINCT symbol) AS symbols FROM patterns"),
    "a11_run_stats": of(PATTERNS, "SELECT count(*) AS total, count(n) AS found, CAST(coalesce(sum(n), 0) AS BIGINT) AS patterns, round(avg(coalesce(n, 0)), 6) AS per_symbol, round(avg(best), 6) AS mean_best FROM (SELECT DISTINCT n_name AS symbol FROM nation) LEFT JOIN (SELECT symbol, count(*) AS n, max(ensemble_score) AS best FROM patterns GROUP BY symbol) USING (symbol)"),
    "v1_validate_patterns": of(VALIDATED, f"SELECT {KEY}, verdict, array_to_string(list_sort(violations), ',') AS violations, CAST(len(good) AS INTEGER) AS n_passes FROM validated"),
    "v2_validation_summary": of(VALIDATED, "SELECT lower(rule_name) AS rule, verdict, count(*) AS n FROM validated GROUP BY 1, 2"),
    "v2_violation_counts": of(VALIDATED, "SELECT violation, count(*) AS n FROM validated, unnest(violations) AS t(violation) GROUP BY 1 ORDER BY n DESC, violation LIMIT 10"),
    "v2_violation_samples": of(VALIDATED, f"SELECT violation, {KEY}, CAST(row_number() OVER (PARTITION BY violation ORDER BY symbol, start, rule_name) AS INTEGER) AS nth FROM validated, unnest(violations) AS t(violation) QUALIFY nth <= 3"),
    "v2_grade": of(VALIDATED, "SELECT n, round(s, 6) AS valid_share, CASE WHEN s >= 0.95 THEN 'EXCELLENT' WHEN s >= 0.85 THEN 'GOOD' WHEN s >= 0.7 THEN 'FAIR' ELSE 'POOR' END AS grade FROM (SELECT count(*) AS n, avg(CASE WHEN verdict = 'valid' THEN 1 ELSE 0 END) AS s FROM validated)"),
    "v3_segment_waves": of(LONG, f"SELECT {KEY}, part, low, high FROM segments"),
    "v4_rule_margins": of(f"{WIDE}, m AS (SELECT *, {', '.join(f'CASE WHEN {test} THEN {x} END AS {n}' for n, (test, x) in MARGINS.items())} FROM wide)", f"SELECT {KEY}, {r(*MARGINS, n=4)}, coalesce(CASE WHEN {FIVE} THEN w2_margin > 0 AND w4_margin > 0 AND w3_margin > 0 AND w5_margin > 0 AND NOT (high3 - low3 < high1 - low1 AND high3 - low3 < high5 - low5) ELSE b_margin > 0 AND c_margin > 0 END, false) AS is_valid FROM m"),
    "v5_fib_quality": of(PATTERNS, f"SELECT {KEY}, {fib_quality('w2_w1', 'w2', 'w1', (0.382, 0.786), (0.236, 0.886))}, {fib_quality('w3_w1', 'w3', 'w1', (1.618, 2.618), (1.0, 4.236))}, {fib_quality('w4_w3', 'w4', 'w3', (0.236, 0.5), (0.146, 0.618))} FROM patterns"),
    "v6_validity_report": of(PATTERNS, "SELECT lower(rule_name) AS rule, count(*) AS n, count(*) FILTER (passes) AS n_valid, round(100 * avg(CASE WHEN passes THEN 1 ELSE 0 END), 6) AS valid_pct, round(avg(ensemble_score) FILTER (passes), 6) AS mean_valid, round(avg(ensemble_score) FILTER (NOT passes), 6) AS mean_invalid, CASE WHEN avg(CASE WHEN passes THEN 1 ELSE 0 END) >= 0.8 THEN 'GOOD' WHEN avg(CASE WHEN passes THEN 1 ELSE 0 END) >= 0.6 THEN 'FAIR' ELSE 'POOR' END AS grade FROM patterns GROUP BY 1"),
    "v7_split_validity": of(PATTERNS, "SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, 'valid' AS side FROM patterns WHERE passes UNION ALL SELECT count(*), count(DISTINCT symbol), 'invalid' FROM patterns WHERE NOT passes"),
    "v8_completeness": of(PATTERNS, "SELECT field, count(*) FILTER (gone) AS nulls, round(100.0 * count(*) FILTER (gone) / count(*), 4) AS pct FROM (SELECT unnest([{'field': 'symbol', 'gone': symbol IS NULL}, {'field': 'start', 'gone': start IS NULL}, {'field': 'fifth', 'gone': w5 IS NULL}, {'field': 'late', 'gone': NOT start > 100}, {'field': 'ensemble_score', 'gone': ensemble_score IS NULL}], recursive := true) FROM patterns) GROUP BY field"),
    "v9_score_anomalies": of(PATTERNS, f"SELECT stddev_samp(ensemble_score) < 0.01 AS low_spread, avg(CASE WHEN ensemble_score = first THEN 1 ELSE 0 END) > 0.5 AS mostly_one_score, avg(CASE WHEN ensemble_score >= 0.85 THEN 1 ELSE 0 END) > 0.9 AS mostly_excellent, avg(CASE WHEN ensemble_score < 0.5 THEN 1 ELSE 0 END) > 0.5 AS mostly_poor FROM patterns, (SELECT ensemble_score AS first FROM patterns ORDER BY {KEY} LIMIT 1)"),
    "v10_temporal_coverage": of(PATTERNS, f"SELECT min(date_start) AS first, max(date_end) AS last, count(*) FILTER (date_end > {AS_OF}) AS future, count(*) FILTER ({DAYS} < 7) AS under_week, count(*) FILTER ({DAYS} > 730) AS over_two_years FROM patterns"),
    "v11_diversity": of(PATTERNS, "SELECT round(share, 6) AS top_share, share > 0.95 AS dominated, over_represented FROM (SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM patterns GROUP BY rule_name)), (SELECT count(*) FILTER (k > l) AS over_represented FROM (SELECT k, avg(k) OVER () + 2 * stddev_samp(k) OVER () AS l FROM (SELECT count(*) AS k FROM patterns GROUP BY symbol)))"),
    "v12_sanity": of(PATTERNS, "SELECT n, n - (SELECT count(*) FROM (SELECT DISTINCT symbol, start FROM patterns)) AS repeated, outliers, scores_redundant, CASE WHEN n < 30 THEN 'too small' WHEN n < 100 THEN 'small' WHEN n < 1000 THEN 'adequate' ELSE 'large' END AS sample_size FROM (SELECT count(*) AS n, count(*) FILTER (ensemble_score < q1 - 1.5 * (q3 - q1) OR ensemble_score > q3 + 1.5 * (q3 - q1)) AS outliers, coalesce(corr(ensemble_score, fib_score), 0) > 0.99 AS scores_redundant FROM patterns, (SELECT quantile_cont(ensemble_score, 0.25) AS q1, quantile_cont(ensemble_score, 0.75) AS q3 FROM patterns))"),
    "b1_asof_price": of(BARS, "SELECT e.symbol, e.ts, coalesce(arg_min(bar_idx, bar_ts) FILTER (bar_ts >= e.ts), max(bar_idx)) AS entry_idx, coalesce(min(bar_ts) FILTER (bar_ts >= e.ts), max(bar_ts)) AS entry_ts, coalesce(arg_min(close, bar_ts) FILTER (bar_ts >= e.ts), arg_max(close, bar_ts)) AS entry_price FROM (SELECT n_name AS symbol, unnest([TIMESTAMP '1990-01-01 00:00:00', TIMESTAMP '1995-03-15 12:00:00', TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '2030-01-01 00:00:00']) AS ts FROM nation) e JOIN bars b ON b.symbol = e.symbol GROUP BY e.symbol, e.ts"),
    "b2_simulate_trades": of(TRADES, f"SELECT {KEY}, entry_date, exit_date, entry_price, exit_price, position_size, return_pct, profit_loss FROM trades"),
    "b3_backtest_metrics": of(TRADES, """SELECT count(*) AS trades, count(*) FILTER (profit_loss > 0) AS wins, count(*) FILTER (profit_loss <= 0) AS losses, round(100 * avg(CASE WHEN profit_loss > 0 THEN 1 ELSE 0 END), 4) AS win_rate, round(sum(return_pct), 4) AS total_return, round(avg(return_pct), 4) AS mean_return, round(median(return_pct), 4) AS median_return, round(max(return_pct), 4) AS max_return, round(min(return_pct), 4) AS min_return,
        round(sum(profit_loss) FILTER (profit_loss > 0) / -sum(profit_loss) FILTER (profit_loss < 0), 4) AS profit_factor, round(sum(profit_loss) FILTER (profit_loss > 0), 4) AS gross_profit, round(-sum(profit_loss) FILTER (profit_loss < 0), 4) AS gross_loss, round(avg(date_diff('day', CAST(entry_date AS DATE), CAST(exit_date AS DATE))), 4) AS mean_days FROM trades"""),
    "b4_sharpe": of(TRADES, "SELECT round(sqrt(252) * (avg(return_pct / 100) - 0.02 / 252) / stddev_pop(return_pct / 100), 4) AS sharpe FROM trades"),
    "b5_max_drawdown": of(TRADES, "SELECT round(max((greatest(peak, 1000) - equity) / greatest(peak, 1000)), 4) AS max_drawdown FROM (SELECT *, max(equity) OVER (ORDER BY symbol, start, rule_name ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, 1000 + sum(profit_loss) OVER (ORDER BY symbol, start, rule_name ROWS UNBOUNDED PRECEDING) AS equity FROM trades))"),
    "b6_top_trades": of(TRADES, f"(SELECT 'best' AS side, {KEY}, {r('return_pct', n=4)} FROM trades ORDER BY trades.return_pct DESC, symbol, rule_name, start LIMIT 5) UNION ALL (SELECT 'worst', {KEY}, {r('return_pct', n=4)} FROM trades ORDER BY trades.return_pct, symbol, rule_name, start LIMIT 5)"),
    "b7_price_ranges": of(PATTERNS, "SELECT symbol, min(CAST(date_start AS DATE)) AS first_day, CAST(max(CAST(date_end AS DATE)) + 50 AS DATE) AS last_day FROM patterns GROUP BY symbol"),
}
ORACLE_SQL["v13_quality_verdict"] = f"""SELECT count(*) AS issues, CASE WHEN count(*) = 0 THEN 'EXCELLENT' WHEN count(*) <= 3 THEN 'GOOD' WHEN count(*) <= 10 THEN 'FAIR' ELSE 'POOR' END AS verdict, count(*) FILTER (regexp_matches(lower(issue), 'leakage|duplicate|too small')) AS critical FROM (
    SELECT 'Missing ' || field AS issue FROM ({ORACLE_SQL["v8_completeness"]}) WHERE nulls > 0
    UNION ALL SELECT unnest([CASE WHEN low_spread THEN 'a' END, CASE WHEN mostly_one_score THEN 'b' END, CASE WHEN mostly_excellent THEN 'c' END, CASE WHEN mostly_poor THEN 'd' END]) FROM ({ORACLE_SQL["v9_score_anomalies"]})
    UNION ALL SELECT unnest([CASE WHEN future > 0 THEN 'leakage' END, CASE WHEN under_week > 0 THEN 'e' END, CASE WHEN over_two_years > 0 THEN 'f' END]) FROM ({ORACLE_SQL["v10_temporal_coverage"]})
    UNION ALL SELECT unnest([CASE WHEN dominated THEN 'g' END, CASE WHEN over_represented > 0 THEN 'h' END]) FROM ({ORACLE_SQL["v11_diversity"]})
    UNION ALL SELECT unnest([CASE WHEN repeated > 0 THEN 'duplicate' END, CASE WHEN scores_redundant THEN 'i' END, CASE WHEN n < 100 THEN 'too small' WHEN n < 1000 THEN 'j' END]) FROM ({ORACLE_SQL["v12_sanity"]})
) WHERE issue IS NOT NULL"""
ORACLE_SQL["m4_next_swing_down_blocks"], ORACLE_SQL["m6_monowaves_blocks"] = ORACLE_SQL["m4_next_swing_down"], ORACLE_SQL["m6_monowaves"]
GROWING = SLIDING.replace("least(104, n - i) AS window_len, i + least(104, n - i) - 1 AS last", "len AS window_len, i + len - 1 AS last") + ", unnest(range(20, least(104, n - i) + 1, 7)) AS u(len)"
BINS = {"1h": "time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')", "4h": "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')", "1d": "CAST(date_trunc('day', ts) AS TIMESTAMP)", "1wk": "CAST(date_trunc('week', ts) AS TIMESTAMP)"}
FRAMES = {"1h": (40, 200, 20), "4h": (40, 200, 20), "1d": (40, 200, 10), "1wk": (20, 104, 4)}


def degree_chains(table: str) -> str:
    """The patterns over a table of waves of any degree."""
    parts = []
    for fam, dirs in enumerate((IMPULSE, BEARISH, CORRECTIVE)):
        joins = " ".join(f"JOIN {table} w{i} ON w{i}.symbol = w1.symbol AND w{i}.s = w{i - 1}.e AND w{i}.up = {str(up).lower()}" for i, up in enumerate(dirs[1:], 2))
        cols = ", ".join(f"w{i} AS w{i}" if i <= len(dirs) else f"NULL AS w{i}" for i in range(1, 6))
        parts.append(f"SELECT w1.symbol AS symbol, w1.s AS start, w1.degree AS degree, {fam} AS fam, {cols} FROM {table} w1 {joins} WHERE w1.up = {str(dirs[0]).lower()} AND w1.length > 0")
    return ruled(f"({' UNION ALL '.join(parts)})").replace("0.95 * 0.1", "(1 - 0.05 * degree) * 0.1")


def degrees(rounds: int, max_skip: int, symbol: str) -> str:
    """Patterns after so many rounds; every round works all chains out again."""
    measured = "SELECT DISTINCT symbol, s, e, up, low, high, turn, degree, abs(high - low) AS length, e - s AS duration, CASE WHEN up THEN s ELSE e END AS low_idx, CASE WHEN up THEN e ELSE s END AS high_idx FROM"
    out = f"{edges(max_skip, symbol)},\nwaves0 AS MATERIALIZED ({measured} (SELECT *, 1 AS degree FROM edges))"
    for i in range(rounds):
        rolled = f"SELECT symbol, start AS s, fin AS e, fam = 0 AS up, CASE WHEN fam = 0 THEN w1.low ELSE coalesce(w5.low, w3.low) END AS low, CASE WHEN fam = 0 THEN w5.high ELSE w1.high END AS high, coalesce(w5.turn, w3.turn) AS turn, degree + 1 AS degree FROM patterns{i}"
        out += f",\npatterns{i} AS MATERIALIZED ({degree_chains(f'waves{i}')}),\nwaves{i + 1} AS MATERIALIZED ({measured} (SELECT symbol, s, e, up, low, high, turn, degree FROM waves{i} UNION ALL {rolled}))"
    return out


def frame(interval: str) -> str:
    """Bars of the events of each type."""
    return f"""
plain AS (SELECT event_type AS symbol, '{interval}' AS "interval", {BINS[interval]} AS bar_ts, arg_min(value, {{'a': ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {{'a': ts, 'b': event_id}}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL),
bars AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS INTEGER) AS bar_idx FROM plain)"""


EACH_FRAME = " UNION ALL ".join(f"SELECT * FROM ({of(frame(i), 'SELECT * FROM bars')})" for i in BINS)
FRAME_HITS = " UNION ALL ".join("SELECT '{i}' AS \"interval\", rule_name FROM ({q})".replace("{i}", i).replace("{q}", recursive(ahead(2, "n_name", g).replace(BARS, frame(i)), "SELECT rule_name FROM ahead_hits")) for i, g in FRAMES.items())
ORACLE_SQL |= {
    "m8_degrees": recursive(degrees(3, 1, "CAST(l_suppkey AS VARCHAR)"), "SELECT symbol, start, rule_name, degree, array_to_string([x FOR x IN [w1.e, w2.e, w3.e, w4.e, w5.e] IF x IS NOT NULL], ',') AS ends, CAST(round(1 - 0.05 * degree, 6) AS DOUBLE) AS complexity_score, round(ensemble_score, 6) AS ensemble_score FROM patterns2"),
    "s9_bucketed_series": of(bars("CAST(l_suppkey AS VARCHAR)"), "SELECT symbol, bar_ts, low, min(low) OVER s AS least, count(*) OVER s AS n, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1, 6) AS change FROM bars WINDOW s AS (PARTITION BY symbol)"),
    "s8_stored_waves": of(PATTERNS, "SELECT symbol, start, rule_name AS best_rule_name, CASE WHEN w5 IS NOT NULL THEN 'five' END AS best_kind, w1.low AS best_waves_wave1_low, w5.high AS best_waves_wave5_high FROM patterns"),
    "w1_pyramid": f"SELECT {BAR} FROM ({EACH_FRAME})",
    "p16_timeframes": f"""WITH hits AS MATERIALIZED ({FRAME_HITS}), bars AS MATERIALIZED ({EACH_FRAME}),
        per AS (SELECT "interval", count(*) AS bars, count(DISTINCT symbol) AS series FROM bars GROUP BY ROLLUP ("interval"))
        SELECT h."interval", rule_name, count(*) AS n, bars, series FROM hits h JOIN per p ON p."interval" = h."interval" GROUP BY ALL
        UNION ALL SELECT "interval", NULL, (SELECT count(*) FROM hits h WHERE p."interval" IS NULL OR h."interval" = p."interval"), bars, series FROM per p""",
    "w5_first_hit": recursive(scanned(3, GROWING), f"SELECT symbol, start_row, window_len, start, rule_name, array_to_string(config, ',') AS config, round(ensemble_score, 6) AS ensemble_score, fin FROM hits QUALIFY row_number() OVER (PARTITION BY symbol, start_row ORDER BY window_len, {BEST}, start, fam, rank) = 1"),
    "s13_committed_run": recursive(ahead(2), """SELECT 'r1' AS run_id, (SELECT count(*) FROM sizes) + 1 AS series, (SELECT count(*) FROM sizes) AS done, 1 AS failed, count(*) AS patterns, round(count(*) / (SELECT count(*) FROM sizes), 6) AS per_series,
        round(max(ensemble_score), 6) AS best_score, round(avg(ensemble_score), 6) AS mean_score, count(*) AS hits_seen, 1 AS attempts_seen, 1 AS pending FROM ahead_hits"""),
}
BACK = "bar_ts, symbol, open, high, low, close, volume, \"interval\""
ORACLE_SQL |= {
    "s1_read_bars": of(BARS, f"SELECT {BACK} FROM bars"),
    "s2_combine_bars": f"SELECT {BACK}, 'nations' AS source_category FROM (WITH {BARS} SELECT * FROM bars) UNION ALL SELECT {BACK}, 'suppliers' FROM (WITH {bars('CAST(l_suppkey AS VARCHAR)')} SELECT * FROM bars)",
    "s3_read_symbols": "SELECT trim(s_name) AS symbol FROM supplier WHERE s_suppkey % 3 > 0",
    "s4_read_manifest": of(BARS, """SELECT r_name AS market, n_name AS ticker, CASE WHEN NOT bad THEN n END AS rows, CASE WHEN NOT bad THEN a END AS min_date, CASE WHEN NOT bad THEN b END AS max_date, CASE WHEN bad THEN 'no data' END AS reason FROM (
        SELECT *, n_nationkey % 4 = 0 OR n IS NULL AS bad FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT symbol, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b FROM ticks GROUP BY symbol) t ON t.symbol = n_name)"""),
    "s8_read_patterns": of(PATTERNS, f"SELECT {KEY}, CASE WHEN w5 IS NULL THEN 3 ELSE 5 END AS n_waves, {r('ensemble_score')} FROM patterns"),
    "s9_write_bars": of(BARS, f"SELECT {BAR} FROM bars"),
    "s10_write_patterns": of(PATTERNS, "SELECT '1wk' AS \"interval\", rule_name, count(*) AS n, count(DISTINCT (symbol, start)) AS starts, (SELECT count(*) FROM patterns) AS patterns FROM patterns GROUP BY rule_name"),
    "s12_export_filtered": of(PATTERNS, "SELECT symbol, count(*) AS n, round(min(ensemble_score), 6) AS least, (SELECT count(*) FROM patterns) AS original_count, (SELECT count(*) FROM patterns WHERE ensemble_score >= 0.6) AS filtered_count, 'ensemble_score >= 0.6' AS filter FROM patterns WHERE ensemble_score >= 0.6 GROUP BY symbol"),
    "c10_category_report": of(DIRTY, "SELECT source_category, \"interval\", count(*) AS n, count(DISTINCT symbol) AS symbols FROM dirty GROUP BY ALL"),
    "v6_report_counts": of(VALIDATED, f"SELECT 'violation' AS kind, violation AS name, count(*) AS n FROM validated, unnest(violations) AS t(violation) GROUP BY ALL UNION ALL SELECT kind, name, count(*) FROM (SELECT unnest([{{'kind': 'w2_w1_quality', 'name': w2_w1_quality}}, {{'kind': 'w3_w1_quality', 'name': w3_w1_quality}}, {{'kind': 'w4_w3_quality', 'name': w4_w3_quality}}], recursive := true) FROM (SELECT {fib_quality('w2_w1', 'w2', 'w1', (0.382, 0.786), (0.236, 0.886))}, {fib_quality('w3_w1', 'w3', 'w1', (1.618, 2.618), (1.0, 4.236))}, {fib_quality('w4_w3', 'w4', 'w3', (0.236, 0.5), (0.146, 0.618))} FROM validated)) GROUP BY ALL"),
    "v8_unstructured": of(PATTERNS, "SELECT count(*) FILTER (start % 7 = 0 OR start % 11 = 0) AS not_struct FROM patterns"),
}
ORACLE_SQL |= {
    "p1_skip_options": recursive(edges(2), f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, count(x.config) AS n FROM {options(3, 3, 27)} o LEFT JOIN (SELECT config FROM ({skipping(CORRECTIVE, 3)}) AS t(symbol, start, rank, config, w1, w2, w3, w4, w5, need, before)) x ON x.config = [o.a, o.b, o.c] GROUP BY ALL"),
    "p2_top_options": recursive(edges(2), f"SELECT CAST(o.rank AS INTEGER) AS rank, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, CAST(d AS INTEGER) AS d, CAST(e AS INTEGER) AS e, count(x.config) AS n FROM {options(3, 5, 60)} o LEFT JOIN (SELECT config FROM ({skipping(IMPULSE, 3)}) AS t(symbol, start, rank, config, w1, w2, w3, w4, w5, need, before)) x ON x.config = [o.a, o.b, o.c, o.d, o.e] GROUP BY ALL"),
    "p8_dedup_candidates": recursive(edges(2), f"SELECT symbol, start, rank, array_to_string(config, ',') AS config FROM ({skipping(CORRECTIVE, 3)}) AS t(symbol, start, rank, config, w1, w2, w3, w4, w5, need, before) QUALIFY row_number() OVER (PARTITION BY symbol, start, w1.low, w1.high, w2.low, w2.high, w3.low, w3.high ORDER BY rank) = 1"),
    "p17_reconstruct_skips": recursive(found(3), "SELECT symbol, start, rule_name, array_to_string(config, ',') AS config, fin, true AS passes FROM cand"),
    "a7_config_counts": recursive(found(3), "SELECT array_to_string(config, ',') AS config, count(*) AS n FROM cand GROUP BY 1 ORDER BY n DESC, config LIMIT 10"),
    "a7_config_stats": recursive(found(3), "SELECT count(*) AS valid, count(DISTINCT config) AS distinct_configs, round(avg(fin - start), 6) AS mean_length, round(median(fin - start), 6) AS median_length, min(fin - start) AS min_length, max(fin - start) AS max_length FROM cand"),
    "v11_over_represented": of(PATTERNS.replace(BARS, bars("CAST(l_suppkey AS VARCHAR)")), "SELECT symbol, n FROM (SELECT *, avg(n) OVER () + 2 * stddev_samp(n) OVER () AS l FROM (SELECT symbol, count(*) AS n FROM patterns GROUP BY symbol)) WHERE n > l ORDER BY n DESC, symbol LIMIT 5"),
}
