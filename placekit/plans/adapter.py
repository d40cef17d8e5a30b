"""Places and their neighbours, derived from the driver's star-schema tables by whole-number arithmetic.

The tables hold no coordinates; both engines evaluate the formulas below alike, so every spatial
operator can be held against SQL.
"""

from pyspark.sql import DataFrame, SparkSession

# Vocabularies, which give every rule something to match.
TYPES = ["state", "national", "town", "preserve", "cemetery"]
NAMES = [
    "Oak Hill Preserve", "Mill Pond Park", "Town of Elm (Cedar Grove)", "Members Only Beach Club", "Acme Land Company LLC", "12 Maple Street Parcel",
    "Unnamed", "???", "Tribal Burial Ground", "Old Burying Ground", "Lake Echo State Park", "Pine State Forest", "River Bend Trail", "Cedar Beach",
    "SUMMIT RESERVOIR", "Hill Oak Preserve", "Oak Hill", "Founders Historic Site", "Little League Field", "Fox Run Preserve North", "Fox Run Preserve",
    "ab", "Meadow_Brook  Open Space", "Stone Bridge Golf Club",
]
OPERATORS = ["State of Elm DEEP", "US Fish and Wildlife Service", "Town of Elm", "Elm Land Trust, Inc.", "Elm University", "Private Owner", "Regional Water Authority", None]
FEES = [None, "free", "$12 parking per vehicle", "$5 admission fee", "free with parking fee", "no fee", "call ahead"]
SPORTS = ["soccer;tennis", "baseball", "tennis; chess", None, "basketball;soccer"]


def _pick(values: list, key: str) -> str:
    """A choice from a list by a key, in words that both engines read."""
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


def _spot(k: str, a: int, b: int, c: int, d: int) -> str:
    return f"41.0 + (({k}*{k}*{a} + {k}*{b}) % 50000)/100000.0 AS lat, -73.5 + (({k}*{k}*{c} + {k}*{d}) % 50000)/100000.0 AS lng"


def _d(text: str) -> str:
    """Decimal literals as doubles, for both engines."""
    return text.replace("41.0 +", "CAST(41.0 AS DOUBLE) +").replace("-73.5 +", "CAST(-73.5 AS DOUBLE) +").replace("/100000.0", "/CAST(100000.0 AS DOUBLE)")


FLAGS = {"trails": 2, "parking": 3, "sports": 5, "playground": 7, "beach": 11, "pool": 13, "reachable": 6, "shaped": 4, "private": 17, "researched": 9}
VIEWS = {
    "P": "SELECT p_partkey AS key, " + _d(_spot("p_partkey", 31, 7919, 17, 4729)) + f", {_pick(TYPES, 'p_partkey')} AS type, {_pick(NAMES, '(p_partkey * 7 + p_size)')} AS name, {_pick(OPERATORS, '(p_partkey + p_size)')} AS op, {_pick(FEES, '(p_partkey * 3 + p_size)')} AS fee, "
    "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * (p_partkey % 9 + 1) END AS acres, CASE WHEN p_partkey % 4 = 0 THEN concat('http://x/', CAST(p_partkey AS VARCHAR(20))) END AS url, "
    + _pick(["Open", None, "Closed", None, "Restricted", "Unknown", None], "(p_partkey + 2 * p_size)") + " AS official, CASE WHEN p_partkey % 10 < 7 THEN 'CT' ELSE 'NY' END AS state, "
    "CAST(floor(p_partkey / 10) AS BIGINT) % 40 AS town, " + ", ".join(f"(p_partkey % {m} = 1) AS {f}" for f, m in FLAGS.items()) + " FROM part",
    "C": "SELECT c_custkey AS key, " + _d(_spot("c_custkey", 37, 6007, 23, 3571)) + f", lower(c_mktsegment) AS leisure, {_pick(SPORTS, 'c_custkey')} AS sport, abs(CAST(floor(c_acctbal) AS BIGINT)) % 300 + 20 AS rad, {_pick(NAMES, '(c_custkey * 5)')} AS name, c_nationkey AS zone FROM customer",
    "O": "SELECT o_orderkey AS key, o_custkey AS path, " + _d(_spot("o_orderkey", 41, 5003, 29, 2753)) + " FROM orders",
    "R": "SELECT s_suppkey AS key, " + _d(_spot("s_suppkey", 43, 4201, 19, 6211)) + f", {_pick(['OA', 'RA', 'XA', 'UK'], 's_suppkey')} AS code, {_pick(['FED', 'STAT', 'LOC', 'NGO', 'PVT'], 's_suppkey')} AS own, {_pick(['PARK', 'FEE', 'EASE'], 's_suppkey')} AS des, {_pick(NAMES, 's_suppkey')} AS name FROM supplier",
    "M": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS layer, " + "".join(f"CAST({base} AS DOUBLE) + {cell} * CAST(0.1 AS DOUBLE) + CAST({off} AS DOUBLE) AS {n}, " for n, base, cell, off in (("x0", "-73.5", "(n_nationkey % 5)", "0.000005"), ("x1", "-73.5", "(n_nationkey % 5)", "0.090005"), ("y0", "41.0", "CAST(floor(n_nationkey / 5) AS INT)", "0.000005"), ("y1", "41.0", "CAST(floor(n_nationkey / 5) AS INT)", "0.090005"))).rstrip(", ") + " FROM nation",
    "S": "SELECT r_regionkey AS id, r_name AS name, CAST(-73.5 AS DOUBLE) + r_regionkey * CAST(0.1 AS DOUBLE) + CAST(0.000005 AS DOUBLE) AS x0, CAST(-73.5 AS DOUBLE) + r_regionkey * CAST(0.1 AS DOUBLE) + CAST(0.100005 AS DOUBLE) AS x1, r_regionkey < 2 AS covered FROM region",
    "L": "SELECT l_orderkey AS key, l_linenumber AS px, CAST(l_quantity AS BIGINT) AS v, l_returnflag AS flag, l_linestatus AS stat, l_partkey AS part, CASE WHEN l_quantity < 6 THEN 'water' WHEN l_quantity < 20 THEN 'grass' WHEN l_quantity < 30 THEN 'crops' ELSE 'forest' END AS cls FROM lineitem",
}
TABLES = {"P": "part", "C": "customer", "O": "orders", "R": "supplier", "M": "nation", "S": "region", "L": "lineitem"}


def view(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """The rows of a role; only the columns that a query asks for are read."""
    columns = VIEWS[role].removeprefix("SELECT ").rpartition(" FROM ")[0]
    return spark.read.parquet(f"{sf_dir}/{TABLES[role]}.parquet").selectExpr(*_columns(columns))


def _columns(text: str) -> list[str]:
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    return [*out, text[start:].strip()]


def prelude(*roles: str) -> str:
    return "WITH " + ", ".join(f"{r} AS ({VIEWS[r]})" for r in roles) + " "
