"""Secret scans: multipart credential linking with DataFrame functions only.

Base secrets (assignments, access keys, long hex) are always reported. Weak candidates (a name of
an account, a value that looks random, an address) are reported only if at most ``scope`` code
points lie between them and a complementary part, which has to be other characters than their own: the parts of a text are joined as
intervals, by running extremes over their sorted ends and starts, so that no pairs are made.

Null texts count as empty and have no span. Equal texts are searched once, and repeated rows each get a row. Positions are code
points, ends exclusive; spans of one start are told in the order of the kinds. Long texts are searched whole. An empty table gives an empty table. Columns other than ``text`` are carried and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placekit.llm.common import read_table, text_key, text_of

# Kinds in the order of a report, with their patterns.
_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?"
PATTERNS = {
    "assign": r"(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "weak_id": r"(?=[AaCcUuLl])(?<![A-Za-z0-9_])(?i:(access_?key_?id|account_?id|client_?id|user_?id|user_?name|login))" + _VALUE + r"([A-Za-z0-9@+/_.=-]{4,})",
    "weak_secret": r"(?=[PpCcSsAaKk])(?<![A-Za-z0-9_])(?i:(private_?key|credential|signature|auth|pwd|pass|key))" + _VALUE + r"([A-Za-z0-9+/_.=-]{8,})",
    "random": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]{32})(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"(?=[HhFfPpMmRrAa])(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
}
BASE = ("assign", "access", "hex")
#: The part that a kind plays in a credential.
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "random": "secret", "endpoint": "endpoint"}
#: Parts of which one has to be near for a weak candidate of this part to be reported.
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
#: Code points between the end of a part and the start of the next of one credential.
SCOPE = 200


def _pieces(text: Column, kind: str) -> Column:
    """For each hit in order: kind, code points since the last hit, own code points, whether it counts."""
    p = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(2)) if kind == "assign" else hits
    zipped = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    ok = (lambda z: F.length(z["value"]) >= 6) if kind == "assign" else (lambda z: F.lit(True))
    made = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("len"), ok(z).alias("ok")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(F.regexp_like(text, p), made).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (of the text), kind, start, end of every base span and weak candidate, once for each text."""
    hits = docs.select(text_key(text).alias("key"), F.concat(*[_pieces(text_of(text), k) for k in PATTERNS]).alias("hits"))
    hits = hits.groupBy("key").agg(F.first("hits").alias("hits"))  # copies meet map-side
    hits = hits.select("key", F.explode("hits").alias("h")).select("key", "h.*")
    ahead = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("key", "kind").orderBy("i"))
    return hits.withColumn("end", ahead.cast("long")).where("ok").select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and the weak candidates near to a complementary part that shares no character with them.

    An interval semi-join by order: in a text, the last end of each part at or before a candidate's start, and the first
    start at or after its end, are running extremes over the sorted ends and starts. Rows stay linear in the spans.
    """
    part = F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])[F.col("kind")]
    weak = ~F.col("kind").isin(*BASE)
    # at equal places a part counts for the candidate that it touches: ends, then candidates' starts; candidates' ends, then starts
    rows = [F.struct(F.col(at).alias("at"), F.lit(o).alias("o"), F.lit(side).alias("side")) for at, o, side in (("end", 0, "part"), ("start", 1, "left"), ("end", 2, "right"), ("start", 3, "part"))]
    rows = F.filter(F.array(*rows), lambda r: (r["side"] == "part") | weak)
    events = spans.withColumn("part", part).select("key", "kind", "start", "end", "part", F.explode(rows).alias("e")).select("*", "e.*").drop("e")
    before = Window.partitionBy("key").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(F.col("at").desc(), F.col("o").desc()).rowsBetween(Window.unboundedPreceding, -1)
    linked = F.lit(False)
    for p, others in NEEDS.items():
        is_end, is_start = ((F.col("side") == "part") & (F.col("o") == o) & F.col("part").isin(*others) for o in (0, 3))
        last, first = F.max(F.when(is_end, F.col("end"))).over(before), F.min(F.when(is_start, F.col("start"))).over(after)
        events = events.withColumns({f"last_{p}": last, f"first_{p}": first})
        gap = F.when(F.col("side") == "left", F.col("start") - F.col(f"last_{p}")).when(F.col("side") == "right", F.col(f"first_{p}") - F.col("end"))
        linked = linked | ((F.col("part") == p) & F.coalesce(gap <= scope, F.lit(False)))
    near = events.where(linked).select("key", "kind", "start", "end").dropDuplicates()
    return spans.where(~weak).select("key", "kind", "start", "end").unionByName(near)


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """key (of the text), spans array<struct<start,ord,kind,end>> in the order of a report; a text without a span has no row."""
    spans = link_parts(find_spans(docs, text), scope)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PATTERNS) for x in (k, i)])[F.col("kind")]
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("ord"), "kind", "end"))).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; overlapping spans get one mark."""
    spans = scan_secrets(docs, text, scope).select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.end")
    order = Window.partitionBy("key").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", F.coalesce((F.col("start") >= seen).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # the text between a run and the one before; the last piece runs to the end
    runs = runs.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("key").orderBy("run")), F.lit(0)))
    cuts = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "start", "end"))).alias("cuts"))
    cuts = cuts.withColumnsRenamed({"key": "__key", "cuts": "__cuts"})
    t = F.col(text)
    kept = F.transform("__cuts", lambda c: F.substring(t, c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")))
    tail = F.substring(t, F.element_at("__cuts", -1)["end"].cast("int") + 1, F.length(t))
    out = docs.withColumn("__k", text_key(text)).join(cuts, F.col("__k") == F.col("__key"), "left")
    clean = F.when(F.col("__cuts").isNull(), t).otherwise(F.array_join(F.concat(kept, F.array(tail)), mark))
    return out.withColumn(text, clean).select(*docs.columns)


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans."""
    found = scan_secrets(docs)
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    found = found.select(
        "key",
        *[_count(k).alias(f"n_{k}") for k in BASE],
        line(base).alias("base"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )
    out = docs.select("doc_id", text_key().alias("key")).join(found, "key", "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))
