"""What a place's facts say: access, fee, status. First matching rule wins."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def visitable() -> Column:
    return flag("trails") | flag("parking") | flag("sports") | flag("playground") | flag("beach") | flag("pool")


def access() -> Column:
    """From private, official, type; without any way to visit and no rating it is unknown."""
    official, kind = F.col("official"), F.col("type")
    first = (
        F.when(flag("private"), "closed").when(official == "Closed", "closed").when(official == "Open", "open").when(official == "Restricted", "permission")
        .when(kind.isin("state", "national", "town"), "open").when(kind.isin("preserve", "cemetery"), "permission").otherwise("unknown")
    )
    return F.when(~visitable() & ~flag("reachable") & (first != "closed") & official.isNull(), "unknown").otherwise(first)


def fee_state() -> Column:
    """paid, parking or free, from the fee text and the type."""
    text = F.lower(F.coalesce(F.col("fee"), F.lit("")))
    free = text.rlike(r"\bfree\b")
    charge = text.rlike(r"\$\d|\badmission\b|\bfee\b") & ~text.rlike(r"\bno fee\b")
    parking = charge & text.rlike(r"\bparking\b|\bvehicle\b")
    return F.when(charge & ~free & ~parking, "paid").when(parking, "parking").when(free, "free").when(F.col("type") == "state", "parking").otherwise("free")


def status() -> Column:
    legal = F.col("access").isin("open", "permission") & ~flag("private")
    physical = visitable() | flag("reachable")
    return F.when(F.col("fee_state") == "paid", "fee").when(legal & physical & flag("shaped"), "park").otherwise("unverified")


def reasons() -> Column:
    """What is missing for a verified place, joined by "; "."""
    legal = F.col("access").isin("open", "permission") & ~flag("private")
    physical = visitable() | flag("reachable")
    return F.concat_ws("; ", F.when(~legal, "no right of access"), F.when(~physical, "no way in known"), F.when(~flag("shaped"), "no boundary"))


def tier() -> Column:
    return F.when(F.col("status").isin("park", "fee"), "open").when(F.col("access").isin("open", "permission"), "probably").otherwise("unknown")


def evidence(flags: list[str]) -> Column:
    """Facts known, with weights for research, links, area."""
    n = F.lit(0)
    for f in flags:
        n = n + flag(f).cast("int")
    return n + F.when(flag("researched"), 20).otherwise(0) + F.when(F.col("url").isNotNull(), 3).otherwise(0) + F.when(F.coalesce("acres", F.lit(0)) > 0, 2).otherwise(0) + F.when(F.col("fee").isNotNull(), 1).otherwise(0)
