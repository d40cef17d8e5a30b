"""Rules about names, operators and fees, as a table that a user may replace; columns in, columns out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Patterns by what they say; case never counts."""

    # Wordings of names, operators and fees that have a meaning.
    allow: tuple[str, ...] = ("westport longshore club park", "longshore club park")
    junk: str = r"[<>]|arcgis|arrayof|propertyset|^\W+$"
    members: str = (
        r"\bclub\b|racquet|members only|homeowners|\bhoa\b|(beach|lake|shore|point|improvement) association|"
        r"sportsman|sportsmen|rod (and|&) gun|fish (and|&) game|\bscout\b|scout reservation"
    )
    company: str = r"\bllc\b|\bl\.l\.c|\binc\.?$|\bincorporated\b|\bassociates\b|realty|\bproperties\b|\bestates\b|development corp"
    covered: str = r"state (park|forest)|scenic reserve|national (park|historical|scenic)"
    covered_states: tuple[str, ...] = ("CT",)
    tribal: str = (
        r"tribal burial|indian burial|burial site|\b(schaghticoke|paugussett|pequot|mohegan|montaukett|niantic|nipmuc|mashantucket|golden hill)\b.*(burial|reservation)|"
        r"\breservation\b.*(indian|tribal)"
    )
    generic: str = r"^(town|city|borough|village) of\b|^private\b|^unknown$|^state of\b|^designation$"
    parcel: str = r"^\d+\s|\bllc\b|\bl\.l\.c|\binc\b|\bassociates\b|subdivision|\blp\b|\bltd\b|properties|realty|development\b|\bestates\b"
    operators: tuple[tuple[str, str], ...] = (
        ("state", r"department of energy and environmental|state of connecticut|\bdeep\b|connecticut dep"),
        ("federal", r"national park service|united states of america|u\.?s\.? fish|fish and wildlife|army corps"),
        ("water", r"water supply|water authority|water company|bureau of water|aquarion|regional water"),
        ("town", r"^(town|city|borough|village) of\b|^city\b|parks (and|&) recreation"),
        ("university", r"university|college|yale|uconn|academy"),
        ("trust", r"land trust|conservancy|conservation trust|land conservation|audubon|nature center|nature conservancy|preservation|\btrust\b"),
    )
    charge: str = r"admission (fee|charge|\$)|entry fee|entrance fee|\bticket\b"
    parking_charge: str = r"parking (fee|charge|\$)|passport to the parks|out-of-state|per vehicle"


DEFAULT = Rules()


def says(c: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(c).rlike(pattern), F.lit(False))


def refusal(name: Column, state: Column | None = None, rules: Rules = DEFAULT) -> Column:
    """Why a name is no place: short, junk, members, company or, if its state is known, covered; null if it is one."""
    n = F.trim(F.coalesce(name, F.lit("")))
    named = F.lower(n).isin(*rules.allow)
    out = F.when(F.length(n) < 3, "short").when(says(n, rules.junk), "junk").when(named, F.lit(None).cast("string")).when(says(n, rules.members), "members").when(says(n, rules.company), "company")
    return out if state is None else out.when(state.isin(*rules.covered_states) & says(n, rules.covered), "covered")


def operator_kind(operator: Column, rules: Rules = DEFAULT) -> Column:
    """The first kind whose wording an operator has; other without one, none without an operator."""
    out = F.when(F.coalesce(F.trim(operator), F.lit("")) == "", "none")
    for kind, pattern in rules.operators:
        out = out.when(says(operator, pattern), kind)
    return out.otherwise("other")


def fee_of(fee: Column, note: Column, kind: Column, rules: Rules = DEFAULT) -> Column:
    """paid, parking or free, from what fee and note say; free, said last, wins over an entry charge."""
    text = F.lower(F.concat_ws(" ", F.coalesce(fee, F.lit("")), F.coalesce(note, F.lit(""))))
    free = text.rlike(r"\bfree\b") & ~F.regexp_replace(text, r"^.*\bfree\b", "").rlike(r"\b(fee|charge)\b")
    price = text.rlike(r"\$\d") & ~F.regexp_replace(text, r"^.*\$\d", "").contains("parking")
    paid = text.rlike(rules.charge) | price
    return F.when(paid & ~free, "paid").when(text.rlike(rules.parking_charge), "parking").when(free, "free").when(kind == "state", "parking").otherwise("free")
