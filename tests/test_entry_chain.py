"""The five keys of an entry in their order, against a plain search."""

import math
import re

from placekit.plans import catalogue
from placekit.plans.adapter import view
from placekit.plans.research import AKA, WHOLE

SF = "/root/testdata/sf0.001"


def test_chain_of_five_keys(spark):
    norm = lambda s: re.sub("[^a-z0-9]+", " ", (s or "").lower()).strip()
    places = sorted(view(spark, SF, "P").select("key", "name", "town", "lat", "lng").collect())
    metres = lambda p, lat, lng: math.hypot((p.lat - lat) * 111320, (p.lng - lng) * 111320 * math.cos(math.radians((p.lat + lat) / 2)))
    want = {}
    for entry, key, name, town, lat, lng in WHOLE:
        worn = [n for n, a in AKA if norm(a) == norm(name)]
        steps = {
            "id": [p.key for p in places if p.key == key], "name+town": [p.key for p in places if norm(p.name) == norm(name) and p.town == town],
            "name": [p.key for p in places if norm(p.name) == norm(name)], "aka": [p.key for p in places if p.name.lower() in worn],
            "near": [k for d, k in sorted((metres(p, lat, lng), p.key) for p in places) if d < 600] if lat else [],
        }
        want[entry] = next(((found[0], how) for how, found in steps.items() if found), (None, "none"))
    assert {r.entry: (r.key, r.how) for r in catalogue.queries()["entry_match_chain_aka"](spark, SF).collect()} == want
    assert (want["e6"][1], want["e7"][1], want["e8"][1], want["e9"][1], want["e4"][1]) == ("aka", "near", "none", "aka", "none")
