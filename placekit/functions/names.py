"""Name expressions: normal forms, tokens, relations. Columns in, columns out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which place it is.
FILLER = ["the", "of", "and", "at", "park", "preserve", "forest", "state", "town", "land", "trust", "open", "space", "area", "field", "site", "trail"]


def norm(c: Column) -> Column:
    """Lower case, runs of other than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Distinct words of two letters or more without fillers, sorted; all words if none is left."""
    words = F.array_distinct(F.filter(F.split(norm(c), " "), lambda w: w != ""))
    own = F.array_sort(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*FILLER)))
    return F.when(F.size(own) == 0, F.array_sort(words)).otherwise(own)


def core_key(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def related(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or two shared words or more with a Jaccard of 0.6."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (shared > 0) & ((shared == F.least(F.size(a), F.size(b))) | ((shared >= 2) & (shared * 10 >= both * 6)))


def pretty(c: Column) -> Column:
    """The name in brackets after "Town of X"; capitals alone become a title; underscores are spaces."""
    inner = F.regexp_extract(c, r"^Town of [A-Za-z ]+ \((.+)\)$", 1)
    plain = F.trim(F.regexp_replace(F.when(inner != "", inner).otherwise(c), "[_ ]+", " "))
    return F.when(plain.rlike("[a-z]") | ~plain.rlike("[A-Z]"), plain).otherwise(F.initcap(F.lower(plain)))
