"""Genre vocabularies and the multi-hot encoder (F1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 18 genres of the MovieLens 1M catalogue, in the reference's
# order (position i of a genre vector is the i-th name).
MOVIELENS_GENRES = (
    "Action", "Adventure", "Animation", "Children's", "Comedy",
    "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir",
    "Horror", "Musical", "Mystery", "Romance", "Sci-Fi",
    "Thriller", "War", "Western",
)

# The 18-token vocabulary of the catalogue view built over the
# driver's `part` table (FIXTURES.md), in that order; matching is
# case-sensitive, so LARGE / MEDIUM / SMALL / STANDARD stay out of vocabulary.
DRIVER_GENRES = (
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new",
    "old", "plate", "red", "ring", "rod", "small", "widget", "ECONOMY", "PROMO",
)

N_GENRES = 18


def genre_tokens(genres) -> Column:
    g = F.col(genres) if isinstance(genres, str) else genres
    return F.split(g, r"\|")


def multi_hot(genres, vocab=DRIVER_GENRES) -> Column:
    """``a|b|c`` -> 0/1 vector over ``vocab``; unknown tokens ignored, repeats stay 1."""
    toks = genre_tokens(genres)
    return F.array(*[F.coalesce(F.array_contains(toks, F.lit(g)), F.lit(False)).cast("double")
                     for g in vocab])
