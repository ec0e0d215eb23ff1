"""Corpus stylometry on Spark DataFrames.

Tables of text go in; tables of tokens, n-grams, per-author style profiles, style vectors,
scored rewrite candidates and rendered prompts come out.
"""

from penprint.plans.profile import style_profile
from penprint.session import session

__all__ = ["session", "style_profile"]
