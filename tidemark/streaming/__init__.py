"""No streaming operators are owed: late data arrives as revisions, which are batch facts.

The bitemporal operators in ``tidemark.operators.pit`` answer "what was visible on
date D" for any number of dates in one plan, so nothing here keeps state between batches.
"""
