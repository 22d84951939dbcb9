"""Relational building blocks shared by the queries."""

from bidstream.operators.extremes import rows_at_max
from bidstream.operators.history import trailing_average
from bidstream.operators.lookup import lookup_join
from bidstream.operators.ordering import numbered, take_first
from bidstream.operators.sessions import sessions
from bidstream.operators.top import top_rows
from bidstream.operators.validity import best_match, bids_while_open, winning_bids

__all__ = [
    "best_match", "bids_while_open", "lookup_join", "numbered", "rows_at_max", "sessions", "take_first",
    "top_rows", "trailing_average", "winning_bids",
]
