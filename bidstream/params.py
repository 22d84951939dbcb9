"""Tunable constants of the query set."""

from dataclasses import dataclass, replace
from decimal import Decimal


@dataclass(frozen=True)
class Params:
    # Fixed values of the query definitions.
    euro_rate: float = 0.89
    dollar_rate: Decimal = Decimal("0.908")
    watched_auctions: tuple[int, ...] = (1007, 1020, 2001, 2019, 2087)
    category: int = 10
    states: tuple[str, ...] = ("or", "id", "ca")
    price_bands: tuple[int, int] = (10_000, 1_000_000)
    converted_range: tuple[int, int] = (1_000_000, 50_000_000)
    hop_size: str = "10 seconds"
    hop_slide: str = "2 seconds"
    tumble_size: str = "10 seconds"
    top_k: int = 10
    preceding_rows: int = 10
    # Open in the definitions, so chosen here.
    session_gap: str = "10 seconds"
    side_rows: int = 10_000
    watermark_delay: str = "0 seconds"
    # Streams only: upper bound of ``expires - date_time``. Given one, old auctions leave the join
    # state and a longer auction fails the query; None, as defined, keeps them all.
    max_auction_length: str | None = None
    # Streams only: how far apart in time two rows of an otherwise unbounded join may be. Given
    # one, pairs further apart are lost; None, as defined, keeps all join state for ever.
    join_horizon: str | None = None
    # Streams only: parts that the matches of a hot join key are spread over, and the hot auctions and
    # sellers (see ``streaming.salts``); None, without knowledge of the keys, takes every key for hot.
    join_salts: int = 4
    hot_auctions: tuple[int, ...] | None = None
    hot_sellers: tuple[int, ...] | None = None
    # Streams only: whether forms that close auctions keep the open ones in a store beside the checkpoint, and
    # join it as a table, in place of Spark's own state. Fixed for the life of a checkpoint.
    keep_open: bool = False
    # Largest side table that is shipped whole to every executor (two short columns a row).
    broadcast_rows: int = 1_000_000
    # Rows per block when the history of one seller is split over tasks.
    history_block: int = 100_000

    def but(self, **changes):
        return replace(self, **changes)
