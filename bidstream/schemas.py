"""Schemas of the auction data model: people, auctions, bids, and their carriers."""

from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _TEXT, _TIME = LongType(), StringType(), TimestampType()

# Nested records of the combined stream; the producer spells the time key ``dateTime``.
PERSON_EVENT = _struct(
    id=_LONG, name=_TEXT, email_address=_TEXT, credit_card=_TEXT,
    city=_TEXT, state=_TEXT, dateTime=_TIME, extra=_TEXT,
)
AUCTION_EVENT = _struct(
    id=_LONG, item_name=_TEXT, description=_TEXT, initial_bid=_LONG, reserve=_LONG,
    dateTime=_TIME, expires=_TIME, seller=_LONG, category=_LONG, extra=_TEXT,
)
BID_EVENT = _struct(
    auction=_LONG, bidder=_LONG, price=_LONG, channel=_TEXT, url=_TEXT,
    dateTime=_TIME, extra=_TEXT,
)
COMBINED_EVENT = _struct(
    event_type=IntegerType(), person=PERSON_EVENT, auction=AUCTION_EVENT, bid=BID_EVENT,
)
# Fixed values of ``event_type``.
PERSON_TYPE, AUCTION_TYPE, BID_TYPE = 0, 1, 2

# Flat tables every query is written against.
BID = _struct(
    ts=_TIME, auction=_LONG, bidder=_LONG, price=_LONG, channel=_TEXT, url=_TEXT, extra=_TEXT,
)
AUCTION = _struct(
    id=_LONG, item_name=_TEXT, description=_TEXT, initial_bid=_LONG, reserve=_LONG,
    date_time=_TIME, expires=_TIME, seller=_LONG, category=_LONG, extra=_TEXT,
)
PERSON = _struct(
    id=_LONG, name=_TEXT, email_address=_TEXT, credit_card=_TEXT,
    city=_TEXT, state=_TEXT, date_time=_TIME, extra=_TEXT,
)

# Integers every saved dataset description has to carry.
DATASET_STATS = _struct(
    total_rows=_LONG, partitions=_LONG,
    q2_expected_rows=_LONG, q14_expected_rows=_LONG, q21_expected_rows=_LONG,
    q16_expected_rows=_LONG, q17_expected_rows=_LONG,
)
