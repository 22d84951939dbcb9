"""DuckDB statements giving the expected result of every SQL-expressible query."""

VIEWS = """
bid AS (
  SELECT l_orderkey AS auction, l_partkey AS bidder,
         CAST(floor(l_extendedprice) AS BIGINT) * CAST(l_quantity AS BIGINT) AS price,
         CASE l_partkey % 8 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Google' WHEN 2 THEN 'Facebook'
              WHEN 3 THEN 'Baidu' ELSE 'channel-' || (l_partkey % 100) END AS channel,
         'https://www.example.com/d' || (l_suppkey % 7) || '/e' || (l_partkey % 5) || '/f'
           || l_linenumber || '/item.htm?query=1'
           || CASE WHEN l_partkey % 3 <> 0 THEN '&channel_id=' || l_suppkey ELSE '' END AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((l_orderkey * 17) % 255600
           + (l_partkey * 7919 + l_suppkey * 13 + l_linenumber * 61) % 7200 - 600) AS date_time,
         l_returnflag || repeat('c', l_linenumber) || l_linestatus AS extra
  FROM lineitem),
auction AS (
  SELECT o_orderkey AS id, 'item-' || o_orderkey AS item_name, o_orderpriority AS description,
         CAST(floor(o_totalprice / 100) AS BIGINT) AS initial_bid,
         CAST(floor(o_totalprice / 50) AS BIGINT) AS reserve,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((o_orderkey * 17) % 255600) AS date_time,
         TIMESTAMP '2024-01-01 00:00:00'
           + to_seconds((o_orderkey * 17) % 255600 + 1800 + o_orderkey % 1800) AS expires,
         o_custkey AS seller, CAST(10 + o_orderkey % 5 AS BIGINT) AS category,
         o_orderstatus AS extra
  FROM orders),
person AS (
  SELECT c_custkey AS id, c_name AS name, 'city-' || c_nationkey AS city,
         CASE c_nationkey % 6 WHEN 0 THEN 'or' WHEN 1 THEN 'id' WHEN 2 THEN 'ca' WHEN 3 THEN 'wa'
              WHEN 4 THEN 'az' ELSE 'wy' END AS state,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((c_custkey * 173) % 259200) AS date_time,
         c_mktsegment AS extra
  FROM customer)
"""

_DAY = "strftime(date_time, '%Y-%m-%d')"
_MINUTE = "strftime(date_time, '%H:%M')"
_PART_OF_DAY = """CASE WHEN hour(date_time) >= 8 AND hour(date_time) <= 18 THEN 'dayTime'
  WHEN hour(date_time) <= 6 OR hour(date_time) >= 20 THEN 'nightTime' ELSE 'otherTime' END"""
_CONVERTED = "CAST(0.908 * price AS DECIMAL(24,3))"
_BANDS = ("price < 10000", "price >= 10000 AND price < 1000000", "price >= 1000000")
_BID_COUNTS = ", ".join(
    ["count(*) AS total_bids"]
    + [f"count(*) FILTER (WHERE {b}) AS rank{n}_bids" for n, b in enumerate(_BANDS, 1)]
)
_DISTINCTS = ", ".join(
    f"count(DISTINCT {column}) AS total_{column}s, "
    + ", ".join(
        f"count(DISTINCT {column}) FILTER (WHERE {b}) AS rank{n}_{column}s"
        for n, b in enumerate(_BANDS, 1)
    )
    for column in ("bidder", "auction")
)
_PRICES = """min(price) AS min_price, max(price) AS max_price,
  CAST(sum(price) AS DOUBLE) / count(price) AS avg_price"""
_NAMED = "lower(channel) IN ('apple', 'google', 'facebook', 'baidu')"
_IN_TIME = "a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.expires"


def _bucket(column, seconds):
    return (
        f"make_timestamp(CAST(floor(epoch_us({column}) / {seconds * 1_000_000}.0) AS BIGINT)"
        f" * {seconds * 1_000_000})"
    )


def _channel_code(pattern, group, more=""):
    return f"""SELECT auction, bidder, price, channel, {more}
      CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2'
        WHEN 'baidu' THEN '3' ELSE regexp_extract(url, '{pattern}', {group}) END AS channel_id
    FROM bid WHERE regexp_matches(url, '{pattern}') OR {_NAMED}"""


def _hot_items(size, slide):
    return f"""
    , hops AS (
      SELECT auction, {_bucket('date_time', slide)} - to_seconds(k * {slide}) AS starttime, count(*) AS num
      FROM bid, range({size // slide}) AS r(k) GROUP BY ALL)
    SELECT auction, num FROM hops
    JOIN (SELECT starttime, max(num) AS maxn FROM hops GROUP BY starttime) USING (starttime)
    WHERE num >= maxn"""


def _seller_average(direction):
    return f"""SELECT seller, avg(price) OVER (
        PARTITION BY seller ORDER BY date_time, id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS avg
    FROM (SELECT a.id, a.seller, b.price, b.date_time, row_number() OVER (
            PARTITION BY a.id, a.seller ORDER BY b.price {direction}, b.date_time, b.bidder) AS rn
          FROM auction a JOIN bid b ON {_IN_TIME})
    WHERE rn <= 1"""


def _highest_bids(size):
    return f"""
    , tops AS (SELECT max(price) AS maxprice, {_bucket('date_time', size)} + to_seconds({size}) AS closes
               FROM bid GROUP BY 2)
    SELECT b.auction, b.price, b.bidder, b.date_time FROM bid b JOIN tops t ON b.price = t.maxprice
    WHERE b.date_time BETWEEN t.closes - to_seconds({size}) AND t.closes"""


def _newcomers(size):
    return f"""SELECT p.id, p.name, p.starttime FROM
      (SELECT id, name, {_bucket('date_time', size)} AS starttime FROM person GROUP BY ALL) p
      JOIN (SELECT seller, {_bucket('date_time', size)} AS starttime FROM auction GROUP BY ALL) a
      ON p.id = a.seller AND p.starttime = a.starttime"""


def _sessions(gap):
    return f"""
    , marked AS (
      SELECT bidder, date_time, CASE WHEN date_time - lag(date_time) OVER w > to_seconds({gap})
        OR lag(date_time) OVER w IS NULL THEN 1 ELSE 0 END AS opens
      FROM bid WINDOW w AS (PARTITION BY bidder ORDER BY date_time))
    , runs AS (
      SELECT bidder, date_time, sum(opens) OVER (
        PARTITION BY bidder ORDER BY date_time RANGE UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT bidder, count(*) AS bid_count, min(date_time) AS session_start,
           max(date_time) + to_seconds({gap}) AS session_end
    FROM runs GROUP BY bidder, run"""


def _report(groups, extra=""):
    return f"SELECT {groups}, {extra} {_BID_COUNTS}, {_DISTINCTS} FROM bid GROUP BY ALL"


_WINNERS = f"""SELECT id, item_name, description, initial_bid, reserve, date_time, expires, seller,
      category, auction, bidder, price, bid_date_time
    FROM (SELECT a.*, b.auction, b.bidder, b.price, b.date_time AS bid_date_time,
            row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.date_time, b.bidder) AS rn
          FROM auction a JOIN bid b ON {_IN_TIME})
    WHERE rn <= 1"""

_BID = "date_time AS ts, auction, bidder, price, channel, url, extra"
_LOG_ORDER = "date_time, auction, bidder, price, channel, url, extra"

STATEMENTS = {
    "bid_of_events": f"SELECT {_BID} FROM bid",
    "auction_of_events": "SELECT * FROM auction",
    "person_of_events": """SELECT id, name, CAST(NULL AS VARCHAR) AS email_address,
        CAST(NULL AS VARCHAR) AS credit_card, city, state, date_time, extra FROM person""",
    "keyed_log": f"""SELECT 'p' || ((row_number() OVER (ORDER BY {_LOG_ORDER}) - 1) % 4) AS key, {_BID}
        FROM bid""",
    "first_bids": f"SELECT {_BID} FROM bid ORDER BY {_LOG_ORDER} LIMIT 5000",
    "dataset_stats": f"""SELECT count(*) AS total_rows, CAST(4 AS BIGINT) AS partitions,
          count(*) FILTER (WHERE auction IN (1007, 1020, 2001, 2019, 2087)) AS q2_expected_rows,
          count(*) FILTER (WHERE CAST(price AS DOUBLE) * CAST(0.908 AS DOUBLE) > 1000000
            AND CAST(price AS DOUBLE) * CAST(0.908 AS DOUBLE) < 50000000) AS q14_expected_rows,
          count(*) FILTER (WHERE {_NAMED} OR contains(url, 'channel_id=')) AS q21_expected_rows,
          count(DISTINCT ({_DAY}, channel)) AS q16_expected_rows,
          count(DISTINCT auction) AS q17_expected_rows
        FROM bid""",
    "day_files": f"""SELECT auction, bidder, price, date_time, {_DAY} AS date,
        {_MINUTE} AS time FROM bid""",
    "hash_partitioned_table": f"SELECT {_BID}, {_DAY} AS day FROM bid",
    "q0": "SELECT auction, bidder, price, date_time FROM bid",
    "q0_r": "SELECT auction, bidder, price, channel, url, date_time AS ts FROM bid",
    "q1": f"SELECT auction, bidder, {_CONVERTED} AS price, date_time FROM bid",
    "q1_r": """SELECT auction, bidder, CAST(price AS DOUBLE) * CAST(0.89 AS DOUBLE) AS price_eur,
        channel, url, date_time AS ts FROM bid""",
    "q1_r_both": """SELECT auction, bidder, price, CAST(price AS DOUBLE) * CAST(0.89 AS DOUBLE)
        AS price_eur, channel, url, date_time AS ts FROM bid""",
    "q2": """SELECT auction, price FROM bid WHERE auction = 1007 OR auction = 1020
        OR auction = 2001 OR auction = 2019 OR auction = 2087""",
    "q2_r": """SELECT auction, price, date_time AS ts FROM bid
        WHERE auction IN (1007, 1020, 2001, 2019, 2087)""",
    "q3": """SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id
        WHERE a.category = 10 AND (p.state = 'or' OR p.state = 'id' OR p.state = 'ca')""",
    "q4": f"""SELECT category, avg(final) AS avg FROM (
          SELECT max(b.price) AS final, a.category FROM auction a JOIN bid b ON {_IN_TIME}
          GROUP BY a.id, a.category)
        GROUP BY category""",
    "q5": _hot_items(10, 2),
    "q5_wide": _hot_items(600, 120),
    "q6": _seller_average("ASC"),
    "q6_winning": _seller_average("DESC"),
    "q7": _highest_bids(10),
    "q7_wide": _highest_bids(600),
    "q8": _newcomers(10),
    "q8_wide": _newcomers(3600),
    "q9": _WINNERS,
    "q10": f"""SELECT auction, bidder, price, date_time, {_DAY} AS date, {_MINUTE} AS time
        FROM bid""",
    "q11": _sessions(10),
    "q11_wide": _sessions(600),
    "q12_recorded": f"""SELECT bidder, count(*) AS bid_count, {_bucket('date_time', 10)} AS window_start,
          {_bucket('date_time', 10)} + to_seconds(10) AS window_end
        FROM bid GROUP BY ALL""",
    "q13": """SELECT b.auction, b.bidder, b.price, b.date_time, s.value
        FROM bid b JOIN (SELECT v AS key, CAST(v AS VARCHAR) AS value FROM range(10000) AS r(v)) s
        ON b.auction % 10000 = s.key""",
    "q14": f"""SELECT auction, bidder, {_CONVERTED} AS price, {_PART_OF_DAY} AS "bidTimeType",
          date_time, CAST(length(extra) - length(replace(extra, 'c', '')) AS INTEGER) AS c_counts
        FROM bid WHERE 0.908 * price > 1000000 AND 0.908 * price < 50000000""",
    "q14_r": f"""SELECT * FROM (
          SELECT auction, bidder, CAST(price AS DOUBLE) * CAST(0.908 AS DOUBLE) AS price,
            {_PART_OF_DAY} AS bid_time_type, date_time AS ts, extra FROM bid)
        WHERE price > 1000000 AND price < 50000000""",
    "q15": _report(f"{_DAY} AS day"),
    "q16": _report(f"channel, {_DAY} AS day", f"max({_MINUTE}) AS minute,"),
    "q16_r": f"""SELECT channel, count(*) AS total_bids, {_PRICES},
          count(DISTINCT bidder) AS distinct_bidders, count(DISTINCT auction) AS distinct_auctions
        FROM bid GROUP BY channel""",
    "q17": f"""SELECT auction, {_DAY} AS day, {_BID_COUNTS}, {_PRICES},
          CAST(sum(price) AS BIGINT) AS sum_price FROM bid GROUP BY ALL""",
    "q17_r": f"""SELECT auction, count(*) AS bid_count, {_PRICES},
          CAST(sum(price) AS BIGINT) AS sum_price, count(DISTINCT bidder) AS distinct_bidders
        FROM bid GROUP BY auction""",
    "q18": """SELECT auction, bidder, price, channel, url, date_time FROM (
          SELECT *, row_number() OVER (PARTITION BY bidder, auction
            ORDER BY date_time DESC, price DESC, channel, url, extra) AS rn FROM bid)
        WHERE rn <= 1""",
    "q19": """SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY auction
            ORDER BY price DESC, date_time, bidder, channel, url, extra) AS rank_number FROM bid)
        WHERE rank_number <= 10""",
    "q20": """SELECT b.auction, b.bidder, b.price, b.channel, b.url, b.date_time AS bid_date_time,
          b.extra AS bid_extra, a.item_name, a.description, a.initial_bid, a.reserve,
          a.date_time AS auction_date_time, a.expires, a.seller, a.category,
          a.extra AS auction_extra
        FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10""",
    "q21": _channel_code("(&|^)channel_id=([^&]*)", 2),
    "q21_r": _channel_code("(&|^)channel_id=([^&]*)", 2),
    "q21_r_anywhere": _channel_code("channel_id=([^&]*)", 1),
    "q21_r_timed": _channel_code("channel_id=([^&]*)", 1, "date_time AS ts,"),
    "q22": """SELECT auction, bidder, price, channel, split_part(url, '/', 4) AS dir1,
          split_part(url, '/', 5) AS dir2, split_part(url, '/', 6) AS dir3 FROM bid""",
    "q22_r": """SELECT auction, bidder, price, channel, string_split(url, '/')[4] AS dir1,
          string_split(url, '/')[5] AS dir2, string_split(url, '/')[6] AS dir3 FROM bid""",
    "q22_r_timed": """SELECT auction, bidder, price, channel, split_part(url, '/', 4) AS dir1,
          split_part(url, '/', 5) AS dir2, split_part(url, '/', 6) AS dir3, date_time AS ts FROM bid""",
    "lenient_bids": f"SELECT {_BID} FROM bid WHERE auction % 97 <> 0",
    "quarantine": """SELECT CAST(NULL AS VARCHAR) AS key, '{"auction":' || auction || ',"bidder":' || bidder
          || ',"price":' || price AS payload FROM bid WHERE auction % 97 = 0""",
    "record_count": "SELECT count(*) AS records FROM bid",
    "count_char_sql": """SELECT auction, bidder, price,
          CAST(length(extra) - length(replace(extra, 'c', '')) AS INTEGER) AS c_counts FROM bid""",
    "replay_metrics": """SELECT 'q0_r' AS query, count(*) AS input_rows, count(*) AS inserted_rows FROM bid
        UNION ALL SELECT 'q22_r', count(*), count(*) FROM bid""",
    "q12_totals": "SELECT bidder, CAST(count(*) AS BIGINT) AS bid_count FROM bid GROUP BY bidder",
    **{name: "SELECT channel, count(*) AS bids, max(price) AS highest FROM bid GROUP BY channel"
       for name in ("materialized_view", "snapshot_view", "upserted_view", "appended_changes")},
}
STATEMENTS |= {
    "replicated_log": STATEMENTS["keyed_log"],
    "stats_round_trip": STATEMENTS["dataset_stats"],
    "q10_files_stream": STATEMENTS["day_files"],
    "q12_totals_stream": STATEMENTS["q12_totals"],
}


def statement(name: str) -> str:
    return f"WITH {VIEWS.strip()} {STATEMENTS[name].strip()}"
