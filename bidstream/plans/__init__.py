"""The query set. Every query is a function of (tables, params) returning a DataFrame.

``CATALOG`` maps names to functions. Names ending in ``_r`` are the forms run over flat bids and
keep the column name ``ts``; the others are the documented forms and call it ``date_time``.
"""

from bidstream.plans import joins, ranking, reports, stateless, windows

CATALOG = {
    name: getattr(module, name)
    for module in (stateless, joins, reports, ranking, windows)
    for name in module.QUERIES
}

__all__ = ["CATALOG"]
