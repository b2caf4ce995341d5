"""Every operator as a query over the driver tables, with the SQL that checks it."""

from fleetair.checks import core, flows, models, series, signals

_MODULES = [core, signals, series, models, flows]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql.strip() for m in _MODULES for name, sql in m.SQL.items()}
