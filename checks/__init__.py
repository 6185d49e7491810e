"""Registered queries with the SQL that must give the same rows."""

from checks import extensions, functions, joins, reports, sources, store, streams, totals, windows

ENTRIES = {}
for _module in (sources, joins, totals, windows, functions, store, streams, extensions, reports):
    for _name, _entry in _module.ENTRIES.items():
        assert _name not in ENTRIES, _name
        ENTRIES[_name] = _entry
