"""Storage-usage analytics and corpus preparation on Spark.

The names below are what a program needs beside the packages themselves: scan a
directory, configure it, write and read its reports and tables, and show them.
"""

from importlib import import_module

#: Where each name of the interface stands; modules are loaded when they are first used.
PLACES = {
    "Config": "config",
    "Heartbeat": "status",
    "Progress": "status",
    "Target": "sync",
    "bar": "functions.render",
    "capacity": "sources.documents",
    "card": "notify",
    "compact_json": "sources.sinks",
    "detail": "cli",
    "entries": "sources.filesystem",
    "expand": "sources.documents",
    "export_users": "sources.sinks",
    "grid": "functions.render",
    "host_usernames": "sources.documents",
    "load_json": "sources.documents",
    "read_tables": "sources.sinks",
    "reports": "sources.documents",
    "run": "cli",
    "session": "cli",
    "show_reports": "cli",
    "show_tree": "cli",
    "size_text": "functions.render",
    "table": "functions.render",
    "tables": "plans.build",
    "time_text": "functions.render",
    "username_of": "sources.documents",
    "owner_of": "sources.documents",
    "write_json": "sources.sinks",
    "write_tables": "sources.sinks",
}
__all__ = sorted(PLACES)


def __getattr__(name: str):
    if name not in PLACES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{PLACES[name]}"), name)
