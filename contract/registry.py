"""Every registered query with its SQL counterpart (None where SQL cannot express it)."""

from . import queries_core, queries_store, queries_web

ALL = {**queries_core.QUERIES, **queries_web.QUERIES, **queries_store.QUERIES}
