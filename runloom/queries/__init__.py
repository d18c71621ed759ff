"""The core's registered queries and their SQL."""

from runloom.queries import messages, traces

QUERIES = {**traces.QUERIES, **messages.QUERIES}
SQL = {**traces.SQL, **messages.SQL}
