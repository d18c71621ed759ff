"""runloom: a Spark-native analytics engine for agent traces.

Import the parts you need, e.g. ``from runloom.operators.sessions import sessions``.
"""

__version__ = "0.1.0"
