"""Spark-native analytics for head-to-head contests.

Every public operator takes DataFrames (or Columns) and returns a lazy
DataFrame (or Column).  No operator triggers an action unless its docstring
says so, and none reads the wall clock: "now" is always an argument.
"""

__all__ = ["catalog", "constants", "functions", "operators", "plans", "schemas", "session", "sources", "streaming"]
