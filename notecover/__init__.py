"""notecover: text-pair coverage scoring and classifier evaluation on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; work is expressed with
built-in Spark SQL expressions, joins, aggregates and windows so that Catalyst and
AQE plan it. Python runs inside tasks only where no built-in expression exists
(the token-sort Indel ratio and pluggable batch scorers).
"""

__version__ = "0.1.0"
