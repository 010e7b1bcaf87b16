"""canvass: survey and market analytics as Spark DataFrame operators.

Every public operator takes the DataFrame it should analyse and returns a
DataFrame (or a small result object holding DataFrames and fitted models).
Work runs on Spark: built-in expressions, aggregates, joins and MLlib.
"""

from canvass.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
