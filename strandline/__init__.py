"""strandline: corpus-intelligence operators written as Spark DataFrame code.

Every operator is a plain function that takes DataFrames (or Columns) and
returns DataFrames (or Columns); Catalyst plans everything.
"""

__version__ = "0.1.0"
