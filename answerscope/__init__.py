"""Analytics over the answers several question-answering models give to the same inputs.

Everything is a function from DataFrame to DataFrame; nothing here runs a job
unless its docstring says so.
"""

__version__ = "0.1.0"
