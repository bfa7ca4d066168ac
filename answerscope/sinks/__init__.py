"""Writing results, metrics and reports."""
from .reports import *  # noqa: F401,F403
