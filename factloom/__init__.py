"""factloom: evidence analytics expressed as Spark DataFrame plans.

The core packages never import :mod:`factloom.llm`; the training-data
operators there build on the core and can be removed without touching it.
"""

__version__ = "0.1.0"
